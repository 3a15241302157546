"""Splitting oversized texts between their blocks, range by range.

Every text is worked on in ranges of RANGE characters with halos, whatever its size. Each range knows its own lines; what it
cannot know is the block that is open where it begins (a code fence may have been opened far before). So a first pass gives
each range's state afterwards for every state before it that could matter (the boundary table), the tables of one text are
stitched in order and the lengths summed up, and a second pass gives each range's blocks and other boundaries, as offsets of
the text, from the state it really begins in. Pieces are then cut from the stitched boundaries alone. Giant files are read by
byte ranges in the same way.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.session import cut

RANGE = 4_096
#: Characters of a line that are looked at, and what a range sees of the text before and behind it besides.
HALO, NEAR = 16_384, 32
#: Characters after which the pieces of a giant file are cut anew, so that no task holds all its boundaries.
SEGMENT = 1 << 30

BLANK = re.compile(r"[^\S\n]*(?:\n|$)")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)")
ATX = re.compile(r" {0,3}#{1,6}(?:[^\S\n]|\n|$)")
SETEXT = re.compile(r" {0,3}(?:=+|-+)[^\S\n]*(?:\n|$)")
RULE = re.compile(r" {0,3}(?:(?:\*[^\S\n]*){3,}|(?:_[^\S\n]*){3,}|(?:-[^\S\n]*){3,})(?:\n|$)")
ITEM = re.compile(r"([^\S\n]*)(?:([-*+])|\d{1,9}([.)]))(?:[^\S\n]|\n|$)")
QUOTE = re.compile(r" {0,3}>")
DELIMITER = re.compile(r" {0,3}\|?[^\S\n]*:?-+:?[^\S\n]*(?:\|[^\S\n]*:?-+:?[^\S\n]*)*\|?[^\S\n]*(?:\n|$)")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s|[。！？｡।۔։።]")
SPACE = re.compile(r"\s")

#: What may be open: nothing, a paragraph, a quotation, a table, a list by its mark (and whether a blank line came), a fence
#: by its sign and length.
START = ("none",)


def line_starts(text: str, lo: int, hi: int) -> Iterator[int]:
    """The starts of the lines that begin in [lo, hi)."""
    at = lo if lo == 0 or text[lo - 1] == "\n" else text.find("\n", lo, hi) + 1 or hi
    while at < hi:
        yield at
        nxt = text.find("\n", at)
        if nxt < 0:
            return
        at = nxt + 1


def step(text: str, at: int, state: tuple) -> tuple[tuple, str | None]:
    """The state after the line at ``at``, and the kind of the block it opens, if any."""
    kind = state[0]
    fence = FENCE.match(text, at)
    if kind == "fence":
        sign, length = state[1], state[2]
        if fence and fence.group(1)[0] == sign and len(fence.group(1)) >= length and not fence.group(2).strip():
            return START, None
        return state, None
    if BLANK.match(text, at):
        return (("list", state[1], 1) if kind == "list" else START), None
    item = ITEM.match(text, at)
    if kind == "list":
        indented = text[at].isspace() and (text[at] == "\t" or text.startswith("  ", at))
        if indented and not (state[2] and not item and not text.startswith("  ", at)):
            return ("list", state[1], 0), None
        if item and (item.group(2) or item.group(3)) == state[1] and not RULE.match(text, at):
            return ("list", state[1], 0), None
    if fence and not (fence.group(1)[0] == "`" and "`" in fence.group(2)):
        return ("fence", fence.group(1)[0], len(fence.group(1))), "code"
    if ATX.match(text, at):
        return START, "heading"
    if kind == "para" and SETEXT.match(text, at):
        return START, None
    if RULE.match(text, at):
        return START, None
    if QUOTE.match(text, at):
        return ("quote",), None if kind == "quote" else "quotation"
    if item and len(item.group(1)) <= 3:
        sign = item.group(2) or item.group(3)
        empty = BLANK.match(text, item.end())
        first = item.group(2) or text[item.end(1) : item.end() - 1].rstrip(".)").lstrip() == "1"
        if kind not in ("para", "quote") or first and not empty:
            return ("list", sign, 0), "list"
    end = text.find("\n", at, at + HALO)
    if kind != "table" and end > 0 and "|" in text[at:end] and DELIMITER.match(text, end + 1) and "-" in text[end + 1 : end + 200]:
        if text.find("|", end + 1, text.find("\n", end + 1) % (len(text) + 1)) > 0:
            return ("table",), "table"
    if kind == "table":
        return state, None
    if kind in ("para", "quote"):
        return state, None
    if kind == "list" and not state[2]:
        return state, None
    return ("para",), "paragraph"


def scan(text: str, lo: int, hi: int, state: tuple) -> tuple[list[tuple[int, str]], tuple]:
    """The (start, kind) of the blocks that begin in [lo, hi) and the state afterwards; starts are first visible characters."""
    out = []
    for at in line_starts(text, lo, hi):
        state, opened = step(text, at, state)
        if opened:
            while text[at].isspace():
                at += 1
            out.append((at, opened))
    return out, state


STATES = [START, ("para",), ("quote",), ("table",), *[("list", s, b) for s in "-*+.)" for b in (0, 1)]]


def code(state: tuple) -> str:
    return " ".join(map(str, state))


def decode(text: str) -> tuple:
    return tuple(int(x) if x.isdigit() else x for x in text.split(" "))


def boundary_table(text: str, lo: int, hi: int) -> dict:
    """The state after a range for every state before it. For open fences, by sign: the longest fence each closing line can end
    that no line before it ended, and the state at the end if it does. Ways that meet at a line are followed once."""
    lines = list(line_starts(text, lo, hi))
    known: dict[tuple, tuple] = {}

    def follow(i: int, state: tuple) -> str:
        way = []
        while i < len(lines) and (i, state) not in known:
            way.append((i, state))
            state, _ = step(text, lines[i], state)
            i += 1
        end = state if i == len(lines) else known[i, state]
        known.update(dict.fromkeys(way, end))
        return code(end)

    fences: dict[str, list] = {"`": [], "~": []}
    for i, at in enumerate(lines):
        m = FENCE.match(text, at)
        if m and not m.group(2).strip():
            own, n = fences[m.group(1)[0]], len(m.group(1))
            if not own or n > own[-1][0]:
                own.append([n, follow(i + 1, START)])
    return {"ends": {code(s): follow(0, s) for s in STATES}, "fences": fences}


def first_table(text: str, lo: int, hi: int) -> dict:
    """The boundary table of a range that begins a text: nothing is open there."""
    return {"ends": {code(START): code(scan(text, lo, hi, START)[1])}, "fences": {"`": [], "~": []}}


def after(table: dict, state: tuple) -> tuple:
    """Looks a state up in a boundary table."""
    if state[0] == "fence":
        return next((decode(end) for n, end in table["fences"][state[1]] if n >= state[2]), state)
    return decode(table["ends"][code(state)])


def context(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The part [at, to) of a text that decides about the lines that begin in [lo, hi): the last of them and the next one end in it."""
    to = hi
    if lo == 0 or text.find("\n", lo - 1, hi - 1) >= 0:
        for _ in range(2):
            end = text.find("\n", to, to + HALO)
            to = end + 1 if end >= 0 else to + HALO
    return max(0, lo - NEAR), min(len(text), to + NEAR)


def gaps(marks: list[int], lo: int, hi: int, reach: int) -> list[tuple[int, int]]:
    """The parts of [lo, hi) between marks that are more than ``reach`` apart, or may be, at the edges."""
    if not marks:
        return [(lo, hi)]
    inner = [(a + 1, b) for a, b in zip(marks, marks[1:]) if b - a > reach]
    return [(lo, marks[0]), *inner, (marks[-1] + 1, hi)]


def boundaries(text: str, lo: int, hi: int, state: tuple, reach: int) -> tuple[list[tuple[int, str]], list[int], list[int], list[int]]:
    """Of the range [lo, hi): the blocks (start, kind) and, where no block is in reach, the other lines' starts, the ends of
    sentences and, where none of these is, of words."""
    found, _ = scan(text, lo, hi, state)
    starts = [b for b, _ in found]
    lines: list[int] = []
    sentences: list[int] = []
    words: list[int] = []
    for a, b in gaps(starts, lo, hi, reach):
        lines += [x for x in line_starts(text, a, b) if x]
        sentences += [x for m in SENTENCE.finditer(text, max(0, a - NEAR), min(len(text), b + 2)) if a <= (x := m.end()) < b]
    for a, b in gaps(sorted({*starts, *lines, *sentences}), lo, hi, reach):
        words += [x for m in SPACE.finditer(text, max(0, a - 1), b) if a <= (x := m.end()) < b]
    return found, lines, sentences, words


def cuts(first: int, last: int, levels: list, limit: int, overlap: int, head: bool = True) -> list[tuple[int, int]]:
    """Pieces (start, end) covering [first, last), each ``overlap`` longer at its start than where the one before ends
    (unless ``head``: it begins the text), none over ``limit``. A piece ends at the last boundary in reach of the first of
    ``levels`` (sorted offsets each) that has one, else at the limit."""
    out, at = [], first
    while at < last:
        start = at if head and at == first else at - overlap
        most = start + limit
        if last <= most:
            out.append((start, last))
            break
        to = most
        for marks in levels:
            i = bisect_right(marks, most) - 1
            if i >= 0 and marks[i] > at:
                to = int(marks[i])
                break
        out.append((start, to))
        at = to
    return out


# --- plans ------------------------------------------------------------------------------------------------------------


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in names]


TEXT = ["src", "row_id", "copy"]
_KEY = [T.StructField("src", T.StringType()), *_longs("row_id", "copy")]
RANGES = T.StructType([*_KEY, *_longs("no", "lo", "hi"), T.StructField("final", T.BooleanType()), T.StructField("text", T.StringType())])
TABLES = T.StructType([*RANGES, T.StructField("table", T.StringType())])
LEVELS = ["blocks", "lines", "sentences", "words"]
BOUNDARIES = T.StructType(
    [*_KEY, *_longs("no", "base", "chars"), T.StructField("kinds", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in LEVELS]
)


def oversized(texts: DataFrame, limit: int = 6000, overlap: int = 200, size: int = RANGE) -> DataFrame:
    """Rows (src, row_id, what, start_at, end_at) of all texts longer than ``limit`` characters: their blocks (what is
    paragraph, heading, list, table, quotation or code; end_at is null) and the pieces they are cut into (what is piece).

    texts: (src, row_id, text). Pieces have at most ``limit`` characters, end before the last block in reach where one begins
    there, else after a line, a sentence, a word, else at the limit; each piece after the first repeats the last ``overlap``
    characters of the one before. Offsets are code points. Null and shorter texts give no rows, repeated rows give repeated
    ones. All texts are cut into ranges of ``size`` characters that are spread over all tasks; the result doesn't depend on
    ``size``. A table is not known as one if its first line has more than HALO characters.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    rows = texts.select("src", F.col("row_id").cast("long").alias("row_id"), "text").where(F.length("text") > limit)

    def slices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                out = []
                for no, lo in enumerate(range(0, len(r.text), size)):
                    hi = min(len(r.text), lo + size)
                    at, to = context(r.text, lo, hi)
                    out.append((r.src, r.row_id, r.copy, no, lo - at, hi - at, hi == len(r.text), r.text[at:to]))
                yield pd.DataFrame(out, columns=RANGES.names)

    return _rows_of(rows.withColumn("copy", F.monotonically_increasing_id()).mapInPandas(slices, RANGES), limit, overlap)


def _rows_of(ranges: DataFrame, limit: int, overlap: int) -> DataFrame:
    found = stitched(ranges, limit - overlap)
    each = found.select("src", "row_id", F.explode(F.arrays_zip("kinds", "blocks")).alias("b"))
    blocks = each.select("src", "row_id", F.col("b.kinds").alias("what"), F.col("b.blocks").alias("start_at"), F.lit(None).cast("long").alias("end_at"))
    return blocks.unionByName(pieces(found, limit, overlap))


def stitched(ranges: DataFrame, reach: int) -> DataFrame:
    """The boundaries of texts given as ranges (RANGES), by range (BOUNDARIES), in two passes."""

    def table(no: int, final: bool, text: str, lo: int, hi: int) -> str | None:
        # nothing follows a last range, so nobody asks for its table
        return None if final else json.dumps((boundary_table if no else first_table)(text, lo, hi))

    def tables(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(table=[table(*r) for r in zip(pdf["no"], pdf["final"], pdf["text"], pdf["lo"], pdf["hi"])])

    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    spread = cut(ranges.repartition(tasks, "src", "row_id", "copy", "no").mapInPandas(tables, TABLES), "ranges")
    entry_schema = T.StructType([*_KEY, *_longs("no", "base"), T.StructField("state", T.StringType())])

    def stitch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, base = None, START, 0
        for pdf in parts:  # in order; a text may go on in the next batch
            out = []
            for *own, no, chars, t in pdf[[*TEXT, "no", "chars", "table"]].itertuples(index=False, name=None):
                if own != key:
                    key, state, base = own, START, 0
                out.append((*own, no, base, code(state)))
                state, base = after(json.loads(t), state) if t else START, base + chars
            yield pd.DataFrame(out, columns=entry_schema.names)

    known = spread.select(*TEXT, "no", (F.col("hi") - F.col("lo")).alias("chars"), "table")
    entries = known.repartition(tasks, *TEXT).sortWithinPartitions(*TEXT, "no").mapInPandas(stitch, entry_schema)

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                found, *rest = boundaries(r.text, r.lo, r.hi, decode(r.state), reach)
                levels = [[x + r.base - r.lo for x in level] for level in ([b for b, _ in found], *rest)]
                out.append((r.src, r.row_id, r.copy, r.no, r.base, r.hi - r.lo, [k for _, k in found], *levels))
            yield pd.DataFrame(out, columns=BOUNDARIES.names)

    return spread.drop("table", "final").join(entries, [*TEXT, "no"]).mapInPandas(emit, BOUNDARIES)


def pieces(found: DataFrame, limit: int, overlap: int, segment: int = SEGMENT) -> DataFrame:
    """The pieces of texts given by their boundaries (BOUNDARIES), as rows of :func:`oversized`. Texts of more than ``segment``
    characters are cut anew at the first block of each further segment."""
    parts = found.withColumn("seg", F.floor(F.col("base") / F.lit(segment)))
    own = [*TEXT, "seg"]
    spans = parts.groupBy(*own).agg(
        F.min(F.array_min("blocks")).alias("f"), F.min("base").alias("b"), F.max(F.col("base") + F.col("chars")).alias("e")
    )
    order = Window.partitionBy(*TEXT).orderBy("seg")
    spans = spans.withColumn("first", F.when(F.col("seg") == 0, F.col("b")).otherwise(F.coalesce("f", "b")))
    spans = spans.select(*own, "first", F.coalesce(F.lead("first").over(order), "e").alias("last"))

    def made(rows: list[tuple]) -> list[tuple]:
        src, row_id, _, seg, first, last, *_ = rows[0]
        levels = [np.concatenate([np.asarray(r[6 + i], dtype=np.int64) for r in rows]) for i in range(len(LEVELS))]
        return [(src, row_id, a, b) for a, b in cuts(int(first), int(last), levels, limit, overlap, int(seg) == 0)]

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the ranges of the text that may go on in the next batch
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf[[*own, "first", "last", *LEVELS]].itertuples(index=False, name=None):
                if held and held[0][:4] != r[:4]:
                    out += made(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(made(held), columns=names)

    names = ["src", "row_id", "start_at", "end_at"]
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.join(spans, own).select(*own, "no", "first", "last", *LEVELS)
    rows = rows.repartition(tasks, *own).sortWithinPartitions(*own, "no").mapInPandas(assemble, T.StructType([*_KEY[:2], *_longs("start_at", "end_at")]))
    return rows.select("src", "row_id", F.lit("piece").alias("what"), "start_at", "end_at")


def blocks_of(found: DataFrame) -> DataFrame:
    """Rows (src, row_id, block_start) of :func:`oversized`."""
    return found.where("what <> 'piece'").select("src", "row_id", F.col("start_at").alias("block_start"))


def pieces_of(found: DataFrame) -> DataFrame:
    """Rows (src, row_id, start_at, end_at) of the pieces of :func:`oversized`."""
    return found.where("what = 'piece'").select("src", "row_id", "start_at", "end_at")


def message_texts(copilot: DataFrame, export: DataFrame) -> DataFrame:
    """(src, row_id, text) of both message tables."""

    def rows(df: DataFrame, src: str, text: str) -> DataFrame:
        return df.select(F.lit(src).alias("src"), F.col("row_id").cast("long").alias("row_id"), F.col(text).alias("text"))

    return rows(copilot, "copilot_session", "content").unionByName(rows(export, "claude_export", "text"))


def split_files(spark: SparkSession, paths: list[str], limit: int = 6000, overlap: int = 200, size: int = 4 << 20) -> DataFrame:
    """Rows as :func:`oversized` for UTF-8 files of any length; row_id is the place in ``paths``.

    The files are opened on the executors, by path or URI of a file system that Arrow knows (local, hdfs, s3, gs). Workers ask
    for the files' lengths, and each reads only the ``size`` bytes of its range and what its halos need; broken bytes become
    replacement characters. Offsets are characters of the file, summed up over the ranges before. Empty files give no rows.
    """

    def opened(path: str):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        return system, place

    def lengths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [system.get_file_info(place).size or 0 for system, place in map(opened, pdf["path"])]
            yield pdf.assign(total=found)

    known = spark.createDataFrame(list(enumerate(paths)), "row_id long, path string").repartition("row_id").mapInPandas(lengths, "row_id long, path string, total long")
    last = F.floor((F.col("total") - 1) / F.lit(size))
    asked = known.where("total > 0").withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("row_id", "no")

    def whole(raw: bytes, at: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                begin, end = r.no * size, min(r.total, (r.no + 1) * size)
                at, to = max(0, begin - 4 * (NEAR + 1)), min(r.total, end + 8 * (HALO + NEAR))
                system, place = opened(r.path)
                with system.open_input_file(place) as f:
                    raw = f.read_at(to - at, at)
                lo, hi = whole(raw, begin - at), whole(raw, end - at)
                left, right = whole(raw, 4) if at else 0, whole(raw, len(raw) - 4) if to < r.total else len(raw)
                before, own, behind = (x.decode("utf-8", "replace") for x in (raw[left:lo], raw[lo:hi], raw[hi:right]))
                text = before + own + behind
                a, b = context(text, len(before), len(before) + len(own))
                yield pd.DataFrame([("file", r.row_id, 0, r.no, len(before) - a, len(before) + len(own) - a, end == r.total, text[a:b])], columns=RANGES.names)

    return _rows_of(asked.mapInPandas(read, RANGES), limit, overlap)
