"""Sentence boundaries in many languages and scripts: a lexer of boundary marks and a finite transducer over its symbols.

The lexer looks at the few characters that may matter (marks, quotation marks, brackets, line breaks) and names each with a
symbol. The transducer has a state for what is open at a place (nothing, a sentence, quotations in it) and says for each
symbol whether a sentence ends there. Texts longer than CHUNK are cut into ranges, between paragraphs where one ends in
reach: each range is lexed once and becomes a function from the state before it to the state after it, the functions are
composed by a parallel prefix scan, and the transducer runs over each range's symbols from its own state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.session import cut

CHUNK = 4_096
#: A range goes on to the end of its paragraph, up to so many times CHUNK.
REACH = 16
#: A quotation or bracket that isn't closed in its paragraph, or is longer than this, counts as a plain mark.
SPAN = 16_384
#: What the lexer sees on either side of a range: to the end of the paragraph and a little of the next, or so much.
HALO, NEAR = SPAN + 2_048, 64
#: Quotations and brackets inside each other that are told apart.
DEPTH = 16

# Abbreviations after which a sentence goes on (in lower case, without the last full stop).
ABBREVIATIONS = frozenset(
    """dr prof mr mrs ms st mt gen col sgt capt lt rev hon gov sen rep fig figs sec eq eqs ch vol ed eds pp p cf vs approx ca no ee
    nos max min incl excl dept est ext tel art arts resp viz al e.g i.e c.f u.a z.b d.h p.ex p.ej u.a.m
    hr fr frl nr abs bd bzw ggf evtl vgl sog ca str env mme mlle m mm sra sr srta dra pág págs núm ej ex av
    см рис стр гл им ул д кв тов г-н г-жа проф акад т.е т.к т.н т.п
    κ κα κος δρ π.χ βλ σελ αρ δηλ د أ م م. ص ج ق डॉ श्री सुश्री प्रो ዶ.ር ո վրկ""".split()
)
# Abbreviations that may end a sentence: it ends there unless a small letter or a figure follows.
CLOSING = frozenset(
    "etc inc ltd co corp jr u.s u.k u.n e.u d.c a.m p.m am pm usw u.s.w etc. uu ee.uu д т.д т.п др г إلخ الخ κ.λπ κλπ κ.ά bros".split()
)
# Words before a figure with a full stop that make it an ordinal, and words that go on after a quotation.
ORDINAL_AFTER = frozenset("am der die das den dem des vom zum im beim bis ab seit jeder jede ein eine".split())
GOES_ON = re.compile(
    r"(?:然后|然後|并|並|而|就|后|後|便|又|再|接着|有人|他|她|我们问|と|って|という|とか|라고|이라고|라는|고 |في |ثم |و|ने |कहा|գրեց|ասաց|εγραψε|—|–|-|,|;|:|，|、|；|：|،|؛)"
)
# Small words that go on after a quotation or an "etc.".
CONTINUES = frozenset(
    """and but or nor so yet then than asked said wrote replied answered added noted says asks writes told in on at to of for from with by
    as is was were are be has have had will would can could should may while when where before after because until since though if that
    which who he she they it we i you not also demande dit écrit répond ajoute dans en et mais ou puis avant après sur avec pour par à de
    du des que qui est a dijo pregunta respondió y pero o luego antes después sobre con para por del es son sagte fragte schrieb rief und
    aber oder dann im auf mit für von vor nach ist war сказал сказала написал спросил ответил и но а в на с по или έγραψε είπε ρώτησε και
    αλλά σε στο στη με e ma ed disse em il la le""".split()
)
SPEAKERS = "User|You|Human|Me|Assistant|Claude|Copilot|GitHub Copilot|GPT|AI|System|Tool|Bot"

MARKS = ".!?…。！？｡．։।॥۔؟።፧፨;\u037e‼⁇⁈⁉។៕။།"
STRONG = frozenset("!?。！？｡։।॥۔؟።፧፨\u037e‼⁇⁈⁉។៕။།．")
PAIRS = {
    '"': '"', "'": "'", "“": "”", "„": "“", "”": "“", "‟": "”", "«": "»", "»": "«", "‹": "›", "‘": "’", "‚": "‘", "「": "」", "『": "』",
    "﹁": "﹂", "〝": "〞", "(": ")", "（": "）",
}
BRACKETS = frozenset("(（")
CLOSERS = "\"'”“’»›」』﹂〞)）]】〉》"
_EVENT = rf"[{re.escape(MARKS)}]+|\n|[\u2028\u2029]|[\"'“”„‟«»‹›‘‚「」『』﹁﹂〝〞()（）]"
EVENT = re.compile(_EVENT)
#: Scripts written without marks: a blank between two of their letters ends a sentence.
THAI = "ก-๛ກ-ໟ"
EVENT_THAI = re.compile(_EVENT + rf"|(?<=[{THAI}])[ \u00a0]+(?=[{THAI}])")
HAS_THAI = re.compile(f"[{THAI}]")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
HARD = re.compile(
    r"[^\S\n]*(?:\n|$|#{1,6}(?:[^\S\n]|$)|[-*+•‣▪–][^\S\n]+\S|\(?\d{1,3}[.)][^\S\n]+\S|>|\||`{3}|~{3}|={3,}|(?:"
    + SPEAKERS
    + r")[^\S\n]*[:：])"
)
LINE_MARK = re.compile(r"[^\S\n]*(?:[-*+•‣▪–]|\(?\d{1,3}[.)]|#{1,6})[^\S\n]+")
LABEL = re.compile(rf"[^\S\n]*(?:{SPEAKERS})[^\S\n]*[:：][^\S\n]*")
HEADING = re.compile(r"[^\S\n]*#{1,6}[^\S\n]")
NONSPACE = re.compile(r"\S")
WORD = re.compile(r"\w+")
BREAK = re.compile(r"\n[^\S\n]*\n")
WORD_BEFORE = re.compile(r"[^\s()\[\]{}\"“”„«»‘,،;:/（）「」]+$")

# --- symbols of the lexer and the transducer -------------------------------------------------------------------------
# W text; B block ends; E a mark that ends a sentence; O opening quotation, P opening bracket; closing quotations and
# brackets by what follows them: a capital or the end (U), a mark or word that goes on (L), anything else (N)
W, B, E, O, P, QU, QL, QN, PU, PL = range(10)
SYMBOLS = 10


def _states() -> list[tuple]:
    """() between sentences, (0,) in one, (depth, bracket, first, marked) in something opened: whether the outermost is a
    bracket, whether it opened the sentence, whether an ending mark came last."""
    deep = [(d, b, f, m) for d in range(1, DEPTH + 1) for b in (0, 1) for f in (0, 1) for m in (0, 1)]
    return [(), (0,), *deep]


def _step(state: tuple, symbol: int) -> tuple[tuple, bool, bool]:
    """(state after, whether a sentence starts at the symbol, whether one ends after it)."""
    if symbol == B:
        return (), False, state != ()
    starts = state == ()
    if len(state) < 4:
        if symbol in (O, P):
            return (1, int(symbol == P), int(starts), 0), starts, False
        return ((), starts, True) if symbol == E else ((0,), starts, False)
    depth, bracket, first, marked = state
    if symbol in (O, P):
        return (min(DEPTH, depth + 1), bracket, first, 0), False, False
    if symbol == W:
        return (depth, bracket, first, 0), False, False
    if symbol == E:
        return (depth, bracket, first, 1), False, False
    if depth > 1:
        return (depth - 1, bracket, first, marked), False, False
    if symbol in (PU, PL):
        ends = marked and first and symbol == PU
    else:
        ends = marked and (symbol == QU or (symbol == QN and not first))
    return ((), False, True) if ends else ((0,), False, False)


STATES = _states()
_AT = {s: i for i, s in enumerate(STATES)}
#: NEXT[state][symbol], and what is put out: 1 a start, 2 an end, 3 both.
NEXT = [[_AT[_step(s, x)[0]] for x in range(SYMBOLS)] for s in STATES]
PUT = [[_step(s, x)[1] + 2 * _step(s, x)[2] for x in range(SYMBOLS)] for s in STATES]
MOVES = np.array(NEXT).T.copy()


# --- lexer ------------------------------------------------------------------------------------------------------------


def _follows(text: str, at: int) -> str:
    """What comes after a closing mark: U a capital, an opening or the end; L what goes on; N anything else."""
    m = NONSPACE.search(text, at)
    if m is None or "\n" in text[at : m.start()] and BREAK.search(text, at, m.start()):
        return "U"
    c = m.group()
    if GOES_ON.match(text, m.start()):
        return "L"
    if c.islower():
        return "L" if WORD.match(text, m.start()).group() in CONTINUES else "N"
    if m.start() == at and ("가" <= c <= "힣" or HAS_THAI.match(c)):
        return "L"
    if c.isupper() or c in "¿¡«“„\"'([（「『" or c in "#-*>|":
        return "U"
    return "N"


def _full_stop(text: str, at: int, end: int) -> bool:
    """Whether the full stop at ``at`` ends a sentence."""
    following = text[end] if end < len(text) else ""
    before = text[at - 1] if at else ""
    if not before or before.isspace():
        return False
    if following and not following.isspace() and following not in CLOSERS:
        if following.isalpha():
            # no blank: a capital (or a script without case) after a word ends it, names of files and fields do not
            nxt = text[end + 1 : end + 2]
            if following.islower() or not (before.islower() or before.isdigit() or before in ")]}\"”»*`"):
                return False
            if following.isupper() and nxt.isupper():
                return False
            word = WORD_BEFORE.search(text, max(0, at - 60), at)
            bare = word.group() if word else ""
            return "@" not in bare and "://" not in bare and bare.lower() not in ABBREVIATIONS
        if following not in "¿¡“„«‘「『(（[*_#":
            return False
    m = NONSPACE.search(text, end)
    ahead = m.group() if m else ""
    word = WORD_BEFORE.search(text, max(0, at - 40), at)
    bare = word.group() if word else ""
    low = bare.lower()
    if not bare:
        return True
    if low == "no" and not ahead.isdigit():
        return True
    # d’, l’ and the like before an abbreviation
    tail = low.rsplit("’", 1)[-1].rsplit("'", 1)[-1]
    if tail in CLOSING or low in CLOSING:
        if tail == "д" and not text[max(0, at - 4) : at].lower().endswith("т. д"):
            return False
        if ahead.islower() and tail in ("etc", "usw", "т.д"):
            return WORD.match(text, m.start()).group() not in CONTINUES
        return not (ahead.islower() or (ahead.isdigit() and tail in ("г", "др", "sr", "jr")))
    if tail in ABBREVIATIONS:
        return False
    if len(bare) == 1 and bare.isalpha():
        if bare.isupper():
            # an initial, unless a word in small letters or a unit precedes and nothing that could be a name follows
            return not (ahead.isupper() or ahead.islower())
        # single small letters: parts of spaced abbreviations (z. B., p. ex., т. е.), but a unit after a figure ends
        prev = text[max(0, at - 3) : at - 1].rstrip()
        if prev and prev[-1].isdigit():
            return True
        return not (ahead.islower() or ahead.isupper() and bare in "zdpuтκиκ")
    if bare.isdigit() and len(bare) <= 2:
        line = text.rfind("\n", 0, at) + 1
        if not text[line : at - len(bare)].strip():
            return False  # a list mark
        prior = WORD_BEFORE.search(text, max(0, at - 40), at - len(bare) - 1)
        if prior and prior.group().lower() in ORDINAL_AFTER and ahead.isalpha():
            return False
    return True


def _ellipsis(text: str, at: int, end: int) -> bool:
    """Whether an ellipsis ends a sentence: where a capital, another script or the end of the block follows."""
    m = NONSPACE.search(text, end)
    if m is None:
        return True
    if "\n" in text[end : m.start()] and BREAK.search(text, end, m.start()):
        return True
    c = m.group()
    if c.isupper() or c in "¿¡«“„\"([（「#-*>|":
        return m.start() > end or c.isupper()
    if c.islower() or c.isdigit():
        return False
    before = text[max(0, at - HALO) : at].rstrip()[-1:]
    return m.start() > end and (before.islower() or before.isupper()) and c.isalpha()


def lex(text: str, lo: int, hi: int) -> tuple[list[int], list[int], list[int]]:
    """Symbols, their places and the places after them, for the part [lo, hi) of a text."""
    kinds: list[int] = []
    places: list[int] = []
    ends: list[int] = []
    closing: dict[int, int] = {}  # place of a closing mark -> bracket?
    last = 0
    skip = 0
    size = len(text)

    def put(kind: int, at: int, end: int) -> None:
        nonlocal last
        if last < at:
            m = NONSPACE.search(text, last, at)
            if m and lo <= m.start() < hi:
                kinds.append(W)
                places.append(m.start())
                ends.append(m.start() + 1)
        last = end
        if lo <= at < hi:
            kinds.append(kind)
            places.append(at)
            ends.append(end)

    opening = -1  # where the label or mark begins that ends at skip
    mark = LINE_MARK.match(text) or LABEL.match(text)
    if mark:
        opening, skip = NONSPACE.search(text).start(), mark.end()
    for ev in (EVENT_THAI if HAS_THAI.search(text) else EVENT).finditer(text):
        at, end = ev.span()
        if at < skip:
            continue
        c = text[at]
        if c in "\n\u2028\u2029":
            line = text.rfind("\n", 0, at) + 1
            if c != "\n" or HARD.match(text, end) or HEADING.match(text, line):
                put(B, at, end)
                mark = LINE_MARK.match(text, end) or LABEL.match(text, end)
                if mark:
                    opening, skip = NONSPACE.search(text, end).start(), mark.end()
            continue
        if c in MARKS:
            run = ev.group()
            if ";" in run or "\u037e" in run:
                if run != ";" and run != "\u037e":
                    continue
                if run == ";" and not GREEK.search(text, max(0, at - 60), at):
                    continue
                good = end >= size or text[end].isspace() or text[end] in CLOSERS or text[end].isupper()
            elif STRONG.intersection(run):
                f = text[end] if end < size else ""
                good = not (f and (f.isascii() and (f.islower() or f.isdigit() or f in "=&/_`") and run[-1] in "!?."))
                if good and f and f not in CLOSERS and not f.isspace() and run in ("!", "?") and at and text[at - 1] in "/&=(":
                    good = False
                if good and run in ("?", "!", "?!", "!?") and f and f.isspace() and text[at - 1 : at].isspace():
                    good = True  # a blank before the mark, as in French
            elif run == ".":
                good = _full_stop(text, at, end)
            else:
                good = _ellipsis(text, at, end)
            if good:
                while end < size and text[end] in "”’»」』)）]】" and end not in closing:
                    end += 1
                put(E, at, end)
                skip = end
            continue
        if at in closing:
            bracket = closing.pop(at)
            f = _follows(text, end)
            if bracket:
                m = NONSPACE.search(text, end)
                put(PL if f == "L" and not (m and m.group().isalnum()) else PU, at, end)
            else:
                put({"U": QU, "L": QL, "N": QN}[f], at, end)
            continue
        want = PAIRS.get(c)
        if want is None:
            if c == " " or c == " ":
                put(E, at, at)  # between two letters of a script without marks
            continue
        if c == "'" or c == '"' or c == "‘":
            # straight marks open only before a word and not inside one
            if at and not (text[at - 1].isspace() or text[at - 1] in "([{（“„«:：—–-" or c == '"' and not text[at - 1].isalnum() or ord(text[at - 1]) > 0x2E80):
                if not (c == '"' and text[at - 1 : at] and text[at - 1] in ".!?…"):
                    continue
            if end >= size or text[end].isspace():
                continue
        stop = min(size, at + SPAN)
        to = text.find(want, end, stop)
        if c == "'":
            while to != -1 and to + 1 < size and text[to + 1].isalnum():
                to = text.find(want, to + 1, stop)
        if c == "„" and to == -1:
            to = text.find("”", end, stop)
        if to == -1 or to == end or ("\n" in text[end:to] and BREAK.search(text, end, to)):
            continue
        closing[to] = int(c in BRACKETS)
        if last <= opening <= at and not NONSPACE.search(text, skip, at):
            at = opening  # right after a label or list mark, which opens the sentence with it
            last = at
        put(P if c in BRACKETS else O, at, end)
    if hi >= size:
        put(B, size, size)
        if not kinds or places[-1] != size:
            kinds.append(B)
            places.append(size)
            ends.append(size)
    elif last < hi:
        m = NONSPACE.search(text, max(last, lo), hi)
        if m:
            kinds.append(W)
            places.append(m.start())
            ends.append(m.start() + 1)
    return kinds, places, ends


def _visible_end(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def run(text: str | None, kinds: list[int], places: list[int], ends: list[int], state: int = 0) -> tuple[list[int], list[int], int]:
    """Starts and ends of sentences and the state afterwards; without a text, the ends of blocks are known already."""
    starts: list[int] = []
    stops: list[int] = []
    nxt, out = NEXT, PUT
    for x, at, end in zip(kinds, places, ends):
        put = out[state][x]
        if put:
            if put & 1:
                starts.append(at)
            if put & 2:
                stops.append(_visible_end(text, at) if x == B and text is not None else end)
        state = nxt[state][x]
    return starts, stops, state


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """The (start, end) of each sentence of one text."""
    if not text:
        return []
    kinds, places, ends = lex(text, 0, len(text))
    starts, stops, _ = run(text, kinds, places, ends)
    return list(zip(starts, stops))


def transfer(kinds: list[int]) -> list[int]:
    """The state after a range for each state before it."""
    states = np.arange(len(STATES))
    for x in kinds:
        states = MOVES[x][states]
    return states.tolist()


def prefix_states(functions: np.ndarray) -> np.ndarray:
    """The state before each range, given the ranges' functions (rows), by a parallel prefix scan (doubling)."""
    scan = functions.copy()
    step = 1
    while step < len(scan):
        later = np.take_along_axis(scan[step:], scan[:-step], axis=1)
        scan = np.concatenate([scan[:step], later])
        step *= 2
    return np.concatenate([[0], scan[:-1, 0]]).astype("int64")


def ranges_of(text: str, size: int) -> Iterator[tuple[int, int]]:
    """The ranges [lo, hi) of a text: at least ``size`` characters, up to the next paragraph, but at most REACH times as much."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        if hi < len(text):
            most = min(len(text), lo + REACH * size)
            m = BREAK.search(text, hi, most)
            hi = m.start() if m else most
        yield lo, hi
        lo = hi


def context(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The part [at, to) of a text that decides what the range [lo, hi) means."""
    at, to = max(0, lo - HALO), min(len(text), hi + HALO)
    if BREAK.match(text, lo):
        at = max(0, _visible_end(text, lo) - NEAR)
    elif lo:
        for m in BREAK.finditer(text, at, lo):
            at = max(0, _visible_end(text, m.start()) - NEAR)
    m = BREAK.search(text, hi, to)
    if m:
        ahead = NONSPACE.search(text, m.end(), to)
        to = min(to, ahead.start() + NEAR) if ahead else to
    return at, to


# --- plans ------------------------------------------------------------------------------------------------------------


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (id, sent_start, sent_end), one per sentence, offsets in code points, the end exclusive, outer white space left
    out. Null, empty and blank texts have none; repeated rows and ids give repeated sentences; other columns are ignored.

    Texts of up to ``chunk`` characters are a range of their own, begin in a known state and are done where they lie, without a
    shuffle. Longer ones are cut into ranges that are spread over all tasks, so one giant text is not one task's work. The
    sentences don't depend on the ranges, but for paragraphs of more than REACH times ``chunk`` characters in which quotations are
    longer than SPAN.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    id_type = rows.schema["doc_id"].dataType
    out = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("sent_start", T.LongType()), T.StructField("sent_end", T.LongType())]
    )
    short = rows.where(F.length("text") <= chunk).mapInArrow(_whole, out)
    long = rows.where(F.length("text") > chunk)
    return short.unionByName(_long(long, id_type, chunk)).withColumnRenamed("doc_id", id_col)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        which: list[int] = []
        starts: list[int] = []
        stops: list[int] = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if text:
                a, b, _ = run(text, *lex(text, 0, len(text)))
                which += [i] * len(a)
                starts += a
                stops += b
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(which, pa.int64())), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())],
            names=["doc_id", "sent_start", "sent_end"],
        )


def _long(rows: DataFrame, id_type: T.DataType, chunk: int) -> DataFrame:
    def fields(*names: str) -> list[T.StructField]:
        return [T.StructField(c, T.LongType()) for c in names]

    def lists(*names: str) -> list[T.StructField]:
        return [T.StructField(c, T.ArrayType(T.IntegerType())) for c in names]

    known = [T.StructField("doc_id", id_type), *fields("copy", "no", "at")]
    ranges = T.StructType([*known, *fields("lo", "hi"), T.StructField("text", T.StringType())])
    lexed = T.StructType([*known, *lists("f", "kinds", "places", "ends")])

    def slices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for doc_id, copy, text in zip(pdf["doc_id"], pdf["copy"], pdf["text"]):
                for no, (lo, hi) in enumerate(ranges_of(text, chunk)):
                    at, to = context(text, lo, hi)
                    yield pd.DataFrame(
                        {"doc_id": [doc_id], "copy": copy, "no": no, "at": at, "lo": lo - at, "hi": hi - at, "text": text[at:to]}
                    )

    def symbols(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = []
            for text, lo, hi in zip(pdf["text"], pdf["lo"], pdf["hi"]):
                kinds, places, ends = lex(text, lo, hi)
                # a block ends before the white space in front of it
                ends = [_visible_end(text, x) if k == B else y for k, x, y in zip(kinds, places, ends)]
                found.append((transfer(kinds), kinds, places, ends))
            f, kinds, places, ends = zip(*found) if found else ([], [], [], [])
            yield pdf[["doc_id", "copy", "no", "at"]].assign(f=f, kinds=kinds, places=places, ends=ends)

    # rows with one id stay apart: each takes its own number
    cutted = rows.withColumn("copy", F.monotonically_increasing_id()).mapInPandas(slices, ranges)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    pieces = cut(cutted.repartition(tasks, "doc_id", "copy", "no").mapInPandas(symbols, lexed), "symbols")

    def entry(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the ranges of the text that may go on in the next batch

        def states_of(rows: list[tuple]) -> list[tuple]:
            return [(copy, no, int(x)) for (copy, no, _), x in zip(rows, prefix_states(np.stack([f for *_, f in rows])))]

        for pdf in parts:
            out: list[tuple] = []
            for r in pdf[["copy", "no", "f"]].itertuples(index=False, name=None):
                if held and held[0][0] != r[0]:
                    out += states_of(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=["copy", "no", "state"])
        if held:
            yield pd.DataFrame(states_of(held), columns=["copy", "no", "state"])

    ordered = pieces.select("copy", "no", "f").repartition(tasks, "copy").sortWithinPartitions("copy", "no")
    states = ordered.mapInPandas(entry, T.StructType(fields("copy", "no", "state")))
    pair = T.ArrayType(T.StructType(fields("s", "e")))
    marks = T.StructType([T.StructField("doc_id", id_type), *fields("copy", "no"), T.StructField("own", pair), *fields("ends", "opens")])

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                a, b, _ = run(None, r.kinds, r.places, r.ends, r.state)
                first = b.pop(0) + r.at if b and (not a or b[0] <= a[0]) else None  # of a sentence that began before
                last = a.pop() + r.at if len(a) > len(b) else None  # one that goes on
                own = [{"s": int(x + r.at), "e": int(y + r.at)} for x, y in zip(a, b)]
                out.append((r.doc_id, r.copy, r.no, own, first, last))
            yield pd.DataFrame(out, columns=marks.names).astype({"ends": "Int64", "opens": "Int64"})

    found = pieces.drop("f").join(states, ["copy", "no"]).mapInPandas(emit, marks)
    before = Window.partitionBy("copy").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.struct(F.last("opens", True).over(before).alias("s"), F.col("ends").alias("e"))
    every = F.concat("own", F.when(F.col("ends").isNotNull(), F.array(begun)).otherwise(F.array().cast(pair)))
    return found.select("doc_id", every.alias("all")).select("doc_id", F.explode("all").alias("x")).select(
        "doc_id", F.col("x.s").alias("sent_start"), F.col("x.e").alias("sent_end")
    )
