"""One surviving record per group of duplicates: field-wise rules, and token-level consensus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.schema import NODE_STATUSES
from skein.session import cut

#: Texts that say nothing, compared in lower case without brackets and outer signs.
FILLERS = [
    "", "n a", "na", "nan", "nil", "none", "null", "undefined", "unknown", "tbd", "tba", "tbc", "todo", "to do", "fixme",
    "no summary", "no description", "missing", "empty", "placeholder", "not available", "not applicable", "wip", "xxx", "test",
]

#: Characters that show nothing: white space, control and format characters, fillers and variation selectors.
INVISIBLE = r"\p{Z}\p{Cc}\p{Cf}ᅟᅠㅤﾠ⠀͏︀-️"


def visible(col: Column) -> Column:
    """The text without outer invisible characters, and without zero-width ones anywhere."""
    out = F.regexp_replace(col, rf"^[{INVISIBLE}]+|[{INVISIBLE}]+$", "")
    return F.regexp_replace(out, r"[\p{Cf}ᅟᅠㅤﾠ͏︀-️]+", "")


def says_something(col: Column) -> Column:
    """Whether a text is more than a filler."""
    core = F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{M}\p{N}]+", " "))
    return ~core.isin(FILLERS)


@F.pandas_udf(T.StringType())
def label_key(label: pd.Series) -> pd.Series:
    """Letters and digits of a label, compatibility forms and case folded; null for none."""

    def key(x):
        if x is None:
            return None
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold())
        return "".join(c for c in folded if c.isalnum()) or None

    return label.map(key, na_action="ignore")


def best(order: list[Column], value: Column, usable: Column) -> Column:
    """The (value, from_seq) of the usable row with the greatest order; ties to the smallest seq."""
    entry = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], (-F.col("_seq")).alias("neg"), value.alias("value"))
    return F.max(F.when(usable, entry))


def survivors(nodes: DataFrame, data_end: str = "2026-07-01") -> DataFrame:
    """One surviving record per group: group_seq, n_records and, for each of summary, status, confidence and updated_at,
    the chosen value (null where no record has a usable one) and ``<field>_from``, the seq of its record.

    A group is two or more rows with equal session_id and type and labels that have the same letters and digits (NFKC, case
    folded); rows with a null session_id or type, or a label without letters and digits, belong to none. summary: the
    longest visible text that is no filler; confidence: the highest in 0 to 1 (NaN is unusable); updated_at: the latest
    between created_at (any, where that is null) and ``data_end`` exclusive; status: that of the latest usable updated_at
    whose status is a known one. Ties go to the smallest seq. Everything is one aggregation with partial results, so a
    group that holds most rows is reduced before it moves.
    """
    text = visible(F.col("summary"))
    status = F.lower(F.regexp_replace("status", rf"^[{INVISIBLE}]+|[{INVISIBLE}]+$", ""))
    rows = nodes.select(
        F.col("session_id").alias("_session"),
        F.col("type").alias("_type"),
        F.col("seq").cast("long").alias("_seq"),
        label_key(F.col("label")).alias("_key"),
        text.alias("_summary"),
        status.alias("_status"),
        F.col("confidence").cast("double").alias("_conf"),
        F.col("created_at").alias("_made"),
        F.col("updated_at").alias("_upd"),
    ).where("_key is not null and _session is not null and _type is not null and _seq is not null")
    timely = (F.col("_upd") >= F.coalesce("_made", "_upd")) & (F.col("_upd") < F.lit(data_end).cast("timestamp"))
    length = F.length("_summary")
    picked = rows.groupBy("_session", "_type", "_key").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("_seq").alias("group_seq"),
        best([length], F.col("_summary"), says_something(F.col("_summary"))).alias("summary"),
        best([F.col("_upd")], F.col("_status"), timely & F.col("_status").isin(NODE_STATUSES)).alias("status"),
        best([F.col("_conf")], F.col("_conf"), (F.col("_conf") >= 0) & (F.col("_conf") <= 1)).alias("confidence"),
        best([F.col("_upd")], F.col("_upd"), timely).alias("updated_at"),
    )
    return picked.where("n_records >= 2").select(
        "group_seq",
        "n_records",
        *[
            c
            for f in ("summary", "status", "confidence", "updated_at")
            for c in (F.col(f"{f}.value").alias(f), (-F.col(f"{f}.neg")).alias(f"{f}_from"))
        ],
    )


def field_origins(chosen: DataFrame) -> DataFrame:
    """Rows (group_seq, field, from_seq) of the usable fields of :func:`survivors`."""
    fields = ("summary", "status", "confidence", "updated_at")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_from").alias("from_seq")) for f in fields])
    return chosen.select("group_seq", F.explode(pairs).alias("p")).select("group_seq", "p.*").where("from_seq is not null")


# --- token-level consensus --------------------------------------------------------------------------------------------


TOKEN = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]|[^\\s\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]+")


def tokens_of(text: str) -> list[str]:
    """The words of a text; in scripts without blanks each letter is a token."""
    return TOKEN.findall(text)


#: Places of an alignment that are written down at once: a byte each.
PLACES = 8192 * 8192


def steps(profile: list[dict], total: float, tokens: list[str], places: int = PLACES) -> list[tuple[int | None, int | None]]:
    """The global alignment of tokens to columns (token -> weight, ``total`` in each), as (column, token) places, None for a gap.

    Placing a token into a column earns the share of the column's weight that agrees, a gap costs a half. Rows are filled at once:
    the best way along a row is a running maximum. Where there are more than ``places``, the rows are halved and the ways back
    written down for one part at a time, from a row in the middle that is kept; the alignment is the same.
    """
    m, gap = len(tokens), -0.5
    at: dict[str, list[int]] = {}
    for j, t in enumerate(tokens):
        at.setdefault(t, []).append(j)
    along = np.arange(m + 1) * gap

    def fill(row: np.ndarray, i: int, way: np.ndarray | None = None) -> np.ndarray:
        agree, col = np.zeros(m), profile[i]
        for t in at if len(at) < len(col) else col:
            if t in at and t in col:
                agree[at[t]] = col[t] / total
        both = row[:-1] + 2 * agree - 0.6
        down = row + gap
        new = np.maximum(down, np.concatenate([[-np.inf], both]))
        new = np.maximum.accumulate(new - along) + along
        if way is not None:  # 0 a token of its own, 1 a column of its own, 2 both
            way[1:] = np.where(np.abs(new[1:] - both) < 1e-9, 2, np.where(np.abs(new[1:] - down[1:]) < 1e-9, 1, 0))
        return new

    out: list[tuple[int | None, int | None]] = []

    def back(lo: int, hi: int, row: np.ndarray, j: int) -> int:
        """Goes back from row hi and place j to row lo, whose values are given; the place there."""
        if hi - lo > 1 and (hi - lo) * (m + 1) > places:
            middle, half = (lo + hi) // 2, row
            for i in range(lo, middle):
                half = fill(half, i)
            return back(lo, middle, row, back(middle, hi, half, j))
        way = np.ones((hi - lo, m + 1), dtype=np.int8)
        for i in range(lo, hi):
            row = fill(row, i, way[i - lo])
        i = hi
        while i > lo:
            if j and way[i - lo - 1, j] == 2:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif not j or way[i - lo - 1, j] == 1:
                i -= 1
                out.append((i, None))
            else:
                j -= 1
                out.append((None, j))
        return j

    first = back(0, len(profile), along, m)
    return out[::-1] if not first else [(None, j) for j in range(first)] + out[::-1]


def align(profile: list[dict], total: float, tokens: list[str], weight: float, places: int = PLACES) -> list[dict]:
    """The profile (a column per place: token -> weight, ``total`` in each) with one more token row aligned to it, gaps where it
    has none; its columns are changed in place."""
    out: list[dict] = []
    for i, j in steps(profile, total, tokens, places):
        token = "" if j is None else tokens[j]
        col = profile[i] if i is not None else {"": total} if total else {}
        col[token] = col.get(token, 0.0) + weight
        out.append(col)
    return out


def distance(a: list[str], b: list[str]) -> int:
    """Token edit distance, a row at once."""
    known: dict[str, int] = {}
    x, y = (np.array([known.setdefault(t, len(known)) for t in part], dtype=np.int64) for part in (a, b))
    along = np.arange(len(y) + 1)
    last = along
    for i in range(len(x)):
        now = np.concatenate([[i + 1], np.minimum(last[1:] + 1, last[:-1] + (y != x[i]))])
        last = np.minimum.accumulate(now - along) + along
    return int(last[-1])


def profile_of(values: list[tuple[list[str], float, int]]) -> list[dict]:
    """The profile of (tokens, weight, seq), the heavier aligned first, then the smaller seq."""
    profile, total = [], 0.0
    for tokens, weight, _ in sorted(values, key=lambda v: (-v[1], v[2])):
        profile, total = align(profile, total, tokens, weight), total + weight
    return profile


def vote_of(profile: list[dict]) -> list[str]:
    """The heaviest token of each column, ties to the greater one; none where gaps are heaviest."""
    return [t for col in profile if (t := max(col.items(), key=lambda x: (x[1], x[0]))[0])]


def consensus(values: list[tuple[str, float, int]]) -> int:
    """The seq of the (text, weight, seq) closest to the weighted column vote; ties to the heavier, then the smaller seq."""
    read = [(tokens_of(text), weight, seq) for text, weight, seq in values]
    vote = vote_of(profile_of(read))
    return min((distance(tokens, vote), -weight, seq) for tokens, weight, seq in read)[2]


def consensus_text(nodes: DataFrame, field: str = "summary", max_tokens: int = 8192) -> DataFrame:
    """Rows (group_seq, from_seq, value): for every group of :func:`survivors` the existing ``field`` value nearest to the
    token consensus of the group, whose equal values are added up first and weigh what their records do (confidence, a half
    where unusable).

    Groups of any size and values of any length are handled alike, as :func:`consensus` does: all values of a group are
    aligned, the heaviest first, to a profile, the only thing held as they stream by in order; then the distance of each value
    from the vote is taken apart from the others, and the nearest found by a minimum over the group. One alignment has at
    most ``max_tokens`` squared places, a byte each, in memory; this changes no result.
    """
    text = visible(F.col(field))
    conf = F.col("confidence").cast("double")
    rows = nodes.select(
        F.col("session_id").alias("_session"),
        F.col("type").alias("_type"),
        label_key(F.col("label")).alias("_key"),
        F.col("seq").cast("long").alias("_seq"),
        text.alias("_text"),
        F.when((conf >= 0) & (conf <= 1), conf + 0.01).otherwise(0.5).alias("_w"),
    ).where("_key is not null and _session is not null and _type is not null and _seq is not null")
    keys = ["_session", "_type", "_key"]
    groups = rows.groupBy(*keys).agg(F.min("_seq").alias("_group"), F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    values = (
        rows.where(says_something(F.col("_text")))
        .groupBy(*keys, "_text")
        # rounded, so that the order of a sum doesn't decide which value is heavier
        .agg(F.round(F.sum("_w"), 9).alias("_w"), F.min("_seq").alias("_seq"))
        .join(groups.drop("_n"), keys)
        .select("_group", "_text", "_w", "_seq")
    )
    values = cut(values, "values")
    votes = cut(_votes(values, max_tokens * max_tokens), "votes")

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a value without others needs no vote
            pdf["d"] = [0 if v is None else distance(tokens_of(t), list(v)) for t, v in zip(pdf["_text"], pdf["vote"])]
            yield pdf[["_group", "_text", "_w", "_seq", "d"]]

    apart = values.join(votes, "_group", "left").mapInPandas(far, "_group long, _text string, _w double, _seq long, d long")
    best = apart.groupBy("_group").agg(F.min_by(F.struct("_seq", "_text"), F.struct("d", (-F.col("_w")).alias("w"), "_seq")).alias("b"))
    return best.select(F.col("_group").alias("group_seq"), F.col("b._seq").alias("from_seq"), F.col("b._text").alias("value"))


def _votes(values: DataFrame, places: int) -> DataFrame:
    """(_group, vote): the vote of each group of two or more values (_group, _text, _w, _seq), aligned as they stream by."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, n, profile, total = None, 0, [], 0.0  # of the group that may go on in the next batch
        for pdf in batches:
            out = []
            for g, text, w in zip(pdf["_group"].tolist(), pdf["_text"], pdf["_w"].tolist()):
                if g != group:
                    if n > 1:
                        out.append((group, vote_of(profile)))
                    group, n, profile, total = g, 0, [], 0.0
                profile, total, n = align(profile, total, tokens_of(text), w, places), total + w, n + 1
            yield pd.DataFrame(out, columns=["_group", "vote"])
        if n > 1:
            yield pd.DataFrame([(group, vote_of(profile))], columns=["_group", "vote"])

    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = values.select("_group", "_text", "_w", "_seq").repartition(tasks, "_group").sortWithinPartitions("_group", F.desc("_w"), "_seq")
    return ordered.mapInPandas(fold, "_group long, vote array<string>")


def agreement(nodes: DataFrame) -> DataFrame:
    """One row (groups, equal, same_text): in how many groups with a usable summary the consensus picks the record the field rule picks,
    and in how many a record with the same text."""
    rule = survivors(nodes).where("summary is not null").select("group_seq", "summary", "summary_from")
    both = rule.join(consensus_text(nodes), "group_seq")
    return both.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("summary_from") == F.col("from_seq")).alias("equal"), F.count_if(F.col("summary") == F.col("value")).alias("same_text")
    )
