"""Rebuilding conversations from message rows, and from overlapping fragments, joined by what they share.

Fragments, such as the exports of several days, are assembled by :func:`overlap_edges` and :func:`merge_paths`. Single message
rows with positions hold no overlaps to join by (:func:`delivery_report` counts them), so :func:`conversations` orders them by
position, in fragments that many tasks can order apart, and joins neighbours where speakers go on as they must.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.representative import INVISIBLE
from skein.session import cut


def speaker(col: Column) -> Column:
    """'user' or 'assistant' for the ways a speaker or a message type is written; null for everything else."""
    bare = F.regexp_replace(F.lower(col), r"[^a-z]", "")
    return (
        F.when(bare.isin("user", "human", "usermessage", "humanmessage"), F.lit("user"))
        .when(bare.isin("assistant", "ai", "assistantmessage", "aimessage"), F.lit("assistant"))
    )


def instant(col: Column) -> Column:
    """Microseconds since 1970 of a written time: ISO with or without zone (then UTC), or digits alone as milliseconds."""
    text = F.trim(col)
    digits = text.rlike(r"^\d{1,15}$")
    zoned = text.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.concat(text, F.when(zoned, "").otherwise("Z")))
    stamp = F.unix_micros(iso.try_cast("timestamp"))
    return F.when(digits, text.try_cast("bigint") * 1000).otherwise(stamp)


def message_rows(copilot: DataFrame, export: DataFrame) -> DataFrame:
    """Both sources as (src, conv_key, message_id, role, pos, load_ts, row_id, seen): one row per row said by a user or an
    assistant, pos null where the place is lost, seen false where the text shows nothing."""

    def rows(df: DataFrame, src: str, conv: str, mid: str, role: str, pos: Column, text: str) -> DataFrame:
        return df.select(
            F.lit(src).alias("src"),
            F.when(F.trim(F.col(conv)) != "", F.col(conv)).alias("conv_key"),
            F.when(F.trim(F.col(mid)) != "", F.col(mid)).alias("message_id"),
            speaker(F.col(role)).alias("role"),
            pos.alias("pos"),
            F.col("load_ts").alias("load_ts"),
            F.col("row_id").cast("long").alias("row_id"),
            F.coalesce(F.col(text).rlike(f"[^{INVISIBLE}]"), F.lit(False)).alias("seen"),
        ).where("role is not null")

    return rows(copilot, "copilot_session", "sessionid", "messageid", "type", F.col("line_no").cast("long"), "content").unionByName(
        rows(export, "claude_export", "conv_uuid", "uuid", "sender", instant(F.col("created_at")), "text")
    )


def first_loaded(rows: DataFrame) -> DataFrame:
    """Of the rows with one message id, the first loaded (ties: the smallest row_id); rows without an id stand alone."""
    key = F.coalesce(F.concat(F.lit("m"), "message_id"), F.concat(F.lit("r"), F.col("row_id").cast("string")))
    entry = F.struct(
        F.coalesce(F.unix_micros("load_ts"), F.lit(2**62)).alias("l"), "row_id", "conv_key", "role", "pos", "seen"
    )
    return (
        rows.withColumn("_key", key)
        .groupBy("src", "_key")
        .agg(F.min(entry).alias("e"))
        .select("src", F.xxhash64("src", "_key").alias("msg"), "e.row_id", "e.conv_key", "e.role", "e.pos", "e.seen")
    )


#: Fragments a large conversation is cut into.
PARTS = 256


def fragmented(messages: DataFrame, target: int) -> DataFrame:
    """The messages (src, conv_key, pos, ...) with a fragment number ``frag``, in order of their positions.

    Conversations of up to ``target`` messages are one fragment. Larger ones are cut at PARTS quantiles of their positions, from
    mergeable sketches, so one with a third of all rows is ordered by many tasks however its positions lie. The quantiles are
    written down first, so that every reader of a lost task cuts alike. Rows without a position are in the first fragment.
    """
    conv = ["src", "conv_key"]
    large = cut(messages.groupBy(*conv).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target).select(*conv), "large")
    if large.isEmpty():
        return messages.withColumn("frag", F.lit(0).cast("long"))
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    bounds = messages.join(large, conv).groupBy(*conv).agg(F.percentile_approx("pos", shares, F.lit(20 * PARTS)).alias("_bounds"))
    known = messages.join(cut(bounds, "bounds"), conv, "left")
    below = F.size(F.filter("_bounds", lambda b: b < F.col("pos")))
    return known.withColumn("frag", F.when(F.col("_bounds").isNull() | F.col("pos").isNull(), F.lit(0)).otherwise(below).cast("long")).drop("_bounds")


#: Modulus and base of the rolling hash of overlaps.
PRIME, BASE = 2**61 - 1, 0x1B873593CC9E2D51


@F.pandas_udf(T.ArrayType(T.LongType()))
def _starts(hashes: pd.Series) -> pd.Series:
    """The rolling hashes of the prefixes of each list, of length 1 on."""

    def run(values):
        out, h = [], 0
        for x in values:
            h = (h * BASE + int(x)) % PRIME
            out.append(h)
        return out

    return hashes.map(run, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _ends(hashes: pd.Series) -> pd.Series:
    """The rolling hashes of the suffixes of each list, of length 1 on."""

    def run(values):
        out, h, power = [], 0, 1
        for x in reversed(values):
            h, power = (int(x) * power + h) % PRIME, power * BASE % PRIME
            out.append(h)
        return out

    return hashes.map(run, na_action="ignore")


def overlap_edges(fragments: DataFrame, max_overlap: int | None = None) -> DataFrame:
    """Edges (src, conv_key, a, b, k) of the overlap graph of fragments (src, conv_key, frag, hashes): the last k message
    hashes of a are the first k of b, k the longest such length (up to ``max_overlap``, where given). Found by joining the
    rolling hashes of all suffixes with those of all prefixes, one row a message on each side, never by pairs; an edge stays
    only if it is the one way out of a and into b."""
    conv = ["src", "conv_key"]
    full = fragments.where("size(hashes) > 0").withColumn("hashes", F.transform("hashes", lambda x: F.xxhash64(x)))
    suffix = full.select(*conv, F.col("frag").alias("a"), F.posexplode(_ends("hashes")).alias("k", "h"))
    prefix = full.select(*conv, F.col("frag").alias("b"), F.posexplode(_starts("hashes")).alias("k", "h"))
    found = suffix.join(prefix, [*conv, "k", "h"]).where("a <> b").withColumn("k", F.col("k") + 1)
    if max_overlap is not None:
        found = found.where(F.col("k") <= max_overlap)
    return unambiguous(found.groupBy(*conv, "a", "b").agg(F.max("k").alias("k")))


def unambiguous(edges: DataFrame) -> DataFrame:
    """The edges (src, conv_key, a, b, k) that are the only one out of a and the only one into b."""
    conv = ["src", "conv_key"]
    out = F.count(F.lit(1)).over(Window.partitionBy(*conv, "a"))
    into = F.count(F.lit(1)).over(Window.partitionBy(*conv, "b"))
    return edges.withColumn("_o", out).withColumn("_i", into).where("_o = 1 and _i = 1").drop("_o", "_i")


def merge_paths(fragments: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """Rows (src, conv_key, frag, first, offset): the fragment each path starts with and the messages before ``frag`` in it.

    fragments: (src, conv_key, frag, n), n the messages a fragment adds to the path. Pointer doubling: after r rounds every
    fragment knows the 2^r fragments before it, so a path of ``longest`` fragments takes its logarithm in rounds. Members of
    a cycle end with a null first.
    """
    conv = ["src", "conv_key"]
    back = edges.select(*conv, F.col("b").alias("frag"), F.col("a").alias("prev"))
    ends = fragments.select(*conv, "frag", "n")
    step = ends.join(back, [*conv, "frag"], "left")
    before = ends.select(*conv, F.col("frag").alias("prev"), F.col("n").alias("offset"))
    step = step.join(before, [*conv, "prev"], "left").select(
        *conv, "frag", "prev", F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("prev", "frag").alias("far")
    )
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        step = cut(step, "paths")
        over = step.select(*conv, F.col("frag").alias("prev"), F.col("prev").alias("_p"), F.col("offset").alias("_f"), F.col("far").alias("_far"))
        step = step.join(over, [*conv, "prev"], "left").select(
            *conv,
            "frag",
            F.col("_p").alias("prev"),
            (F.col("offset") + F.coalesce("_f", F.lit(0))).alias("offset"),
            F.coalesce("_far", "far").alias("far"),
        )
    return step.select(*conv, "frag", F.when(F.col("prev").isNull(), F.col("far")).alias("first"), "offset")


def conversations(copilot: DataFrame, export: DataFrame, target: int = 2048) -> DataFrame:
    """Rows (src, conv_key, msg_no, row_id, role): the messages of all whole conversations, numbered from 1.

    Only rows of users and assistants count; of rows with one message id the first loaded; texts that show nothing and rows
    without a conversation are set aside. Kept are conversations whose messages all have a position, that begin with a user and
    have an assistant's message right after every user's. Messages at one position are ordered by row_id. Large conversations
    are ordered in fragments; of each only its length, its first and last speaker and whether it is sound inside go on, and
    the fragments of a conversation, PARTS at most, are joined by these. Empty tables give no rows.
    """
    conv = ["src", "conv_key"]
    messages = first_loaded(message_rows(copilot, export)).where("seen and conv_key is not null")
    whole = cut(messages.select(*conv, "pos", "row_id", "role"), "messages")
    order = Window.partitionBy(*conv, "frag").orderBy("pos", "row_id")
    placed = fragmented(whole, target).select(
        *conv, "frag", "row_id", "role", F.col("pos").isNull().alias("_lost"), F.row_number().over(order).alias("at"), F.lag("role").over(order).alias("_before")
    )
    unanswered = (F.col("role") == "user") & F.coalesce(F.col("_before") == "user", F.lit(False))
    frags = placed.groupBy(*conv, "frag").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("role", "at").alias("head"),
        F.max_by("role", "at").alias("tail"),
        F.max(F.col("_lost") | unanswered).alias("bad"),
    )
    line = Window.partitionBy(*conv).orderBy("frag")
    frags = frags.select(
        *conv,
        "frag",
        "bad",
        (F.sum("n").over(line) - F.col("n")).alias("offset"),
        F.when(F.lead("frag").over(line).isNull(), F.col("tail") == "user").otherwise(False).alias("open"),
        # before the first message, as after a question, an answer can't stand or a question can't
        F.when(F.lag("frag").over(line).isNull(), F.col("head") != "user").otherwise((F.lag("tail").over(line) == "user") & (F.col("head") == "user")).alias("gap"),
    )
    broken = F.max(F.col("bad") | F.col("open") | F.col("gap")).over(Window.partitionBy(*conv))
    good = frags.withColumn("broken", broken).where("not broken").select(*conv, "frag", "offset")
    return placed.join(good, [*conv, "frag"]).select(*conv, (F.col("offset") + F.col("at")).cast("long").alias("msg_no"), "row_id", "role")


def deliveries(rows: DataFrame) -> DataFrame:
    """Fragments (src, conv_key, frag, hashes): what was loaded of a conversation on one day, by position, from rows of
    :func:`message_rows`, repeated deliveries included; one fragment a day, however large the conversation or the day."""
    key = F.xxhash64("src", F.coalesce(F.concat(F.lit("m"), "message_id"), F.concat(F.lit("r"), F.col("row_id").cast("string"))))
    kept = rows.where("seen and conv_key is not null and pos is not null")
    kept = kept.select("src", "conv_key", "pos", "row_id", key.alias("h"), F.to_date("load_ts").alias("day"))
    own = kept.groupBy("src", "conv_key", "day").agg(F.array_sort(F.collect_list(F.struct("pos", "row_id", "h"))).alias("m"))
    return own.select("src", "conv_key", F.xxhash64("day").alias("frag"), F.array_distinct(F.transform("m", lambda x: x["h"])).alias("hashes"))


def assembled(fragments: DataFrame) -> DataFrame:
    """Rows (src, conv_key, fragments, edges, whole): for each conversation of fragments (src, conv_key, frag, hashes) how many it has,
    how many unambiguous overlaps join them, and whether these make one path without a gap."""
    conv = ["src", "conv_key"]
    fragments = cut(fragments, "fragments")
    edges = cut(overlap_edges(fragments), "edges")
    counts = fragments.groupBy(*conv).agg(F.count(F.lit(1)).alias("fragments"))
    most = counts.agg(F.max("fragments").alias("m")).first()["m"] or 0
    paths = merge_paths(fragments.select(*conv, "frag", F.size("hashes").alias("n")), edges, most)
    made = paths.groupBy(*conv).agg(F.count_distinct("first").alias("paths"), F.count(F.when(F.col("first").isNull(), 1)).alias("cyclic"))
    joined = edges.groupBy(*conv).agg(F.count(F.lit(1)).alias("edges"))
    return counts.join(made, conv).join(joined, conv, "left").select(
        *conv, "fragments", F.coalesce("edges", F.lit(0)).alias("edges"), ((F.col("paths") == 1) & (F.col("cyclic") == 0)).alias("whole")
    )


def delivery_report(copilot: DataFrame, export: DataFrame) -> DataFrame:
    """Rows (src, conversations, several, fragments, edges, joined): how many conversations came in several deliveries (one a day),
    the overlaps between them, and the conversations of several deliveries that overlaps alone make whole."""
    each = assembled(deliveries(message_rows(copilot, export)))
    many = F.col("fragments") > 1
    return each.groupBy("src").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.count(F.when(many, 1)).alias("several"),
        F.sum(F.when(many, F.col("fragments")).otherwise(0)).alias("fragments"),
        F.sum("edges").alias("edges"),
        F.count(F.when(many & F.col("whole"), 1)).alias("joined"),
    )
