"""Filling containers of fixed capacity: a plan over the histogram of lengths, then slots by rank within length."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.ranking import bucketed_running
from skein.session import cut

#: Rows of a plan, 40 bytes each, that are sent to every executor; a longer plan is joined by shuffle.
BROADCAST_ROWS = 500_000
PLAN_SCHEMA = T.StructType(
    [
        T.StructField("tokens", T.LongType()),
        T.StructField("rank_from", T.LongType()),
        T.StructField("rank_to", T.LongType()),
        T.StructField("first_bin", T.LongType()),
        T.StructField("per_bin", T.LongType()),
    ]
)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, rank_from, rank_to, first_bin, per_bin).

    A pattern starts with the longest length left and takes, again and again, the longest length that still fits, as often
    as it fits; it is repeated while all its lengths last. Each pattern uses up a length, or leaves fewer of it than it
    takes, so there are at most two patterns a length, whatever the number of items.
    """
    left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while lengths:
        room, pattern, below = capacity, [], len(lengths)
        while room > 0 and (at := bisect_right(lengths, room, 0, below)):
            n = lengths[at - 1]
            take = min(left[n], room // n)
            pattern.append((n, take))
            room -= n * take
            below = at - 1
        times = min(left[n] // take for n, take in pattern)
        for n, take in pattern:
            rows.append((n, used[n], used[n] + times * take, bins, take))
            used[n] += times * take
            left[n] -= times * take
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
        bins += times
    return rows


def cutter(capacity: int):
    """A column function: the byte offsets at which a text is cut into pieces of at most ``capacity`` bytes, the first 0, none inside
    a character (unless it is itself larger); null for null."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def starts(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[int]:
            raw, at, out = text.encode("utf-8", "surrogatepass"), 0, [0]
            while len(raw) - at > capacity:
                to = at + capacity
                while to > at and raw[to] & 0xC0 == 0x80:
                    to -= 1
                at = to if to > at else at + capacity
                out.append(at)
            return out

        return texts.map(of, na_action="ignore")

    return starts


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, run_rows: int = 200_000) -> DataFrame:
    """Rows (id, piece_no, n_pieces, piece_start, tokens, bin_id): every document's place in containers of ``capacity``.

    Sizes are the UTF-8 bytes of the text. A document is split only if it alone exceeds the capacity; its pieces are as long as
    fits without cutting a character (piece_start is in bytes) and are placed like other items. Null and empty texts need no room: one row with tokens 0 and a
    null bin_id. Documents with equal ids are separate items if their sizes differ and may swap slots if not. The histogram
    has at most ``capacity`` rows, whatever the input, and is the only thing the driver sees; the plan joined back has at
    most 2 * capacity patterns and is only broadcast up to BROADCAST_ROWS rows. Ranks within a length are spread over runs of about ``run_rows`` rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    whole = docs.select(F.col(id_col).alias("_id"), size.alias("_size"), cutter(capacity)(F.when(size > capacity, F.col(text_col))).alias("_starts"))
    starts = F.coalesce("_starts", F.array(F.lit(0).cast("long")))
    pieces = whole.select("_id", "_size", F.size(starts).cast("long").alias("n_pieces"), F.posexplode(F.arrays_zip(starts.alias("at"), F.slice(starts, 2, F.size(starts)).alias("to"))).alias("piece_no", "p"))
    pieces = pieces.select("_id", "_size", "n_pieces", F.col("piece_no").cast("long").alias("piece_no"), F.col("p.at").alias("piece_start"), (F.coalesce("p.to", "_size") - F.col("p.at")).alias("tokens"))
    items = cut(pieces, "items")  # the texts are read once
    counts = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = max(1, -(-max(counts.values(), default=0) // run_rows))
    ranked = bucketed_running(
        items.where("tokens > 0").withColumn("_run", F.pmod(F.xxhash64("_id", "piece_no"), F.lit(runs))),
        ["tokens"],
        "_run",
        ["_id", "piece_no", "_size"],
        rank="_rank",
    )
    slots = plan_bins(counts, capacity)
    plan = spark.createDataFrame(slots, PLAN_SCHEMA).withColumnRenamed("tokens", "_tokens")
    placed = ranked.join(
        F.broadcast(plan) if len(slots) <= BROADCAST_ROWS else plan,
        (F.col("tokens") == F.col("_tokens")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")),
    ).withColumn("bin_id", F.expr("first_bin + (_rank - rank_from) div per_bin"))
    cols = [F.col("_id").alias(id_col), "piece_no", "n_pieces", "piece_start", "tokens"]
    empty = items.where("tokens = 0").select(*cols, F.lit(None).cast("long").alias("bin_id"))
    return placed.select(*cols, "bin_id").unionByName(empty)


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """Rows (used, containers): how many containers hold how many tokens; at most ``capacity`` rows."""
    per = packed.where("bin_id is not null").groupBy("bin_id").agg(F.sum("tokens").alias("used"))
    return per.groupBy("used").agg(F.count(F.lit(1)).alias("containers")).withColumn("unused", F.lit(capacity) - F.col("used"))


def soundness(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row (items, tokens, over, containers, least): what was packed, the containers above the capacity (none), those used and the
    fewest that any packing needs: the tokens over the capacity, or the items of more than half of it."""
    items = packed.where("bin_id is not null")
    bins = items.groupBy("bin_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("tokens") * 2 > capacity).alias("large"))
    return bins.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("used") > capacity).alias("over"),
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.greatest(F.ceil(F.sum("used") / F.lit(capacity)), F.sum("large")), F.lit(0)).alias("least"),
    )
