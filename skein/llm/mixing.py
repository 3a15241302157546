"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.ranking import bucketed_running

#: Rows a run of a sort holds on average, at most.
RUN_ROWS = 100_000
#: Targets a mix may have; their table is small by its nature, which is checked, and is sent to every executor.
TARGETS = 10_000


def source_key(col: str) -> F.Column:
    """A source's name without case and outer white space; null stays null."""
    return F.lower(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", ""))


def virtual_end(capped: list[tuple[float, float]], budget: float) -> float | None:
    """The virtual time at which sources (weight, size with all repeats) have together given ``budget``; None if never."""
    ends = sorted((cap / w, w, cap) for w, cap in capped if w > 0 and cap > 0)
    done, rate, at = 0.0, sum(w for _, w, _ in ends), 0.0
    for end, w, _ in ends:
        if done + rate * (end - at) >= budget:
            return at + (budget - done) / rate
        done, at, rate = done + rate * (end - at), end, rate - w
    return None


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(members, report) of a mix as large as all documents with a source together.

    members: (doc_id, source, copy_no, tokens, finish, upto), one row per document and repetition. Every source's documents
    are shuffled by a hash of doc_id and ``seed``; a document's virtual finish time is the source's tokens up to it (earlier
    repetitions included) over the target share; all are sorted by it over the whole mix, and the mix ends where the budget
    is used up. report: (source, target_share, max_repeat, source_tokens, available, mix_tokens, share, unreachable), one
    row per target; unreachable where the source, used up, stays below its share of the budget.

    Sizes are UTF-8 bytes; null and empty texts weigh nothing and are not drawn. Sources compare without case and outer
    white space; null is no source, and sources without a target count for the budget only. Of targets with one name the
    first by share counts. Equal finish times are ordered by source, doc_id and copy. A null or non-positive share or repeat
    draws nothing. Both sorts run over hash or time runs of bounded size with prefix sums, so a source with most of the
    rows spreads over all tasks; what reaches the driver is one row per target.
    """
    spark = docs.sparkSession
    want = (
        targets.select(
            F.col("source").alias("_name"),
            source_key("source").alias("_src"),
            F.col("target_share").cast("double").alias("_w"),
            F.col("max_repeat").cast("long").alias("_rep"),
        )
        .where("_src is not null")
        .groupBy("_src")
        .agg(F.max(F.struct("_w", "_rep", "_name")).alias("_t"))
        .select("_src", "_t.*")
    )
    asked = want.limit(TARGETS + 1).collect()
    if len(asked) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    sizes = docs.select(
        F.col("doc_id").alias("_id"), source_key("source").alias("_src"), F.octet_length("text").cast("long").alias("_size")
    ).where("_src is not null and _size > 0")
    found = (
        sizes.groupBy("_src")
        .agg(F.sum("_size").alias("_total"), F.max("_size").alias("_longest"), F.count(F.lit(1)).alias("_n"))
        .join(F.broadcast(want), "_src", "left")
        .groupBy(F.when(F.col("_name").isNotNull(), F.col("_src")).alias("_src"))
        .agg(F.sum("_total").alias("_total"), F.max("_longest").alias("_longest"), F.sum("_n").alias("_n"))
        .collect()
    )
    budget = sum(int(r["_total"]) for r in found)
    # runs of bounded size, a power of two of them, and enough for all tasks
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, math.ceil(math.log2(max(tasks, sum(int(r["_n"]) for r in found) / RUN_ROWS))))
    size_of = {r["_src"]: (int(r["_total"]), int(r["_longest"])) for r in found if r["_src"] is not None}
    plan, slack = [], 0.0
    for r in asked:
        w, rep = float(r["_w"] or 0.0), max(0, int(r["_rep"] or 0))
        total, longest = size_of.get(r["_src"], (0, 0))
        plan.append((r["_src"], r["_name"], w, rep, total, total * rep))
        if w > 0:
            slack = max(slack, longest / w)  # a document's longest virtual time
    end = virtual_end([(p[2], p[5]) for p in plan], budget)
    if end is not None:  # repetitions that can begin before the end; more are never drawn
        plan = [(*p[:3], min(p[3], int((end * (1 + 1e-9) + slack) * p[2] / p[4]) + 1) if p[4] else 0, *p[4:], p[3]) for p in plan]
    else:
        plan = [(*p, p[3]) for p in plan]
    plan_df = spark.createDataFrame(
        plan, "_src string, _name string, _w double, _rep long, _total long, _cap long, _most long"
    )
    drawn = F.broadcast(plan_df.where("_w > 0 and _rep > 0"))
    shuffled = sizes.join(drawn, "_src").withColumn("_h", F.xxhash64("_id", F.lit(seed)))
    shuffled = shuffled.withColumn("_run", F.expr(f"shiftrightunsigned(_h, {64 - bits})"))
    queued = bucketed_running(shuffled, ["_src"], "_run", ["_h", "_id", "_size"], sums={"_cum": "_size"})
    copies = queued.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rep"))))
    copies = copies.withColumn("finish", ((F.col("copy_no") - 1) * F.col("_total") + F.col("_cum")) / F.col("_w"))
    if end is not None:
        # past the end of the fluid schedule each source has at most one document in flight
        copies = copies.where(F.col("finish") <= F.lit(end * (1 + 1e-9) + slack))
    horizon = max(1e-9, end if end is not None else max((p[5] / p[2] for p in plan if p[2] > 0), default=1.0))
    slices = copies.withColumn("_slice", F.floor(F.least(F.col("finish") / F.lit(horizon), F.lit(4.0)) * (1 << bits)).cast("long"))
    slices = slices.withColumn("_all", F.lit(1))
    timed = bucketed_running(slices, ["_all"], "_slice", ["finish", "_src", "_id", "copy_no", "_size"], sums={"upto": "_size"})
    members = timed.where(F.col("upto") <= budget).select(
        F.col("_id").alias("doc_id"), F.col("_name").alias("source"), "_src", "copy_no", F.col("_size").alias("tokens"), "finish", "upto"
    )
    taken = members.groupBy("_src").agg(F.sum("tokens").alias("_taken"))
    report = (
        plan_df.join(taken, "_src", "left")
        .withColumn("_mix", F.sum("_taken").over(Window.partitionBy(F.lit(1))))
        .select(
            F.col("_name").alias("source"),
            F.col("_w").alias("target_share"),
            F.col("_most").alias("max_repeat"),
            F.col("_total").alias("source_tokens"),
            F.col("_cap").alias("available"),
            F.coalesce("_taken", F.lit(0)).alias("mix_tokens"),
            F.when(F.col("_mix") > 0, F.coalesce("_taken", F.lit(0)) / F.col("_mix")).alias("share"),
            (
                (F.coalesce("_taken", F.lit(0)) == F.col("_cap")) & (F.col("_cap") < F.col("_w") * F.lit(float(budget)))
            ).alias("unreachable"),
        )
    )
    return members.drop("_src"), report

