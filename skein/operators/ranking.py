"""Ranks and running sums inside groups that may be far larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucketed_running(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], rank: str | None = None, sums: dict[str, str] | None = None
) -> DataFrame:
    """Rank (from 0) and inclusive running sums within ``keys``, in the order (bucket, *order).

    ``bucket`` must be a non-null column of ``df`` that splits every group into runs of bounded size and that agrees with
    the wanted order (all rows of bucket b come before those of b+1). Rows move once, hashed by (keys, bucket); the totals
    of the runs, a few numbers each, are summed up separately and joined back on the same hash, so a group holding most of
    the rows still spreads over all tasks. ``sums`` maps new column names to columns to sum up. Keys must not be null.
    """
    sums = sums or {}
    base = df.repartition(*keys, bucket)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = base
    if rank:
        local = local.withColumn(rank, F.row_number().over(inner).cast("long") - 1)
    for name, col in sums.items():
        local = local.withColumn(name, F.sum(col).over(upto))
    totals = base.groupBy(*keys, bucket).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    zero: Column = F.lit(0)
    offsets = totals.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_n").over(before), zero).alias("_o_rank"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), zero).alias(f"_o_{n}") for n in sums],
    )
    out = local.join(offsets, [*keys, bucket])
    if rank:
        out = out.withColumn(rank, F.col(rank) + F.col("_o_rank"))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    return out.drop("_o_rank", *[f"_o_{n}" for n in sums])
