"""Connected components of graphs too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (id, component): every endpoint of ``edges`` with the smallest id it is connected to.

    Alternating rounds hang each vertex's larger and then smaller neighbours onto the smallest one, until every component is
    a star; that takes about the logarithm of the longest path in rounds. Edges only shrink in number, no neighbourhood is
    ever collected, and each round is cut off in the shared folder. Null endpoints are ignored; a self-loop makes its vertex
    a component of its own. Ids must be comparable.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    vertices = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        # large star: neighbours larger than u go to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and u itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small, "cc")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    return vertices.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
