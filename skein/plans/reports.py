"""The focus view around a query and the digest by communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import rules
from skein.operators import graph, views
from skein.operators.ranking import bucketed_running
from skein.schema import DIGEST_ACTIVE, NODE_STATUSES, NODE_TYPES


def _order(values: list[str], col: str):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]), F.col(col)), F.lit(99))


def focus(nodes: DataFrame, edges: DataFrame, query: str = "", seeds: int = 5, hops: int = 1, most: int = 15) -> tuple[DataFrame, DataFrame]:
    """(members, relationships) of each session's focus.

    members (session_id, seq, id, type, status, label, hop): the nodes nearest to the query (without one, the most confident),
    what is within ``hops`` links of them, nearest first and at most ``most``, seeds always; relationships (session_id,
    from_id, to_id, relation, rank): the first 20 edges between members.
    """
    start = graph.search(nodes, query, seeds) if query.strip() else graph.top_confidence(nodes, seeds)
    start = start.where("id is not null").select("session_id", "id").distinct()
    near = graph.neighbourhood(nodes, edges, start, hops)
    by = Window.partitionBy("session_id").orderBy("hop", "seq")
    own = nodes.join(near, ["session_id", "id"]).select("session_id", "seq", "id", "type", "status", "label", "hop")
    # seeds come first, so the literal bound, which is pruned before the shuffle, loses none
    members = own.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= max(most, seeds)).where((F.col("_r") <= most) | (F.col("hop") == 0)).drop("_r")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    inside = graph.within(edges, graph.node_ids(members)).withColumn("rank", rank).where("rank <= 20")
    return members, inside.select("session_id", "from_id", "to_id", "relation", "rank")


def clusters(nodes: DataFrame, members: DataFrame, most: int = 8, least: int = 2) -> DataFrame:
    """(session_id, community, rank, seq, type, label, n_nodes): of each community with at least ``least`` nodes the first by
    type order and confidence. members: (session_id, id, community)."""
    own = nodes.join(members, ["session_id", "id"])
    n = own.groupBy("session_id", "community").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") >= least)
    sure = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(-1e9))
    by = Window.partitionBy("session_id", "community").orderBy(_order(rules.TYPE_ORDER_CLUSTER, "type"), F.desc(sure), "seq")
    return own.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).join(n, ["session_id", "community"]).select(
        "session_id", "community", "rank", "seq", "type", "label", "n_nodes"
    )


def open_ends(nodes: DataFrame) -> DataFrame:
    """Rows (session_id, part, seq, line): a line for every deferred node (part 3) and every open question (part 4)."""
    icon = rules.lookup(rules.ICONS, F.col("type"), "•")
    label = F.coalesce("label", F.lit(""))
    said = lambda sign: F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(sign), "summary")).otherwise("")
    late = F.when(F.col("status") == "deferred", F.struct(F.lit(3).alias("part"), F.concat(F.lit("- [ ] "), icon, F.lit(" **"), label, F.lit("**"), said(" — ")).alias("line")))
    asked = F.when(
        (F.col("type") == "question") & F.col("status").isin(DIGEST_ACTIVE), F.struct(F.lit(4).alias("part"), F.concat(F.lit("- ❓ **"), label, F.lit("**"), said(": ")).alias("line"))
    )
    return nodes.select("session_id", "seq", F.explode(F.array_compact(F.array(late, asked))).alias("x")).select("session_id", "x.part", "seq", "x.line")


def digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (session_id, part, place, seq, line), in this order the digest of each session: 1 its counts, 2 its communities, larger
    ones first, 3 the deferred nodes, 4 the open questions. Lines, not one text: a session may have any number of them."""
    icon = rules.lookup(rules.ICONS, F.col("type"), "•")
    none, text = F.lit(None).cast("long"), lambda c: F.col(c).cast("string")
    stats = views.digest_stats(nodes)
    counts = [F.struct(F.array(F.lit(i)).alias("place"), F.concat(F.lit(f"- {c.replace('_', ' ')}: "), text(c)).alias("line")) for i, c in enumerate(stats.columns[1:], 1)]
    head = [F.struct(F.array(F.lit(0)).alias("place"), F.concat(F.lit("## Session digest: "), "session_id").alias("line")), *counts]
    first = stats.select("session_id", F.explode(F.array(*head)).alias("x")).select("session_id", F.lit(1).alias("part"), F.transform("x.place", lambda i: i.cast("string")).alias("place"), none.alias("seq"), "x.line")
    top = clusters(nodes, graph.communities(nodes, edges))
    size = F.lpad((F.lit(10**12) - F.col("n_nodes")).cast("string"), 13, "0")
    place = lambda r: F.array(size, "community", F.lpad(r, 3, "0"))
    entry = F.concat(F.lit("- "), icon, F.lit(" **"), F.coalesce("label", F.lit("")), F.lit("**"))
    name = F.concat(F.lit("### "), F.coalesce("label", F.lit("")), F.lit(" ("), text("n_nodes"), F.lit(" nodes)"))
    lines = F.array_compact(F.array(F.when(F.col("rank") == 1, F.struct(place(F.lit("0")).alias("place"), name.alias("line"))), F.struct(place(text("rank")).alias("place"), entry.alias("line"))))
    second = top.select("session_id", "seq", F.explode(lines).alias("x")).select("session_id", F.lit(2).alias("part"), "x.place", "seq", "x.line")
    rest = open_ends(nodes).select("session_id", "part", F.array(F.lpad(text("seq"), 20, "0")).alias("place"), "seq", "line")
    return first.unionByName(second).unionByName(rest)


def grid(nodes: DataFrame) -> DataFrame:
    """(session_id, place, seq): nodes of a session in the order of the grid: by type, by status, by seq."""
    kind = _order(NODE_TYPES, "type") * 100 + _order(NODE_STATUSES, "status")
    # runs in this order: type and status, then stretches of seq
    run = kind.cast("long") * F.lit(1 << 40) + F.floor(F.col("seq") / 8192)
    placed = bucketed_running(nodes.select(F.coalesce("session_id", F.lit("\0")).alias("_s"), "session_id", "seq", run.alias("_run")), ["_s"], "_run", ["seq"], rank="place")
    return placed.select("session_id", (F.col("place") + 1).cast("int").alias("place"), "seq")
