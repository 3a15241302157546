"""Graph operators over (nodes, edges) pairs; every one works on all sessions at once, keyed by session_id."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import search_tokens
from skein.operators.merge import endpoints
from skein.session import cut


def node_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where("id is not null and session_id is not null").select("session_id", "id").distinct()


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both endpoints among (session_id, id)."""
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.select("session_id", F.col("id").alias(end)), ["session_id", end], "left_semi")
    return edges


def build(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(session_id, src, dst, relation, weight): dangling edges dropped, parallel ones collapsed into the last by seq."""
    real = within(edges, node_ids(nodes))
    src, dst = ("from_id", "to_id") if directed else (F.least("from_id", "to_id"), F.greatest("from_id", "to_id"))
    keyed = real.select("session_id", F.col(src).alias("src") if directed else src.alias("src"), F.col(dst).alias("dst") if directed else dst.alias("dst"), "relation", "weight", "seq")
    return keyed.groupBy("session_id", "src", "dst").agg(F.max_by(F.struct("relation", "weight"), "seq").alias("e")).select("session_id", "src", "dst", "e.*")


def links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct undirected links both ways: (session_id, a, b)."""
    real = within(edges, node_ids(nodes)).where("from_id <> to_id").select("session_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return real.unionByName(real.select("session_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, id, n_edges): edge ends at each node that has any; a self-loop counts twice."""
    ends = edges.select("session_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.join(node_ids(nodes), ["session_id", "id"], "left_semi").groupBy("session_id", "id").agg(F.count(F.lit(1)).alias("n_edges"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1, most: int | None = None) -> DataFrame:
    """(session_id, id, hop): what is within ``hops`` links of the seeds (session_id, id), with the fewest links it takes; of each
    session at most ``most``, where given, nearer ones first, then by id."""
    pairs = cut(links(nodes, edges), "links")
    seen = seeds.join(node_ids(nodes), ["session_id", "id"], "left_semi").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = front.select("session_id", F.col("id").alias("a")).join(pairs, ["session_id", "a"]).select("session_id", F.col("b").alias("id")).distinct()
        front = cut(step.join(seen, ["session_id", "id"], "left_anti").withColumn("hop", F.lit(hop)), "front")
        seen = seen.unionByName(front)
    if most is None:
        return seen
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("hop", "id"))
    return seen.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def shortest_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(session_id, source, target, hops, path): of each (session_id, source, target) the shortest path, ids joined by >, of
    equal ones the least; hops and path are null where there is none (of up to ``most`` links, where given). All searches
    advance together, a level a round, and end when none has a way to go."""
    near = cut(links(nodes, edges), "links")
    asked = pairs.select("session_id", "source", "target").distinct()
    front = asked.withColumn("at", F.col("source")).withColumn("path", F.col("source"))
    front = front.join(node_ids(nodes).withColumnRenamed("id", "at"), ["session_id", "at"], "left_semi")
    seen = front.select("session_id", "source", "target", "at")
    found = front.where("source = target").select("session_id", "source", "target", F.lit(0).alias("hops"), "path")
    key = ["session_id", "source", "target"]
    for hop in count(1) if most is None else range(1, most + 1):
        step = front.where("at <> target").withColumnRenamed("at", "a").join(near, ["session_id", "a"])
        step = step.groupBy(*key, F.col("b").alias("at")).agg(F.min(F.concat("path", F.lit(">"), "b")).alias("path"))
        front = cut(step.join(seen, [*key, "at"], "left_anti").join(found.select(*key), key, "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select(*key, "at"))
        found = found.unionByName(front.where("at = target").select(*key, F.lit(hop).alias("hops"), "path"))
        if hop % 16 == 0:  # so that plans of long searches stay small
            seen, found = cut(seen, "seen"), cut(found, "found")
    return asked.join(found, key, "left")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(session_id, id, community): every node of a session with its community, named by an id in it.

    Weighted label propagation: a node takes the label its neighbours give most weight to, its own counting half a link, ties to
    the least label. In each round one half of the nodes moves, the other half in the next, so labels can't swing between two;
    it ends when neither half moves any more (or after ``rounds``). Nodes without links stay alone. Weights that are null or
    not positive count as a small positive one.
    """
    real = within(edges, node_ids(nodes)).where("from_id <> to_id")
    w = F.when(F.col("weight") > 0, F.least("weight", F.lit(1.0))).otherwise(0.01)
    one = real.select("session_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"), w.alias("w"))
    both = one.unionByName(one.select("session_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    near = cut(both.groupBy("session_id", "a", "b").agg(F.sum("w").alias("w")), "near")
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    labels = cut(node_ids(nodes).select("session_id", "id", F.col("id").alias("label"), half.alias("half"), F.lit(False).alias("moved")), "labels")
    still = 0
    for turn in range(rounds):
        heard = near.join(labels.select("session_id", F.col("id").alias("b"), "label"), ["session_id", "b"]).select("session_id", F.col("a").alias("id"), "label", "w")
        own = labels.where(F.col("half") == turn % 2).select("session_id", "id", "label", F.lit(0.5).alias("w"))
        heard = heard.where(F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2)
        votes = heard.unionByName(own).groupBy("session_id", "id", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        top = votes.groupBy("session_id", "id").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("new"))
        step = labels.join(top, ["session_id", "id"], "left").select(
            "session_id", "id", F.coalesce("new", "label").alias("label"), "half", F.coalesce(F.col("new") != F.col("label"), F.lit(False)).alias("moved")
        )
        labels = cut(step, "labels")
        still = 0 if not labels.where("moved").isEmpty() else still + 1
        if still == 2:
            break
    return labels.select("session_id", "id", F.col("label").alias("community"))


def modularity(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(session_id, modularity): of each session with links, how much more of their number lies inside the communities of
    members (session_id, id, community) than by chance."""
    real = build(nodes, edges, directed=False).where("src <> dst").select("session_id", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("l"))
    of = members.select("session_id", "id", "community")
    ends = real.select("session_id", F.col("l.src").alias("id"), "l.dst").join(of, ["session_id", "id"])
    ends = ends.join(of.select("session_id", F.col("id").alias("dst"), F.col("community").alias("other")), ["session_id", "dst"])
    own = ends.groupBy("session_id", "community").agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("community") == F.col("other")).alias("i"))
    whole = own.groupBy("session_id").agg(F.sum("d").alias("m"))
    share = own.join(whole, "session_id").select("session_id", (F.col("i") / F.col("m") - F.pow(F.col("d") / F.col("m"), F.lit(2))).alias("q"))
    return share.groupBy("session_id").agg(F.sum("q").alias("modularity"))


def search(nodes: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(session_id, seq, id, score, rank): of each session the ``most`` nodes whose words are most like the query's, weighed by
    confidence; only nodes with a score above 0; ties to the smallest seq."""
    import re

    asked = F.array(*[F.lit(t) for t in dict.fromkeys(re.findall("[a-z0-9]+", query.lower()))]).cast("array<string>")
    own = search_tokens(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("summary", F.lit(""))))
    like = F.size(F.array_intersect(own, asked)) / F.size(F.array_union(own, asked))
    scored = nodes.select("session_id", "seq", "id", F.round(like * F.col("confidence"), 6).alias("score")).where("score > 0 and not isnan(score)")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "seq"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def top_confidence(nodes: DataFrame, most: int = 5) -> DataFrame:
    """(session_id, seq, id, rank): the most confident nodes of each session; null and NaN come last, ties by seq."""
    c = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(-1e9))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("c"), "seq"))
    return nodes.select("session_id", "seq", "id", c.alias("c")).withColumn("rank", rank).where(F.col("rank") <= most).drop("c")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with at least one edge."""
    return nodes.join(endpoints(edges), ["session_id", "id"], "left_semi")
