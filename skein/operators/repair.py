"""Repair passes over a session's graph: each is a function of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import rules
from skein.functions.extract import push_status
from skein.functions.text import label_tokens
from skein.operators.merge import endpoints, nearest, orphans
from skein.operators.ranking import bucketed_running
from skein.schema import REMEDIATE_SKIP


def remediate(nodes: DataFrame, threshold: float = 0.5, at: str | None = None) -> DataFrame:
    """Nodes with unsettled nodes of less than ``threshold`` confidence made unconfirmed, their old status in the history."""
    weak = (F.col("confidence") < threshold) & ~F.col("status").isin(REMEDIATE_SKIP)
    note = F.format_string(f"Remediated: confidence %.2f < threshold {threshold:.2f}", F.col("confidence"))
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    return nodes.withColumn(
        "status_history", F.when(weak, push_status(F.col("status_history"), F.col("status"), note, when)).otherwise(F.col("status_history"))
    ).withColumn("status", F.when(weak, "unconfirmed").otherwise(F.col("status")))


def upgrade_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with relates-to between different types replaced by the relation of the upgrade rules; others unchanged."""
    kinds = nodes.where("id is not null").groupBy("session_id", "id").agg(F.max_by("type", "seq").alias("t"))
    out = edges
    for end, name in (("from_id", "ft"), ("to_id", "tt")):
        out = out.join(kinds.select("session_id", F.col("id").alias(end), F.col("t").alias(name)), ["session_id", end], "left")
    better = F.when((F.col("relation") == "relates-to") & (F.col("ft") != F.col("tt")), rules.relation_of(rules.UPGRADES, F.col("ft"), F.col("tt")))
    return out.withColumn("relation", F.coalesce(better, "relation")).drop("ft", "tt").select(*edges.columns)


def infer_edges(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """(session_id, from_seq, to_seq, relation, weight): edges between nodes of a session that share at least two words and
    aren't linked either way, the first ``most`` of each session in the order of the pairs' seqs.

    Nodes meet in groups by two common words, not by one. In a group of m only those pairs can be among the first that have
    fewer than ``most`` plus the group's linked pairs before them in their own group, so few groups are paired in full. Ids
    may stand in several rows: an edge links every row of one id with every row of the other. Places in a group are counted over
    stretches of seq with prefix sums, so one word pair of a hot session isn't one task's work.
    """
    own = nodes.where("id is not null and session_id is not null").select(
        "session_id", "seq", "id", "type", F.array_sort(label_tokens(F.col("label"))).alias("w")
    )
    own = own.where("size(w) >= 2")
    first, second = F.posexplode("w").alias("p", "a"), F.explode(F.expr("slice(w, p + 2, size(w))")).alias("b")
    groups = own.select("session_id", "seq", first, "w").select("session_id", "seq", "a", second)
    ends = edges.where("from_id is not null and to_id is not null").select("session_id", F.least("from_id", "to_id").alias("x"), F.greatest("from_id", "to_id").alias("y"))
    ends = ends.distinct()
    held = own.groupBy("session_id", "id", "w").agg(F.count(F.lit(1)).alias("n"))
    for end in ("x", "y"):
        ends = ends.join(held.select("session_id", F.col("id").alias(end), F.col("w").alias(f"w_{end}"), F.col("n").alias(f"n_{end}")), ["session_id", end])
    ends = ends.withColumn("w", F.array_sort(F.array_intersect("w_x", "w_y"))).where("size(w) >= 2 and (x <> y or n_x > 1 or w_x <> w_y)")
    linked = ends.select("session_id", first, "w", (F.col("n_x") * F.col("n_y")).alias("n")).select("session_id", "a", second, "n")
    linked = linked.groupBy("session_id", "a", "b").agg(F.sum("n").alias("e"))
    key = ["session_id", "a", "b"]
    sizes = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = groups.join(sizes, key).withColumn("_run", F.floor(F.col("seq") / 8192))
    ranked = (
        bucketed_running(rows, key, "_run", ["seq"], rank="r")
        .join(linked, key, "left")
        .withColumn("cap", F.lit(most).cast("long") + F.coalesce("e", F.lit(0)))
    )
    # pairs before (r, r + d) in a group of m: those of smaller r, then d - 1
    before = F.col("r") * (F.col("m") - 1) - (F.col("r") * (F.col("r") - 1)).cast("long") / 2
    left = ranked.withColumn("reach", F.least(F.col("m") - 1 - F.col("r"), F.col("cap") - before.cast("long"))).where("reach > 0")
    left = left.withColumn("r2", F.explode(F.sequence(F.col("r") + 1, F.col("r") + F.col("reach"))))
    right = ranked.select("session_id", "a", "b", F.col("r").alias("r2"), F.col("seq").alias("to_seq"))
    pairs = left.join(right, ["session_id", "a", "b", "r2"]).select("session_id", F.col("seq").alias("from_seq"), "to_seq").distinct()
    for end in ("from", "to"):
        pairs = pairs.join(own.select("session_id", *[F.col(c).alias(f"{end}_{c}") for c in ("seq", "id", "type", "w")]), ["session_id", f"{end}_seq"])
    both = edges.select("session_id", "from_id", "to_id").unionByName(
        edges.select("session_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    )
    fresh = pairs.join(both.distinct(), ["session_id", "from_id", "to_id"], "left_anti")
    shared = F.size(F.array_intersect("from_w", "to_w"))
    relation = F.coalesce(
        rules.relation_of(rules.INFERRED, F.col("from_type"), F.col("to_type")),
        rules.relation_of(rules.INFERRED, F.col("to_type"), F.col("from_type")),
        F.lit("relates-to"),
    )
    weight = F.bround(shared / F.greatest(F.size("from_w"), F.size("to_w")), 3)
    order = Window.partitionBy("session_id").orderBy("from_seq", "to_seq")
    return (
        fresh.select("session_id", "from_seq", "to_seq", relation.alias("relation"), weight.alias("weight"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= most)
        .drop("n")
    )


def _healed(alone: DataFrame, found: DataFrame, nodes: DataFrame, weight) -> DataFrame:
    """Edges for (from_seq, to_seq, ...) pairs, with the relation of the fallback rules in either direction."""
    kinds = nodes.select("session_id", "seq", "type")
    out = found.join(alone.select("session_id", F.col("seq").alias("from_seq"), F.col("type").alias("ft")), "from_seq")
    out = out.join(kinds.select(F.col("seq").alias("to_seq"), F.col("type").alias("tt")), "to_seq")
    relation = F.coalesce(
        rules.relation_of(rules.ORPHAN_EDGES, F.col("ft"), F.col("tt")),
        rules.relation_of(rules.ORPHAN_EDGES, F.col("tt"), F.col("ft")),
        F.lit("relates-to"),
    )
    return out.select("session_id", "from_seq", "to_seq", relation.alias("relation"), weight.alias("weight"))


def heal_by_vector(nodes: DataFrame, edges: DataFrame, least: float = 0.70) -> DataFrame:
    """(session_id, from_seq, to_seq, relation, weight): nodes without edges tied to the nearest connected node of their
    session, if similar enough."""
    alone = orphans(nodes, edges)
    connected = nodes.join(endpoints(edges), ["session_id", "id"], "left_semi")
    found = nearest(
        alone.select("session_id", F.col("seq").alias("qseq"), F.col("embedding").alias("vector")),
        connected.select("session_id", "seq", F.col("embedding").alias("vector")),
        ["session_id"],
        least,
    ).select(F.col("qseq").alias("from_seq"), F.col("seq").alias("to_seq"), "score")
    return _healed(alone, found, nodes, F.round("score", 3))


def _subsets(df: DataFrame) -> DataFrame:
    """All non-empty subsets of the sorted words of each row, as a hash and a size: (.., h, k)."""
    picks = F.transform(
        F.sequence(F.lit(1), F.expr("shiftleft(1, size(w)) - 1")),
        lambda mask: F.filter("w", lambda x, i: F.getbit(mask, i) == 1),
    )
    return df.withColumn("s", F.explode(picks)).withColumn("k", F.size("s")).withColumn("h", F.xxhash64("s")).drop("s")


def heal_by_words(nodes: DataFrame, edges: DataFrame, subset_words: int = 8) -> DataFrame:
    """(session_id, from_seq, to_seq, relation, weight): nodes without edges tied to the connected node of their session that
    shares most words, ties to the smallest seq.

    Labels of up to ``subset_words`` words meet by sets of words: of the connected nodes only the first of each set is kept,
    so a word in every label costs no more than one. Longer labels, few as they are, are compared by their single words.
    """
    words = F.array_sort(label_tokens(F.col("label"), rules.STOP_HEAL))
    own = nodes.select("session_id", "id", "seq", "type", words.alias("w")).where("size(w) > 0")
    alone = orphans(own, edges)
    connected = own.join(endpoints(edges), ["session_id", "id"], "left_semi")
    short = F.size("w") <= subset_words
    index = _subsets(connected.where(short).select("session_id", "seq", "w")).groupBy("session_id", "h").agg(F.min("seq").alias("to_seq"))
    asked = _subsets(alone.where(short).select("session_id", F.col("seq").alias("from_seq"), "w"))
    best = asked.join(index, ["session_id", "h"]).select("from_seq", "to_seq", "k")
    for a, b in ((alone.where(~short), connected), (alone.where(short), connected.where(~short))):
        pairs = (
            a.select("session_id", F.col("seq").alias("from_seq"), F.explode("w").alias("x"))
            .join(b.select("session_id", F.col("seq").alias("to_seq"), F.explode("w").alias("x")), ["session_id", "x"])
            .groupBy("from_seq", "to_seq")
            .agg(F.count(F.lit(1)).cast("int").alias("k"))
        )
        best = best.unionByName(pairs)
    top = best.groupBy("from_seq").agg(F.max(F.struct("k", (-F.col("to_seq")).alias("n"))).alias("b"))
    found = top.select("from_seq", (-F.col("b.n")).alias("to_seq"))
    return _healed(orphans(nodes, edges), found, nodes, F.lit(0.5))
