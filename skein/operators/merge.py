"""Entity resolution: exact keys, status conflicts, nearest vectors, edges through the merge map, fallback edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import rules
from skein.functions.extract import is_conflict, valid_relation
from skein.session import cut

POLICIES = ("manual", "auto-accept-incoming", "auto-keep-existing")
#: Groups of more incoming nodes than this are folded in rounds over many tasks.
HOT = 4096


def latest(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key, by created_at and seq; reduced before rows move."""
    order = F.struct(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")).alias("c"), F.col("seq").alias("s"))
    row = F.struct(*[F.col(c) for c in nodes.columns if c not in keys])
    return nodes.groupBy(*keys).agg(F.max_by(row, order).alias("r")).select(*keys, "r.*")


def exact_dedup(existing: DataFrame, incoming: DataFrame, policy: str = "manual") -> DataFrame:
    """Incoming nodes against the latest existing one with equal session, type and label (case ignored).

    Rows (session_id, seq, id, target_id, target_seq, status, summary, confidence, conflict, note), one per incoming node;
    the target is null where there is none, and the node stays as it is. Otherwise the target takes a new, non-empty summary,
    the higher confidence and, unless it reverses a settled status, the new status. A reversal makes it conflicted (manual),
    is taken over (auto-accept-incoming) or dropped (auto-keep-existing); any other policy is manual. Null keys never match.
    """
    key = ["session_id", "type", "_label"]
    cols = ["id", "seq", "status", "summary", "confidence", "created_at"]
    old = latest(existing.select("session_id", "type", F.lower("label").alias("_label"), *cols), key)
    old = old.select(*key, *[F.col(c).alias(f"t_{c}") for c in cols if c != "created_at"])
    new = incoming.select("session_id", "type", F.lower("label").alias("_label"), *cols[:-1])
    joined = new.join(old, key, "left")
    found = F.col("t_seq").isNotNull()
    clash = found & F.coalesce(is_conflict(F.col("t_status"), F.col("status")), F.lit(False))
    settled = {"auto-accept-incoming": F.col("status"), "auto-keep-existing": F.col("t_status")}.get(policy, F.lit("conflicted"))
    word = {"auto-accept-incoming": "accepted", "auto-keep-existing": "kept"}.get(policy, "reversal")
    fresh = F.coalesce(F.col("status") != "", F.lit(False))
    return joined.select(
        "session_id",
        "seq",
        "id",
        F.col("t_id").alias("target_id"),
        F.col("t_seq").alias("target_seq"),
        F.when(clash, settled).when(found & ~fresh, F.col("t_status")).otherwise(F.col("status")).alias("status"),
        F.when(found & (F.coalesce("summary", F.lit("")) == ""), F.col("t_summary")).otherwise(F.col("summary")).alias("summary"),
        F.greatest(*[F.nanvl(c, F.lit(None).cast("double")) for c in ("confidence", "t_confidence")]).alias("confidence"),
        clash.alias("conflict"),
        F.when(clash, F.concat(F.lit(word + ": "), "t_status", F.lit(" → "), "status")).alias("note"),
    )


def conflict_edges(merged: DataFrame) -> DataFrame:
    """The contradicts edge of each conflicted target to itself."""
    return (
        merged.where("conflict")
        .select("session_id", F.col("target_id").alias("from_id"), F.col("target_id").alias("to_id"))
        .distinct()
        .select("*", F.lit("contradicts").alias("relation"), F.lit(0.5).alias("weight"))
    )


def nearest(queries: DataFrame, corpus: DataFrame, group: list[str], least: float, block: int = 2048, earlier: bool = False) -> DataFrame:
    """For each query its most similar corpus row within its group: (qseq, seq, score), score at least ``least``.

    queries: (group, qseq, vector), corpus: (group, seq, vector); equal seqs never match, and with ``earlier`` only smaller
    ones do; ties go to the smallest seq; vectors
    of another length, empty or zero ones match nothing. Groups are cut into blocks of about ``block`` rows on both sides and
    each pair of blocks is one matrix product, so a hot group spreads over many tasks and no pair is ever written. Many small
    blocks share a task call.
    """
    spark = queries.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))

    parts = sizes(corpus, "_cp").join(sizes(queries, "_qp"), group)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = queries.join(parts, group).withColumn("_q", own("qseq", "_qp")).withColumn("_c", every("_cp"))
    right = corpus.join(parts, group).withColumn("_c", own("seq", "_cp")).withColumn("_q", every("_qp"))
    key = F.xxhash64(*group, "_q", "_c")
    left = left.select(key.alias("key"), "qseq", F.col("vector").cast("array<double>").alias("vector"))
    right = right.select(key.alias("key"), "seq", F.col("vector").cast("array<double>").alias("vector"))
    left = left.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    right = right.withColumn("bucket", F.pmod("key", F.lit(buckets)))

    def unit(rows: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for df in (q, c):
            df["dim"] = df["vector"].map(lambda v: 0 if v is None else len(v))
        pools = {k: g.sort_values("seq") for k, g in c[c["dim"] > 0].groupby(["key", "dim"], sort=False)}
        for k, g in q[q["dim"] > 0].groupby(["key", "dim"], sort=False):
            pool = pools.get(k)
            if pool is None:
                continue
            a, b = g["qseq"].to_numpy(), pool["seq"].to_numpy()
            score = unit(g["vector"]) @ unit(pool["vector"]).T
            score[a[:, None] <= b[None, :] if earlier else a[:, None] == b[None, :]] = -2.0
            at = score.argmax(axis=1)
            top = score[np.arange(len(a)), at]
            good = top >= least
            out.append(pd.DataFrame({"qseq": a[good], "seq": b[at[good]], "score": top[good]}))
        return pd.concat(out) if out else pd.DataFrame({"qseq": [], "seq": [], "score": []}).astype({"qseq": "int64", "seq": "int64"})

    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(best, "qseq long, seq long, score double")
    top = found.groupBy("qseq").agg(F.max(F.struct("score", (-F.col("seq")).alias("n"))).alias("b"))
    return top.select("qseq", (-F.col("b.n")).alias("seq"), F.col("b.score").alias("score"))


def best_match(existing: DataFrame, incoming: DataFrame, least: float = 0.70) -> DataFrame:
    """(seq, match_seq, score): each incoming node's nearest existing one of its session and type."""
    q = incoming.select("session_id", "type", F.col("seq").alias("qseq"), F.col("embedding").alias("vector"))
    c = existing.select("session_id", "type", "seq", F.col("embedding").alias("vector"))
    return nearest(q, c, ["session_id", "type"], least).select(F.col("qseq").alias("seq"), F.col("seq").alias("match_seq"), "score")


def cross_type_match(existing: DataFrame, incoming: DataFrame, least: float = 0.82, earlier: bool = False) -> DataFrame:
    """(seq, match_seq, score): the nearest existing node (with ``earlier``, of smaller seq) of a type that goes with the
    incoming node's."""
    spark = existing.sparkSession
    pairs = spark.createDataFrame(
        [(a, b) for x, y in rules.CROSS_PAIRS for a, b in ((x, y), (y, x))], "type string, partner string"
    )
    q = incoming.select("session_id", "type", F.col("seq").alias("qseq"), F.col("embedding").alias("vector")).join(F.broadcast(pairs), "type")
    q = q.select("session_id", "partner", "qseq", "vector")
    c = existing.select("session_id", F.col("type").alias("partner"), "seq", F.col("embedding").alias("vector"))
    found = nearest(q, c, ["session_id", "partner"], least, earlier=earlier)
    return found.select(F.col("qseq").alias("seq"), F.col("seq").alias("match_seq"), "score")


def relate_budget(edges: DataFrame, share: float = 0.28) -> DataFrame:
    """(session_id, budget): how many more relates-to edges a session may get."""
    of = F.floor(F.count(F.lit(1)) * F.lit(share)) - F.count_if(F.coalesce(F.col("relation") == "relates-to", F.lit(False)))
    return edges.groupBy("session_id").agg(F.greatest(F.lit(0), of).cast("long").alias("budget"))


def resolve_edges(edges: DataFrame, nodes: DataFrame, id_map: DataFrame) -> DataFrame:
    """Edges with endpoints led through id_map (session_id, old_id, new_id); edges without both nodes are dropped."""
    ids = nodes.select("session_id", "id").where("id is not null").distinct()
    m = id_map.groupBy("session_id", "old_id").agg(F.min("new_id").alias("new_id"))
    out = edges
    for end in ("from_id", "to_id"):
        step = m.select("session_id", F.col("old_id").alias(end), "new_id")
        out = out.join(step, ["session_id", end], "left").withColumn(end, F.coalesce("new_id", end)).drop("new_id")
        out = out.join(ids.withColumnRenamed("id", end), ["session_id", end], "left_semi")
    return out


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct (session_id, id) at either end of an edge."""
    return edges.select("session_id", F.explode(F.array("from_id", "to_id")).alias("id")).where("id is not null").distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge in their session."""
    return nodes.join(endpoints(edges), ["session_id", "id"], "left_anti")


def orphan_patch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, from_seq, to_seq, relation, weight): for each node without edges, one to the first node (by seq) of its
    session that the fallback rules allow. Only the two first nodes of each type and session can be partners, so nothing is
    paired beyond that."""
    spark = nodes.sparkSession
    firsts = (
        nodes.select("session_id", "type", "seq", "id")
        .withColumn("n", F.row_number().over(Window.partitionBy("session_id", "type").orderBy("seq")))
        .where("n <= 2")
        .select("session_id", F.col("type").alias("to_type"), F.col("seq").alias("to_seq"), F.col("id").alias("to_id"))
    )
    alone = orphans(nodes, edges).select("session_id", "type", F.col("id").alias("from_id"), F.col("seq").alias("from_seq"))
    rule = rules.rule_frame(spark, rules.ORPHAN_EDGES).withColumnRenamed("from_type", "type")
    allowed = alone.join(F.broadcast(rule), "type").join(firsts, ["session_id", "to_type"]).where("to_id <> from_id")
    first = allowed.groupBy("session_id", "from_seq").agg(F.min(F.struct("to_seq", "relation")).alias("p"))
    return first.select("session_id", "from_seq", "p.to_seq", "p.relation", F.lit(0.5).alias("weight"))


def bind_edges(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """Edges given by labels (session_id, from_label, to_label, relation, ...) with the ids of the last nodes that carry them,
    case ignored, further columns kept; edges to unknown labels are dropped."""
    more = [c for c in named.columns if c not in ("session_id", "from_label", "to_label", "relation")]
    ids = nodes.groupBy("session_id", F.lower("label").alias("l")).agg(F.max_by("id", "seq").alias("id"))
    out = named
    for end in ("from", "to"):
        side = ids.select("session_id", F.col("l").alias(f"_{end}"), F.col("id").alias(f"{end}_id"))
        out = out.withColumn(f"_{end}", F.lower(f"{end}_label")).join(side, ["session_id", f"_{end}"])
    return out.select("session_id", "from_id", "to_id", valid_relation(F.col("relation")).alias("relation"), *more)


def _kept_of_hot(rows: DataFrame, least: float) -> DataFrame:
    """Of rows (key, seq, vector), those without an earlier kept one of their key that is as similar as ``least``.

    The same rows as one fold in order of seq: in each round an undecided row with no earlier undecided neighbour is kept, and
    the neighbours of the kept ones are out. Neighbours are found by blocks and no pair is written. Equal vectors can't both
    be kept, so only the first of them is looked at.
    """
    cols = ["key", "seq", "vector"]
    usable = rows.where(F.exists("vector", lambda x: x != 0))
    open_rows = cut(usable.groupBy("key", "vector").agg(F.min("seq").alias("seq")).select(*cols), "open")
    kept = open_rows.where("false")
    while not open_rows.isEmpty():
        asked = open_rows.withColumnRenamed("seq", "qseq")
        waiting = cut(nearest(asked, open_rows, ["key"], least, earlier=True).select(F.col("qseq").alias("seq")), "waiting")
        chosen = open_rows.join(waiting, "seq", "left_anti").select(*cols)
        left = cut(open_rows.join(waiting, "seq", "left_semi").select(*cols), "left")
        out = nearest(left.withColumnRenamed("seq", "qseq"), chosen, ["key"], least, earlier=True).select(F.col("qseq").alias("seq"))
        kept = cut(kept.unionByName(chosen), "kept")
        open_rows = cut(left.join(out, "seq", "left_anti").select(*cols), "open")
    return kept


def semantic_merge(
    existing: DataFrame, incoming: DataFrame, batch: Column | None = None, merge: float = 0.88, relate: float = 0.78,
    budget: DataFrame | None = None, cross: float = 0.82, hot: int = HOT,
) -> DataFrame:
    """(seq, action, target_seq, score) of incoming nodes: merge into an existing node of the type at ``merge`` or more, relate
    to it from ``relate``, else keep; existing nodes are searched in parallel. Incoming nodes that found no existing node to
    merge with are then compared, in order of seq, with those of their session, type and ``batch`` kept before them (all
    incoming nodes if no batch is given). Many small groups share a task call; groups of more than ``hot`` nodes are folded in
    rounds, with the same result.

    With a ``budget`` (session_id, budget), nodes to keep are compared with the nodes of the types that go with theirs, existing
    or added before them: those of ``cross`` or more get the action cross, the first of each session up to its budget.
    """
    spark = existing.sparkSession
    scored = best_match(existing, incoming, relate)
    key = F.xxhash64("session_id", "type", F.lit(0) if batch is None else batch)
    first = cut(incoming.select("seq", "embedding", key.alias("key")).join(scored, "seq", "left"), "scored")
    done = first.where(F.col("score") >= merge).select("seq", F.lit("merge").alias("action"), F.col("match_seq").alias("target_seq"), "score")
    rest = first.where(F.col("score").isNull() | (F.col("score") < merge))

    def fold_one(pdf: pd.DataFrame) -> list[tuple]:
        kept: dict[int, tuple[list, np.ndarray]] = {}
        out = []
        for seq, embedding, target, best in zip(pdf["seq"], pdf["embedding"], pdf["match_seq"], pdf["score"]):
            if best is None or best != best:
                best = target = None
            v = None if embedding is None else np.asarray(embedding, dtype=np.float64)
            norm = 0.0 if v is None or not len(v) else float(np.linalg.norm(v))
            if norm and len(v) not in kept:
                kept[len(v)] = ([], np.empty((len(pdf), len(v))))
            seqs, rows = kept[len(v)] if norm else ([], None)
            if seqs:
                sims = rows[: len(seqs)] @ (v / norm)
                at = int(sims.argmax())
                if sims[at] >= relate and (best is None or sims[at] > best):
                    best, target = float(sims[at]), seqs[at]
            action = "keep" if best is None else "merge" if best >= merge else "relate"
            if action != "merge" and norm:
                rows[len(seqs)] = v / norm
                seqs.append(seq)
            out.append((seq, action, target, best))
        return out

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [r for _, g in pdf.sort_values(["key", "seq"]).groupby("key", sort=False) for r in fold_one(g)]
        return pd.DataFrame(out, columns=["seq", "action", "target_seq", "score"]).astype({"target_seq": "Int64"})

    large = cut(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "large")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = rest.join(large, "key", "left_anti").select("seq", "embedding", "key", "match_seq", "score")
    folded = small.groupBy(F.pmod("key", F.lit(buckets))).applyInPandas(fold, "seq long, action string, target_seq long, score double")
    out = done.unionByName(folded)
    if not large.isEmpty():
        crowd = rest.join(large, "key", "left_semi")
        vectors = cut(crowd.select("key", "seq", F.col("embedding").cast("array<double>").alias("vector")), "crowd")
        mates = nearest(vectors.withColumnRenamed("seq", "qseq"), _kept_of_hot(vectors, merge), ["key"], relate, earlier=True)
        both = crowd.join(mates.select(F.col("qseq").alias("seq"), F.col("seq").alias("mate"), F.col("score").alias("near")), "seq", "left")
        mated = F.col("near").isNotNull() & (F.col("score").isNull() | (F.col("near") > F.col("score")))
        both = both.select("seq", F.when(mated, F.col("mate")).otherwise(F.col("match_seq")).alias("target_seq"), F.when(mated, F.col("near")).otherwise(F.col("score")).alias("score"))
        action = F.when(F.col("score").isNull(), "keep").when(F.col("score") >= merge, "merge").otherwise("relate")
        out = out.unionByName(both.select("seq", action.alias("action"), "target_seq", "score"))
    if budget is None:
        return out
    out = cut(out, "folded")
    rows = incoming.select("session_id", "seq", "type", "embedding")
    added = rows.join(out.where("action <> 'merge'").select("seq"), "seq", "left_semi")
    alone = rows.join(out.where("action = 'keep'").select("seq"), "seq", "left_semi")
    stored = cross_type_match(existing, alone, cross)
    fresh = cross_type_match(added, alone, cross, earlier=True)
    ties = stored.withColumn("old", F.lit(1)).unionByName(fresh.withColumn("old", F.lit(0)))
    best = ties.groupBy("seq").agg(F.max_by(F.struct("match_seq", "score"), F.struct("score", "old")).alias("m"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    allowed = best.join(rows.select("session_id", "seq"), "seq").join(budget.where("budget > 0"), "session_id").withColumn("_n", place).where("_n <= budget")
    out = out.join(allowed.select("seq", "m"), "seq", "left")
    return out.select(
        "seq",
        F.when(F.col("m").isNotNull(), "cross").otherwise(F.col("action")).alias("action"),
        F.coalesce("m.match_seq", "target_seq").alias("target_seq"),
        F.coalesce("m.score", "score").alias("score"),
    )


def minimum_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(batch, from_seq, to_seq, relation): per batch, in order of seq, one edge for each node without one, to the first node
    the fallback rules allow, else to the first other; both then count as connected. A batch is what one turn yields, a few
    dozen rows; many are folded in one call. nodes: (batch, seq, id, type), edges: (batch, from_id, to_id)."""
    rule = {(a, b): r for a, b, r in rules.ORPHAN_EDGES}
    ends = edges.select("batch", F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("linked", F.lit(True))
    rows = nodes.join(ends, ["batch", "id"], "left").select("batch", "seq", "id", "type", F.coalesce("linked", F.lit(False)).alias("linked"))

    def fold_one(batch: str, seq: list, kind: list, linked: list) -> list[tuple]:
        out = []
        for i in range(len(seq)):
            if linked[i] or len(seq) < 2:
                continue
            others = [j for j in range(len(seq)) if j != i]
            j = next((j for j in others if (kind[i], kind[j]) in rule), others[0])
            out.append((batch, seq[i], seq[j], rule.get((kind[i], kind[j]), "relates-to")))
            linked[i] = linked[j] = True
        return out

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf.sort_values(["batch", "seq"]).groupby("batch", sort=False)
        out = [r for b, g in groups for r in fold_one(b, g["seq"].tolist(), g["type"].tolist(), g["linked"].tolist())]
        return pd.DataFrame(out, columns=["batch", "from_seq", "to_seq", "relation"])

    buckets = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("batch"), F.lit(buckets))
    return rows.where("batch is not null").groupBy(bucket).applyInPandas(fold, "batch string, from_seq long, to_seq long, relation string")
