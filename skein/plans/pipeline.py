"""The ingest pipeline: turns to candidates, candidates to a merged graph, repair passes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from skein.functions import extract as X
from skein.functions import text as T
from skein.operators import merge, repair
from skein.schema import HISTORY
from skein.session import cut

#: An extractor gives, for the user's and the assistant's text, a JSON text {nodes: [...], edges: [...]}, edges by label.
Extractor = Callable[[Column, Column], Column]

ANSWER = (
    "nodes array<struct<type:string,label:string,summary:string,status:string,confidence:string,subtype:string>>,"
    " edges array<struct<`from`:string,`to`:string,relation:string,weight:string>>"
)


def hints(text: Column) -> Column:
    """What the content zones of a text hold, as lines to read with it; empty where there is nothing."""
    blocks, files, links, tools = T.code_blocks(text), T.file_refs(text), T.urls(text), T.cli_outputs(text)
    traces = F.transform(T.stack_traces(text), lambda t: F.concat(t["exception"], F.lit(": "), t["message"]))
    names = F.array_distinct(F.flatten(F.transform(blocks, lambda b: T.block_symbols(b["content"], b["language"]))))

    def line(name: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", ")))

    return F.concat_ws(
        "\n",
        line("code", F.array_distinct(F.transform(blocks, lambda b: b["language"]))),
        line("symbols", names),
        line("errors", traces),
        line("tools", F.transform(tools, lambda t: F.concat_ws(" ", t["tool"], t["signal"]))),
        line("keys", F.transform(T.schema_blobs(text), lambda k: F.array_join(k, " "))),
        line("files", files),
        line("links", links),
    )


def rule_extractor(user: Column, assistant: Column) -> Column:
    """A deterministic extractor without a model: questions asked, decisions named, open items, errors and files."""
    both = F.concat(user, F.lit("\n"), assistant)

    def found(text: Column, pattern: str, kind: str, status: str, sure: float) -> Column:
        hits = F.array_distinct(F.transform(T.all_matches(text, pattern), lambda x: F.left(T.strip(x), F.lit(120))))
        return F.transform(
            hits,
            lambda x: F.struct(F.lit(kind).alias("type"), x.alias("label"), F.lit("").alias("summary"), F.lit(status).alias("status"), F.lit(str(sure)).alias("confidence"), F.lit(None).cast("string").alias("subtype")),
        )

    trace = T.stack_trace(both)
    error = F.when(
        trace.isNotNull(),
        F.array(F.struct(F.lit("error").alias("type"), F.left(F.concat(trace["exception"], F.lit(": "), trace["message"]), F.lit(120)).alias("label"), F.lit("").alias("summary"), F.lit("active").alias("status"), F.lit("0.9").alias("confidence"), F.lit(None).cast("string").alias("subtype"))),
    )
    nodes = F.concat(
        found(user, r"(?d)([^.!?\n]{8,160}\?)", "question", "active", 0.8),
        found(both, r"(?d)((?:Decision \d+: |We (?:decided|rejected|chose) )[^.\n]{3,100})", "decision", "adopted", 0.8),
        found(both, r"(?md)^\s*(?:[-*] \[ \]|TODO:?)\s+([^\n]{3,120})", "task", "pending", 0.9),
        F.coalesce(error, F.array().cast("array<struct<type:string,label:string,summary:string,status:string,confidence:string,subtype:string>>")),
        F.transform(T.file_refs(both), lambda p: F.struct(F.lit("file").alias("type"), p.alias("label"), F.lit("").alias("summary"), F.lit("active").alias("status"), F.lit("0.9").alias("confidence"), F.lit(None).cast("string").alias("subtype"))),
    )
    return F.to_json(F.struct(nodes.alias("nodes"), F.array().cast("array<struct<`from`:string,`to`:string,relation:string,weight:string>>").alias("edges")))


#: Extractors by name; a model is any vectorised function of two text columns that gives JSON text.
EXTRACTORS: dict[str, Extractor] = {"rules": rule_extractor}


def readable(answer: Column) -> Column:
    """Whether an extractor's answer is a JSON object."""
    return F.coalesce(F.try_parse_json(answer).isNotNull() & F.ltrim(answer).startswith("{"), F.lit(False))


def hybrid_extractor(first: Extractor, second: Extractor, turn: Column, every: int = 10) -> Extractor:
    """An extractor that asks ``second`` on every n-th turn and ``first`` on the others; where the second gives no readable answer,
    the first is asked."""

    def extract(user: Column, assistant: Column) -> Column:
        own = second(user, assistant)
        return F.when((turn % max(1, every) == 0) & readable(own), own).otherwise(first(user, assistant))

    return extract


#: Places of a vector of :func:`word_embedder`.
WORD_PLACES = 256


@F.pandas_udf(ArrayType(FloatType()))
def word_embedder(label: pd.Series) -> pd.Series:
    """A deterministic embedder without a model: counts of a label's words at hashed places; null where it has none."""

    def vector(text):
        words = re.findall(r"[^\W_]+", text.lower()) if text else []
        if not words:
            return None
        out = np.zeros(WORD_PLACES, dtype=np.float32)
        for w in words:
            h = zlib.crc32(w.encode())
            out[(h >> 1) % WORD_PLACES] += 1.0 if h & 1 else -1.0
        return out if out.any() else None

    return label.map(vector, na_action="ignore")


def embed(nodes: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    """Nodes with embeddings for those that have none, each distinct label embedded once."""
    missing = nodes.where("embedding is null and label is not null").select("label").distinct()
    vectors = missing.select("label", embedder(F.col("label")).cast("array<float>").alias("_v"))
    return nodes.join(vectors, "label", "left").withColumn("embedding", F.coalesce("embedding", "_v")).select(*nodes.columns)


def candidates(turns: DataFrame, extractor: Extractor = rule_extractor, masks: list[str] | None = None, max_chars: int = 6000) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) extracted from turns (session_id, turn_number, role_user, role_assistant, ts).

    Texts are masked, the content zones are put before the user's, long turns are read in chunks. Candidates are validated,
    grounded in their chunk, checked for speculation, reclassified and scored, in this order; below half confidence they are
    unconfirmed. Edges are bound by label within their chunk, the last node of a label counts; each node without one gets a
    fallback edge. Answers that can't be read give nothing. Ids are hashes, so a rerun gives the same rows.
    """
    read = turns.select("session_id", "turn_number", "ts", *[T.mask(F.coalesce(c, F.lit("")), masks).alias(c) for c in ("role_user", "role_assistant")])
    read = read.withColumn("role_user", F.concat_ws("\n", F.nullif(hints(F.concat("role_user", F.lit("\n"), "role_assistant")), F.lit("")), "role_user"))
    parts = read.select("session_id", "turn_number", "ts", "role_user", F.posexplode(T.turn_chunks(F.col("role_user"), F.col("role_assistant"), max_chars)).alias("chunk", "part"))
    parts = parts.withColumn("source", F.concat("role_user", F.lit("\n"), "part")).withColumn("answer", F.from_json(extractor(F.col("role_user"), F.col("part")), ANSWER))
    batch = F.concat_ws("|", "session_id", F.col("turn_number").cast("string"), F.col("chunk").cast("string"))
    key = ["batch", "session_id", "turn_number", "ts"]
    rows = parts.select(batch.alias("batch"), "session_id", "turn_number", "ts", "source", F.posexplode("answer.nodes").alias("place", "n")).where("n.label is not null and n.label <> ''")
    kind = X.valid_type(F.lower("n.type"))
    rows = rows.select(
        *key, "source", "place", F.left("n.label", F.lit(120)).alias("label"), F.left(F.coalesce("n.summary", F.lit("")), F.lit(500)).alias("summary"), kind.alias("type"),
        X.valid_status(F.lower("n.status"), kind).alias("status"), F.coalesce(F.col("n.confidence").try_cast("double"), F.lit(0.5)).alias("confidence"), F.col("n.subtype").alias("subtype"),
    )
    sure = X.grounded(F.col("label"), F.col("source"))
    rows = rows.withColumn("status", F.when(sure, F.col("status")).otherwise("unconfirmed")).withColumn("confidence", F.when(sure, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.3))))
    rows = rows.withColumn("reason", X.speculative_reason(F.col("label"), F.col("source"))).withColumn("confidence", X.capped(F.col("confidence"), F.col("reason")))
    new_type, new_status = X.reclassified(F.col("was"), F.col("said"), F.col("label"))
    rows = rows.withColumnsRenamed({"type": "was", "status": "said"}).withColumn("type", new_type).withColumn("status", new_status)
    rows = rows.withColumn("confidence", X.confidence(F.col("label"), F.col("source"), F.col("confidence")))
    rows = rows.withColumn("status", F.when(F.col("confidence") < 0.5, "unconfirmed").otherwise(F.col("status")))
    meta = F.to_json(F.struct(F.col("reason").alias("speculative_reason"), F.when(F.col("was") != F.col("type"), F.col("was")).alias("reclassified_from")))
    nodes = rows.select(
        "batch", "session_id", F.sha2(F.concat_ws("\x1f", "batch", F.col("place").cast("string"), "label"), 256).alias("id"), "type", "label", "summary", "status", "confidence", "subtype",
        meta.alias("metadata"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.struct("turn_number", "batch", "place").alias("_order"),
    )
    nodes = cut(nodes, "candidates")
    last = nodes.groupBy("batch", F.lower("label").alias("l")).agg(F.max_by("id", "_order").alias("id"))
    named = parts.select(batch.alias("batch"), "session_id", F.explode("answer.edges").alias("e")).select("batch", "session_id", "e.*")
    for end in ("from", "to"):
        named = named.withColumn("_l", F.lower(end)).join(last.select("batch", F.col("l").alias("_l"), F.col("id").alias(f"{end}_id")), ["batch", "_l"]).drop("_l")
    told = named.select("batch", "session_id", "from_id", "to_id", X.valid_relation(F.col("relation")).alias("relation"), F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight"))
    numbered = nodes.withColumn("seq", F.row_number().over(Window.partitionBy("batch").orderBy("_order")).cast("long"))
    patch = merge.minimum_edges(numbered.select("batch", "seq", "id", "type"), told)
    for end in ("from", "to"):
        patch = patch.join(numbered.select("batch", F.col("seq").alias(f"{end}_seq"), F.col("id").alias(f"{end}_id")), ["batch", f"{end}_seq"])
    patch = patch.select("batch", F.substring_index("batch", "|", 1).alias("session_id"), "from_id", "to_id", "relation", F.lit(0.5).alias("weight"))
    return nodes, told.unionByName(patch).drop("batch")


def _updated(nodes: DataFrame, hit: DataFrame, now: Column) -> DataFrame:
    """Nodes with what was matched to them (rows of merge.exact_dedup) taken over, the last by seq, and the highest confidence."""
    change = hit.groupBy("target_seq").agg(F.max_by(F.struct("status", "summary", "note"), "seq").alias("u"), F.max("confidence").alias("c"))
    kept = nodes.join(change.withColumnRenamed("target_seq", "seq"), "seq", "left")
    moved = F.col("u").isNotNull() & (F.col("u.status") != F.col("status"))
    return (
        kept.withColumn("status_history", F.when(moved, X.push_status(F.col("status_history"), F.col("status"), F.col("u.note"), now)).otherwise(F.col("status_history")))
        .withColumn("status", F.coalesce("u.status", "status"))
        .withColumn("summary", F.coalesce("u.summary", "summary"))
        .withColumn("confidence", F.coalesce("c", "confidence"))
        .withColumn("updated_at", F.when(F.col("u").isNotNull(), now).otherwise(F.col("updated_at")))
        .select(*nodes.columns)
    )


def merge_batch(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, policy: str = "manual", at: str | None = None, embedder: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph with a batch merged in: exact matches update the stored node, or the first node of the batch with that label; of the rest, in order of ``seq``, near-duplicates
    update the node they are merged into, and the others are added, with relates-to edges to similar nodes of the type and,
    within the session's budget, of types that go with it; edges are led to the nodes that stay, conflicts are marked, nodes
    without edges get a fallback edge. ``seq`` numbers must be unique over both. Nodes without an embedding get one from the
    ``embedder``; without one they are matched exactly only. What later steps read several times is written down on the way,
    so plans stay small."""
    now = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    m = cut(merge.exact_dedup(nodes, new_nodes, policy), "matched")
    hit = m.where("target_seq is not null")
    kept = _updated(nodes, hit, now)
    # a label said again in the batch meets its first node there
    fresh = new_nodes.join(hit.select("seq"), "seq", "left_anti")
    key = ["session_id", "type", F.lower("label").alias("l")]
    opened = fresh.where("session_id is not null and type is not null and label is not null").groupBy(*key).agg(F.min("seq").alias("seq"))
    again = fresh.select("seq", *key).join(opened.withColumnRenamed("seq", "first"), ["session_id", "type", "l"]).where("seq > first").select("seq")
    again = cut(again, "again")
    later = fresh.join(again, "seq", "left_semi")
    fresh = fresh.join(again, "seq", "left_anti")
    said = cut(merge.exact_dedup(fresh, later, policy), "said")
    hit = hit.unionByName(said)
    missing = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c not in fresh.columns]
    fresh = _updated(fresh.select("*", *missing).select(*nodes.columns), said, now)
    if embedder:
        kept, fresh = embed(kept, embedder), embed(fresh, embedder)
    kept, fresh = cut(kept, "kept"), cut(fresh, "fresh")
    near = cut(merge.semantic_merge(kept, fresh, budget=merge.relate_budget(edges)), "near")
    pool = kept.unionByName(fresh)
    gone = near.where("action = 'merge'")
    told = gone.join(fresh.select("seq", "summary", "confidence"), "seq").groupBy("target_seq").agg(
        F.max_by(F.col("summary"), F.when(F.col("summary") != "", F.col("seq"))).alias("s"), F.max("confidence").alias("c")
    )
    every = pool.join(gone.select("seq"), "seq", "left_anti").join(told.select(F.col("target_seq").alias("seq"), "s", "c", F.lit(True).alias("u")), "seq", "left")
    every = every.withColumns({"summary": F.coalesce("s", "summary"), "confidence": F.greatest("confidence", "c"), "updated_at": F.when(F.col("u"), now).otherwise(F.col("updated_at"))})
    every = cut(every.select(*nodes.columns), "nodes")
    ends = near.where("target_seq is not null").join(fresh.select("seq", "session_id", "id"), "seq").join(pool.select(F.col("seq").alias("target_seq"), F.col("id").alias("target_id")), "target_seq")
    ends = cut(ends.where("id is not null and target_id is not null"), "ends")
    similar = ends.where("action <> 'merge'").select("session_id", F.col("id").alias("from_id"), F.col("target_id").alias("to_id"), F.lit("relates-to").alias("relation"), F.col("score").alias("weight"))
    id_map = hit.where("id is not null and target_id is not null").unionByName(ends.where("action = 'merge'"), allowMissingColumns=True)
    id_map = id_map.select("session_id", F.col("id").alias("old_id"), F.col("target_id").alias("new_id"))
    links = ["session_id", "from_id", "to_id", "relation", "weight"]
    added = merge.resolve_edges(new_edges.select(*links).unionByName(similar), every, id_map).select(*links).unionByName(merge.conflict_edges(hit).select(*links))
    joined = cut(edges.select(*links).unionByName(added), "edges")
    patch = merge.orphan_patch(every, joined)
    for end in ("from", "to"):
        patch = patch.join(every.select(F.col("seq").alias(f"{end}_seq"), F.col("id").alias(f"{end}_id")), f"{end}_seq")
    return every, joined.unionByName(patch.select(*links))


def repair_all(nodes: DataFrame, edges: DataFrame, order: str = "ingest", at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All repair passes; after an ingest low confidence is handled first, after a merge of structured sources last. Nodes
    without edges are healed by vector, those it finds nothing for by words."""
    if order == "ingest":
        nodes = repair.remediate(nodes, at=at)
    links = ["session_id", "from_id", "to_id", "relation", "weight"]

    def add(found: DataFrame) -> DataFrame:
        for end in ("from", "to"):
            found = found.join(nodes.select(F.col("seq").alias(f"{end}_seq"), F.col("id").alias(f"{end}_id")), f"{end}_seq")
        return found.select(*links)

    nodes, edges = cut(nodes, "nodes"), cut(edges.select(*links), "edges")
    edges = cut(edges.unionByName(add(repair.infer_edges(nodes, edges))), "edges")
    edges = cut(repair.upgrade_relations(nodes, edges), "edges")
    edges = cut(edges.unionByName(add(repair.heal_by_vector(nodes, edges))), "edges")
    edges = edges.unionByName(add(repair.heal_by_words(nodes, edges)))
    if order != "ingest":
        nodes = repair.remediate(nodes, at=at)
    return nodes, edges


def empty_history(nodes: DataFrame) -> DataFrame:
    """Nodes with the columns a stored graph has and candidates lack."""
    have = set(nodes.columns)
    extra = {"status_history": HISTORY.simpleString(), "embedding": "array<float>", "source_url": "string", "topic": "string"}
    return nodes.select("*", *[F.lit(None).cast(t).alias(c) for c, t in extra.items() if c not in have])
