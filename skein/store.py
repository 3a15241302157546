"""Snapshots of the graph tables: keyed upserts, deletes, exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schema import NODE_STATUSES


def upsert(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("session_id", "id")) -> DataFrame:
    """Stored rows with incoming ones in their place where keys are equal; the greatest seq counts. Null ids are no rows."""
    both = stored.unionByName(incoming, allowMissingColumns=True).where(F.col(keys[-1]).isNotNull())
    row = F.struct(*[c for c in both.columns if c not in keys])
    return both.groupBy(*keys).agg(F.max_by(row, "seq").alias("_r")).select(*keys, "_r.*").select(*both.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of (session_id, id), and edges without any that touch them."""
    ids = gone.select("session_id", "id").where("id is not null").distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["session_id", end], "left_anti")
    return nodes.join(ids, ["session_id", "id"], "left_anti"), edges


def _shown(col: str):
    """A number as the viewer shows it: what is missing or not a number counts as 1."""
    return F.round(F.coalesce(F.when(~F.isnan(col), F.col(col)), F.lit(1.0)), 6).alias(col)


def viewer_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes the graph viewer draws."""
    return nodes.where("id is not null").select("session_id", "seq", "id", "label", "type", "status", F.coalesce("summary", F.lit("")).alias("summary"), _shown("confidence"))


def viewer_edges(edges: DataFrame) -> DataFrame:
    """The edges the graph viewer draws."""
    return edges.select("session_id", "seq", "id", "from_id", "to_id", "relation", _shown("weight"))


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, kind, seq, json): of each session a line with its counts, then one JSON line per node and edge, embeddings left out.
    Lines, not one document: a session may be larger than a task should hold."""
    n = nodes.drop("embedding")
    a = n.select("session_id", F.lit("node").alias("kind"), "seq", F.to_json(F.struct(*n.columns)).alias("json"))
    b = edges.select("session_id", F.lit("edge").alias("kind"), "seq", F.to_json(F.struct(*edges.columns)).alias("json"))
    counts = a.select("session_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(b.select("session_id", F.lit(0).alias("n"), F.lit(1).alias("e")))
    counts = counts.groupBy("session_id").agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))
    head = counts.select("session_id", F.lit("session").alias("kind"), F.lit(None).cast("long").alias("seq"), F.to_json(F.struct("session_id", "nodes", "edges")).alias("json"))
    return head.unionByName(a).unionByName(b)


def save(df: DataFrame, folder: str, by: str = "session_id") -> str:
    """Writes a new snapshot, partitioned by session, and makes it the current one by replacing a pointer file; the folder may be on any
    file system that Spark writes to."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(f"{folder}/{name}")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    hint, place = hadoop.Path(f"{folder}/_{name}"), hadoop.Path(f"{folder}/CURRENT")
    out = hint.getFileSystem(conf).create(hint, True)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    files = hint.getFileSystem(conf)
    context = hadoop.FileContext.getFileContext(files.getUri(), conf)
    context.rename(files.makeQualified(hint), files.makeQualified(place), over)
    return name


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The current snapshot; filters on session_id read only its folders."""
    name = spark.read.text(f"{folder}/CURRENT").first()["value"].strip()
    return spark.read.parquet(f"{folder}/{name}")


def write_managed_block(path: str, content: str, begin: str = "<!-- session context: begin -->", end: str = "<!-- session context: end -->") -> None:
    """Puts content between two markers of a text file: in their place, else at its end, else in a new file."""
    block = f"{begin}\n{content}\n{end}"
    old = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
    a, b = old.find(begin), old.find(end)
    if 0 <= a < b:
        text = old[:a] + block + old[b + len(end) :]
    else:
        text = f"{old.rstrip()}\n\n{block}\n" if old.strip() else block + "\n"
    temp = f"{path}.{uuid.uuid4().hex}"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)


def write_text(path: str, content: str) -> None:
    """Writes a text file whole, by replacing it, its folder made where there is none."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(temp, path)


def append_export(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with the rows of an imported session export (sources.chats.session_export) as they are; columns it lacks are null."""
    take = lambda df, like: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])
    session = lambda df: df if "session_id" in df.columns else df.withColumn("session_id", F.col("original_session_id")) if "original_session_id" in df.columns else df
    return nodes.unionByName(take(session(more_nodes), nodes)), edges.unionByName(take(session(more_edges), edges))


def set_title(sessions: DataFrame, session_id: str, title: str) -> DataFrame:
    """The sessions with one's title set; a session that isn't known is added."""
    known = sessions.withColumn("title", F.when(F.col("session_id") == session_id, F.lit(title)).otherwise(F.col("title")))
    new = sessions.sparkSession.createDataFrame([(session_id, title)], "session_id string, title string").join(sessions.select("session_id"), "session_id", "left_anti")
    return known.unionByName(new, allowMissingColumns=True)


def edit_node(nodes: DataFrame, session_id: str, node_id: str, status: str | None = None, summary: str | None = None) -> DataFrame:
    """The nodes with one's status or summary set, without a trace in its history; a status that isn't one of NODE_STATUSES, or an
    unknown node, is an error."""
    if status is not None and status not in NODE_STATUSES:
        raise ValueError(f"unknown status: {status}")
    one = (F.col("session_id") == session_id) & (F.col("id") == node_id)
    if nodes.where(one).isEmpty():
        raise LookupError(f"no node {node_id}")
    for name, value in (("status", status), ("summary", summary)):
        if value is not None:
            nodes = nodes.withColumn(name, F.when(one, F.lit(value)).otherwise(F.col(name)))
    return nodes


def fan_out(paths: list[str], content: str) -> list[str]:
    """Writes a managed block to each path once, in the order given; the paths written."""
    own = list(dict.fromkeys(p for p in paths if p))
    for path in own:
        write_managed_block(path, content)
    return own


def rename_session(df: DataFrame, old: str, new: str) -> DataFrame:
    """A table with one session under a new name."""
    return df.withColumn("session_id", F.when(F.col("session_id") == old, new).otherwise(F.col("session_id")))
