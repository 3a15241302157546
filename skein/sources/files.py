"""Reading whole files as rows, and the common shape of what structured files yield.

Parsers take rows (path, text) and give nodes (path, ref, type, label, summary, subtype, metadata) and edges (path, from_ref,
to_ref, relation, weight); ref names a node within its file. Broken files give no rows. Everything but YAML and TOML, which are
turned into JSON text by one vectorised function each, is parsed by built-in functions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.vault import yaml_to_json


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, text, modified) of the files of a folder, one row a file."""
    r = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return r.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def latest_file(files: DataFrame) -> DataFrame:
    """The file changed last."""
    return files.agg(F.max_by(F.struct("path", "text"), "modified").alias("f")).select("f.*")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


@F.pandas_udf(T.StringType())
def toml_to_json(text: pd.Series) -> pd.Series:
    """TOML as JSON text; null where it can't be read."""
    import tomllib

    def convert(x):
        try:
            return None if x is None else json.dumps(tomllib.loads(x), default=str, ensure_ascii=False)
        except Exception:
            return None

    return text.map(convert)


def as_json(text: Column) -> Column:
    """JSON text of JSON or YAML; null for neither."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull(), text).otherwise(yaml_to_json(F.when(parsed.isNull(), text)))


def metadata(**values: Column) -> Column:
    """A JSON text of the values that aren't null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]))


def node(ref: Column, kind: Column, label: Column, summary: Column, subtype: str | None, meta: Column) -> list[Column]:
    return [ref.alias("ref"), kind.alias("type"), label.alias("label"), summary.alias("summary"), F.lit(subtype).alias("subtype"), meta.alias("metadata")]


def edge(a: Column, b: Column, relation: str) -> list[Column]:
    return [a.alias("from_ref"), b.alias("to_ref"), F.lit(relation).alias("relation"), F.lit(1.0).alias("weight")]


def to_graph(nodes: DataFrame, edges: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """Parser rows as graph rows of a session: ids are hashes of session, path and ref, status active, confidence 1."""

    def ident(ref: str) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(session_id), "path", ref), 256)

    n = nodes.select(
        F.lit(session_id).alias("session_id"), ident("ref").alias("id"), "type", "label", "summary", F.lit("active").alias("status"), F.lit(1.0).alias("confidence"), "subtype", "metadata"
    )
    e = edges.select(F.lit(session_id).alias("session_id"), ident("from_ref").alias("from_id"), ident("to_ref").alias("to_id"), "relation", "weight")
    return n, e
