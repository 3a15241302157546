"""Notes of a vault: front matter, tags, links."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import all_matches, strip

LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
HEAD = r"(?sd)^---\n(.*?)\n---\n?"


def read_notes(spark: SparkSession, folder: str, most: int = 500) -> DataFrame:
    """(path, text) of the first ``most`` notes by path, without those in system folders."""
    notes = (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return notes.where(~F.col("path").contains("/.obsidian/")).orderBy("path").limit(most)


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """YAML as JSON text; null where it can't be read."""
    import yaml

    def convert(x):
        try:
            return None if x is None else json.dumps(yaml.safe_load(x), default=str, ensure_ascii=False)
        except Exception:
            return None

    return text.map(convert)


def front_matter(notes: DataFrame) -> DataFrame:
    """Notes with ``meta`` (JSON text of the head, null without one), ``body`` and ``tags`` (of the head, a list or a text with
    commas or blanks, then those that begin a line; in lower case, distinct)."""
    head = F.nullif(F.regexp_extract("text", HEAD, 1), F.lit(""))
    out = notes.withColumn("meta", yaml_to_json(head)).withColumn("body", F.regexp_replace("text", HEAD, ""))
    raw = F.get_json_object("meta", "$.tags")
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.filter(F.split(raw, r"[,\s]+"), lambda x: x != ""), F.array().cast("array<string>"))
    inline = all_matches(F.col("body"), r"(?md)^#([A-Za-z0-9_/-]+)")
    return out.withColumn("tags", F.array_distinct(F.transform(F.concat(listed, inline), lambda x: F.lower(F.ltrim(x, F.lit("#"))))))


def note_turns(notes: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(path, role_user, role_assistant) of notes, those with one of ``tags`` if any are asked for: the user side names the note,
    its status and up to five tags, the other holds its body."""
    own = front_matter(notes)
    if tags:
        own = own.where(F.arrays_overlap("tags", F.array(*[F.lit(t.lower()) for t in tags])))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    status = F.get_json_object("meta", "$.status")
    user = F.concat_ws(
        " | ",
        F.concat(F.lit("Note: "), name),
        F.concat(F.lit("status: "), status),
        F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join(F.slice("tags", 1, 5), ", "))),
        F.concat(F.lit("area: "), F.get_json_object("meta", "$.area")),
        F.concat(F.lit("type: "), F.get_json_object("meta", "$.type")),
    )
    return own.select("path", user.alias("role_user"), strip(F.col("body")).alias("role_assistant")).where("role_assistant <> ''")


def wikilink_edges(docs: DataFrame) -> DataFrame:
    """(from_doc, to_doc) of documents (doc_id, text, path) whose text links the name of another's file, case ignored."""
    links = docs.where("text is not null").select(F.col("doc_id").alias("from_doc"), F.explode(all_matches(F.col("text"), LINK)).alias("t"))
    links = links.select("from_doc", F.lower(F.trim("t")).alias("name"))
    names = docs.where("path is not null").select(F.col("doc_id").alias("to_doc"), F.lower(F.regexp_extract("path", r"([^/.]+)\.[^./]+$", 1)).alias("name"))
    return links.join(names, "name").select("from_doc", "to_doc").distinct()
