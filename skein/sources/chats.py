"""Transcript files, chat exports and session exports."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.functions.text import iso_time, strip
from skein.plans.turns import delimited_turns, message_pairs, transcript_turns

ATTACHMENTS = "array<struct<name:string,fileName:string,uri:string,content:string,text:string,mimeType:string,type:string,kind:string>>"


@F.pandas_udf(T.StringType())
def literal_to_json(text: pd.Series) -> pd.Series:
    """A Python literal as JSON text; null where it can't be read."""

    def convert(x):
        try:
            return None if x is None else json.dumps(ast.literal_eval(x), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return text.map(convert)


# Where a workspace may keep its transcripts, the first that has any counts.
TRANSCRIPT_FOLDERS = ["GitHub.copilot-chat/transcripts", "GitHub.copilot-chat/debug-logs", "GitHub.copilot-chat/sessions"]


def transcripts(spark: SparkSession, workspace: str) -> DataFrame:
    """(path, modified) of a workspace's transcript files, the newest first, from the first of the known folders that has any."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(workspace).select("path", F.col("modificationTime").alias("modified"))
    rank = F.lit(None).cast("int")
    for i, folder in reversed(list(enumerate(TRANSCRIPT_FOLDERS))):
        rank = F.when(F.col("path").rlike(f"/{re.escape(folder)}/[^/]+$"), i).otherwise(rank)
    found = listed.withColumn("_r", rank).where("_r is not null")
    first = found.agg(F.min("_r").alias("_m"))
    return found.join(F.broadcast(first), F.col("_r") == F.col("_m")).orderBy(F.desc("modified"), "path").select("path", "modified")


def workspace_turns(spark: SparkSession, workspace: str, session: str | None = None) -> DataFrame:
    """The turns of a workspace's latest transcript, or of the one whose file is named ``session``; none without a transcript."""
    found = transcripts(spark, workspace)
    if session:
        found = found.where(F.col("path").endswith(f"/{session}.jsonl"))
    path = found.limit(1).collect()
    if not path:
        return spark.createDataFrame([], "session_id string, turn_number int, role_user string, role_assistant string, ts string")
    return transcript_turns(read_transcripts(spark, path[0]["path"]))


def with_source(turns: DataFrame, source: str) -> DataFrame:
    """Turns that say where they come from."""
    return turns.withColumn("source", F.lit(source))


def chat_file_turns(files: DataFrame) -> DataFrame:
    """(path, conv, turn_number, role_user, role_assistant) of chat files (path, text): as exports in JSON where that yields a turn, else
    as pasted text with speaker labels."""
    sides = export_messages(files).withColumn("_key", F.concat_ws("\x1f", "path", "conv"))
    pairs = message_pairs(sides, "_key", "pos", "role", "text")
    own = pairs.select(F.split("_key", "\x1f")[0].alias("path"), F.split("_key", "\x1f")[1].alias("conv"), "turn_number", "role_user", "role_assistant")
    rest = files.join(own.select("path").distinct(), "path", "left_anti").where("text is not null")
    return own.unionByName(delimited_turns(rest, "path", "text").select("path", F.lit("0").alias("conv"), "turn_number", "role_user", "role_assistant"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Events (sessionid, line_no, row_id, type, content, starttime) of transcript files, one JSON object a line; blank and
    broken lines are skipped, payloads are taken from ``data`` or the top level, a user's text from ``content`` or ``text``, and
    attachments are added to it. The session is the one named in the file, else the file's name."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_id"), F.col("value").alias("v")
    )
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "row_id")).cast("long") - 1
    lines = lines.withColumn("line_no", place).where(F.try_parse_json("v").isNotNull() & F.get_json_object("v", "$.type").isNotNull())
    # a payload may be written as the text of a Python literal
    lines = lines.withColumn("w", literal_to_json(F.when(F.get_json_object("v", "$.data").startswith("{") & (F.try_parse_json(F.get_json_object("v", "$.data")).isNull() | F.col("v").rlike(r'"data"\s*:\s*"')), F.get_json_object("v", "$.data"))))
    places = [("w", "$."), ("v", "$.data."), ("v", "$.")]
    get = lambda *names: F.coalesce(*[F.get_json_object(c, f"{p}{n}") for n in names for c, p in places])
    att = F.coalesce(F.from_json(get("attachments"), ATTACHMENTS), F.array().cast(ATTACHMENTS))

    def note(a):
        name = F.coalesce(a["name"], a["fileName"], a["uri"], F.lit("attachment"))
        body = F.coalesce(F.nullif(a["content"], F.lit("")), a["text"], F.lit(""))
        image = F.lower(F.coalesce(a["mimeType"], a["type"], F.lit(""))).startswith("image/") | (F.lower(F.coalesce(a["kind"], F.lit(""))) == "image") | F.lower(name).rlike(r"\.(png|jpe?g|gif|webp|bmp)$")
        return (
            F.when(body != "", F.concat(F.lit("[Attached file: "), name, F.lit("]\n"), body))
            .when(image, F.concat(F.lit("[Attached image: "), name, F.lit("]")))
            .when(name != "attachment", F.concat(F.lit("[Attached: "), name, F.lit("]")))
        )

    said = strip(F.coalesce(get("content", "text"), F.lit("")))
    whole = F.concat_ws("\n\n", F.nullif(said, F.lit("")), F.array_compact(F.transform(att, note)))
    start = F.when(F.col("type") == "session.start", get("startTime"))
    events = lines.withColumn("type", F.get_json_object("v", "$.type")).select(
        "file", "line_no", "row_id", "type", F.when(F.col("type") == "user.message", whole).otherwise(said).alias("content"), start.alias("starttime"), get("sessionId").alias("sid")
    )
    named = events.groupBy("file").agg(F.first("sid", True).alias("sid"))
    return events.drop("sid").join(named, "file").select(
        F.coalesce("sid", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]+)?$", 1)).alias("sessionid"), "line_no", "row_id", "type", "content", "starttime"
    )


MESSAGE = "struct<role:string,sender:string,content:string,text:string,created_at:string,uuid:string>"


def export_messages(files: DataFrame) -> DataFrame:
    """(path, conv, pos, role, text) of chat exports among (path, text): a list of messages, an object with messages, or a list
    of conversations with chat_messages; contents are texts or lists of blocks, whose texts are joined by blanks."""
    flat = F.from_json("text", f"array<{MESSAGE}>")
    nested = F.from_json("text", f"messages array<{MESSAGE}>").getField("messages")
    whole = F.from_json("text", f"array<struct<uuid:string,chat_messages:array<{MESSAGE}>>>")
    has_chats = F.exists(F.coalesce(whole, F.array().cast(f"array<struct<uuid:string,chat_messages:array<{MESSAGE}>>>")), lambda c: c["chat_messages"].isNotNull())
    convs = F.when(has_chats, F.transform(whole, lambda c, i: F.struct(F.coalesce(c["uuid"], i.cast("string")).alias("conv"), c["chat_messages"].alias("m")))).otherwise(
        F.array(F.struct(F.lit("0").alias("conv"), F.when(F.ltrim("text").startswith("["), flat).otherwise(nested).alias("m")))
    )
    rows = files.select("path", F.explode(convs).alias("c")).select("path", "c.conv", F.posexplode("c.m").alias("pos", "m"))
    raw = F.coalesce("m.content", "m.text", F.lit(""))
    blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    text = F.when(raw.startswith("[") & blocks.isNotNull(), joined).otherwise(raw)
    role = F.lower(F.coalesce("m.role", "m.sender", F.lit("")))
    return rows.select("path", "conv", "pos", F.when(role == "human", "user").otherwise(role).alias("role"), strip(text).alias("text"))


NODE = "struct<id:string,type:string,label:string,summary:string,status:string,confidence:double,subtype:string,source_url:string,metadata:string,created_at:string,updated_at:string>"
EDGE = "struct<id:string,from_id:string,to_id:string,relation:string,weight:double,created_at:string>"


def session_export(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of session exports among (path, text): embeddings left out, the session they come from noted, edges
    without both nodes dropped."""
    d = files.select("path", F.from_json("text", f"session_id string, nodes array<{NODE}>, edges array<{EDGE}>").alias("d")).select("path", "d.*")
    d = d.withColumn("session_id", F.coalesce("session_id", F.lit("unknown")))
    n = d.select("path", "session_id", F.explode("nodes").alias("n")).select("path", F.col("session_id").alias("original_session_id"), "n.*").where("id is not null and label is not null")
    n = n.withColumn("created_at", iso_time(F.col("created_at"))).withColumn("updated_at", iso_time(F.col("updated_at")))
    e = d.select("path", F.explode("edges").alias("e")).select("path", "e.*")
    ids = n.select("path", "id").distinct()
    for end in ("from_id", "to_id"):
        e = e.join(ids.withColumnRenamed("id", end), ["path", end], "left_semi")
    return n, e


def export_summary(files: DataFrame) -> DataFrame:
    """(path, session_id, n_nodes, n_edges) without building rows."""
    d = F.from_json("text", "session_id string, nodes array<string>, edges array<string>")
    return files.select("path", F.coalesce(d["session_id"], F.lit("unknown")).alias("session_id"), F.coalesce(F.size(d["nodes"]), F.lit(0)).alias("n_nodes"), F.coalesce(F.size(d["edges"]), F.lit(0)).alias("n_edges"))


def workspaces(spark: SparkSession, root: str) -> DataFrame:
    """(folder, uri, modified) of the workspaces under a storage root, from their workspace.json files."""
    w = spark.read.text(f"{root}/*/workspace.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("p"), F.get_json_object("value", "$.folder").alias("uri"), F.col("_metadata.file_modification_time").alias("modified")
    )
    return w.select(F.regexp_extract("p", r"^(.*)/workspace\.json$", 1).alias("folder"), "uri", "modified")


def find_workspace(spark: SparkSession, root: str, project: str) -> str | None:
    """The workspace folder whose uri names the project, else the one changed last; None without any."""
    w = workspaces(spark, root)
    match = F.coalesce(F.rtrim("uri", F.lit("/")).endswith(project.rstrip("/")), F.lit(False))
    found = w.agg(F.max_by("folder", F.struct(match, "modified")).alias("f")).first()
    return found["f"]
