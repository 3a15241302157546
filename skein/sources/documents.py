"""Documents, commits and PDF pages as turns."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import commit_hint, document_format, markdown_sections, paragraph_chunks
from skein.sources.vault import yaml_to_json

MOST = 4000


def sections(files: DataFrame) -> DataFrame:
    """(path, section_no, heading, body) of documents (path, text) by their format: Markdown by headings, JSON and YAML by
    top-level keys (each at most 4,000 characters), text in packed paragraphs. What can't be read is one section."""
    d = files.withColumn("f", document_format(F.col("path"))).withColumn("y", yaml_to_json(F.when(F.col("f") == "yaml", F.col("text"))))
    j = F.when(F.col("f") == "json", F.col("text")).otherwise(F.col("y"))
    table = F.from_json(j, "map<string,string>")
    one = F.array(F.struct(F.lit("").alias("heading"), F.col("text").alias("body")))
    # a key's value keeps its JSON text; texts are quoted again
    keyed = F.transform(
        F.map_entries(table),
        lambda e: F.struct(e["key"].alias("heading"), F.left(F.concat(F.lit('{\n  "'), e["key"], F.lit('": '), F.when(F.try_parse_json(e["value"]).isNotNull(), e["value"]).otherwise(F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)), F.lit("\n}")), F.lit(MOST)).alias("body")),
    )
    by_key = F.when(F.size(F.map_keys(table)) > 0, keyed).otherwise(one)
    packed = F.transform(paragraph_chunks(F.col("text"), MOST), lambda c: F.struct(F.lit("").alias("heading"), c.alias("body")))
    s = F.when(F.col("f") == "markdown", markdown_sections(F.col("text"), MOST)).when(F.col("f").isin("json", "yaml"), by_key).otherwise(packed)
    return d.where("text is not null").select("path", F.posexplode(s).alias("n", "s")).select("path", (F.col("n") + 1).alias("section_no"), "s.heading", "s.body")


def document_turns(files: DataFrame, most: int = MOST) -> DataFrame:
    """(path, turn_number, role_user, role_assistant): a turn per non-empty section; numbers keep the gaps of empty ones."""
    s = sections(files).where("trim(body) <> ''")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    user = F.concat(F.lit("Document: "), name, F.when(F.col("heading") != "", F.concat(F.lit(" — section: "), "heading")).otherwise(""))
    return s.select("path", F.col("section_no").alias("turn_number"), user.alias("role_user"), F.left("body", F.lit(most)).alias("role_assistant"))


def git_log(spark: SparkSession, repository: str, most: int = 100) -> DataFrame:
    """(hash, subject, body, date, files) of the last commits of a repository, read on the driver; fields are parted by
    characters that texts don't hold, so bodies may have many lines."""
    run = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, timeout=15, check=True).stdout
    text = run("log", f"-{most}", "--name-only", "--pretty=format:%x1e%H%x1f%s%x1f%b%x1f%ai%x1f")
    rows = []
    for entry in text.split("\x1e")[1:]:
        h, subject, body, date, names = entry.split("\x1f")
        rows.append((h, subject, body.strip(), date, [x for x in names.split("\n") if x]))
    return spark.createDataFrame(rows, "hash string, subject string, body string, date string, files array<string>")


def commit_turns(commits: DataFrame) -> DataFrame:
    """(hash, role_user, role_assistant): a turn per commit with its kind and up to ten changed files."""
    hint = commit_hint(F.col("subject"))
    user = F.concat(F.lit("Commit "), F.left("hash", F.lit(8)), F.lit(": "), "subject", F.when(hint != "", F.concat(F.lit(" ["), hint, F.lit("]"))).otherwise(""))
    changed = F.when(F.size("files") > 0, F.concat(F.lit("Changed files: "), F.array_join(F.slice("files", 1, 10), ", ")))
    return commits.select("hash", user.alias("role_user"), F.concat_ws("\n", F.nullif(F.col("body"), F.lit("")), changed).alias("role_assistant"))


def files_by_commit(lines: DataFrame) -> DataFrame:
    """(hash, file) of log lines (log, pos, line) in which ``COMMIT:<hash>`` begins the files of a commit."""
    mark = F.when(F.col("line").startswith("COMMIT:"), F.substring("line", 8, 1000))
    upto = Window.partitionBy("log").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("hash", F.last(mark, True).over(upto)).where("hash is not null and line <> '' and not startswith(line, 'COMMIT:')").select("log", "hash", F.col("line").alias("file"))


# The documents of a project that are read, in this order.
PROJECT_DOCS = ["README.md", "CONTRIBUTING.md", "HANDOVER.md", "CHANGELOG.md", "ARCHITECTURE.md", "DECISIONS.md", "ADR.md", "docs/README.md"]


def project_turns(files: DataFrame, root: str, commits: DataFrame | None = None) -> DataFrame:
    """(turn_number, source, role_user, role_assistant) of a project: a turn for each commit (rows of :func:`commit_turns` with ``pos``,
    their order), then those of its documents among (path, text), numbered through."""
    place = F.lit(None).cast("int")
    for i, name in enumerate(PROJECT_DOCS):
        place = F.when(F.col("path").endswith(f"{root.rstrip('/')}/{name}"), i).otherwise(place)
    own = files.withColumn("_p", place).where("_p is not null")
    docs = document_turns(own.select("path", "text")).join(own.select("path", "_p"), "path")
    rows = docs.select(F.lit(1).alias("_k"), F.col("_p").cast("long").alias("_a"), F.col("turn_number").cast("long").alias("_b"), F.lit("codebase_doc").alias("source"), "role_user", "role_assistant")
    if commits is not None:
        rows = rows.unionByName(commits.select(F.lit(0).alias("_k"), F.col("pos").cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), F.lit("codebase").alias("source"), "role_user", "role_assistant"))
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_k", "_a", "_b"))
    return rows.select(number.alias("turn_number"), "source", "role_user", "role_assistant")


def pdf_pages(spark: SparkSession, folder: str, most: int = MOST) -> DataFrame:
    """(path, page, chunk_no, text) of PDF files, pages packed into chunks; needs the optional package pypdf."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder).select("path", "content")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"]):
                pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
                yield pd.DataFrame({"path": path, "page": range(1, len(pages) + 1), "text": pages})

    pages = raw.mapInPandas(read, "path string, page int, text string")
    return pages.select("path", "page", F.posexplode(paragraph_chunks(F.col("text"), most)).alias("n", "text")).select("path", "page", (F.col("n") + 1).alias("chunk_no"), "text")
