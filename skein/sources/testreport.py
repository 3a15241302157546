"""Failures of test reports: Jest and pytest JSON, JUnit XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.files import edge, metadata, name_of, node

JEST = "testResults array<struct<testFilePath:string,testResults:array<struct<fullName:string,title:string,status:string,failureMessages:array<string>>>>>"
PYTEST = "tests array<struct<nodeid:string,outcome:string,call:struct<crash:struct<message:string,lineno:int>,longrepr:string>>>"
_CASE = "array<struct<_name:string,_classname:string,failure:struct<_message:string,_VALUE:string>,error:struct<_message:string,_VALUE:string>,skipped:string>>"
_SUITE = f"_name string, _file string, testcase {_CASE}"
_SUITES = f"testsuite array<struct<_name:string,_file:string,testcase:{_CASE}>>"


def short_label(name: Column) -> Column:
    """The first six words, at most 60 characters."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(name, r"[_:]", " "), r"\s+", " ")), " ")
    return F.left(F.array_join(F.slice(words, 1, 6), " "), F.lit(60))


def failures(files: DataFrame) -> DataFrame:
    """(path, tool, file, test, line, message): every test that didn't pass (skipped ones too, except in JUnit) of the reports
    among (path, text), recognised by their keys or root element. Suites without a failure have a row with a null test."""
    j = files.select("path", F.from_json("text", JEST).alias("r")).where("r.testResults is not null")
    j = j.select("path", F.explode("r.testResults").alias("s")).select("path", F.coalesce("s.testFilePath", F.lit("unknown")).alias("file"), F.explode_outer(F.filter("s.testResults", lambda t: ~(F.coalesce(t["status"], F.lit("")) == "passed"))).alias("t"))
    test = F.coalesce(F.nullif(F.col("t.fullName"), F.lit("")), "t.title")
    message = F.left(F.coalesce(F.try_element_at("t.failureMessages", F.lit(1)), F.lit("")), F.lit(300))
    jest = j.select("path", F.lit("jest").alias("tool"), "file", test.alias("test"), F.lit(None).cast("int").alias("line"), message.alias("message"))

    p = files.select("path", F.from_json("text", PYTEST).alias("r")).where("r.tests is not null").select("path", F.explode("r.tests").alias("t"))
    p = p.where("coalesce(t.outcome, '') <> 'passed'")
    node_id = F.coalesce(F.col("t.nodeid"), F.lit(""))
    scoped = F.contains(node_id, F.lit("::"))
    message = F.left(F.coalesce(F.nullif(F.col("t.call.crash.message"), F.lit("")), "t.call.longrepr", F.lit("")), F.lit(300))
    pytest = p.select(
        "path", F.lit("pytest").alias("tool"), F.when(scoped, F.element_at(F.split(node_id, "::"), 1)).otherwise("unknown").alias("file"),
        F.element_at(F.split(node_id, "::"), -1).alias("test"), F.col("t.call.crash.lineno").alias("line"), message.alias("message"),
    )

    xml = files.where(F.col("text").rlike(r"(?s)^\s*(<\?xml[^>]*>\s*)?<testsuite"))
    many = xml.where(F.col("text").rlike("<testsuites[ >]")).select("path", F.explode(F.from_xml("text", _SUITES).getField("testsuite")).alias("s"))
    one = xml.where(~F.col("text").rlike("<testsuites[ >]")).select("path", F.from_xml("text", _SUITE).alias("s"))
    x = many.unionByName(one)
    bad = F.filter("s.testcase", lambda c: c["skipped"].isNull() & (c["failure"].isNotNull() | c["error"].isNotNull()))
    x = x.select("path", F.coalesce("s._file", "s._name", F.lit("unknown")).alias("file"), F.explode_outer(bad).alias("t"))
    told = F.coalesce("t.failure", "t.error")
    message = F.left(F.coalesce(F.nullif(told["_message"], F.lit("")), told["_VALUE"], F.lit("")), F.lit(300))
    name = F.concat(F.when(F.coalesce("t._classname", F.lit("")) != "", F.concat("t._classname", F.lit("."))).otherwise(""), "t._name")
    junit = x.select(
        "path", F.lit("junit").alias("tool"), "file", F.when(F.col("t").isNotNull(), name).alias("test"), F.nullif(F.regexp_extract(message, r":(\d+)", 1), F.lit("")).try_cast("int").alias("line"), message.alias("message")
    )
    return jest.unionByName(pytest).unionByName(junit)


def report_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A file node per test file, an error node per failure, and tested-by edges between them."""
    found = failures(files)
    file_ref = F.concat(F.lit("file:"), "file")
    label = F.when(F.col("file") == "unknown", "test file").otherwise(name_of(F.col("file")))
    file_nodes = found.select("path", "file").distinct().select(
        "path", *node(file_ref, F.lit("file"), label, F.concat(F.lit("Test file: "), "file"), None, metadata(path=F.col("file"), language=F.lit("test")))
    )
    bad = found.where("test is not null")
    ref = F.concat(F.lit("test:"), "file", F.lit(":"), "test")
    title = F.when(F.col("tool") == "jest", "Jest").when(F.col("tool") == "junit", "JUnit").otherwise(F.col("tool"))
    summary = F.concat(title, F.lit(": "), "test", F.when(F.col("message") != "", F.concat(F.lit(" — "), F.left("message", F.lit(100)))).otherwise(""))
    short = short_label(F.when(F.col("tool") == "junit", F.regexp_extract("test", r"([^.]+)$", 1)).otherwise(F.col("test")))
    meta = metadata(test_name=F.col("test"), file=F.col("file"), line=F.col("line"), assertion=F.col("message"), tool=F.col("tool"))
    errors = bad.select("path", *node(ref, F.lit("error"), short, summary, "test_failure", meta))
    return file_nodes.unionByName(errors), bad.select("path", *edge(ref, file_ref, "tested-by"))
