"""Infrastructure files: Terraform, CloudFormation templates, compose files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import rules
from skein.sources.files import as_json, edge, metadata, node

RESOURCE = r'(?s)resource\s+"([^"]+)"\s+"([^"]+)"\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}'


def _linked(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """depends-on edges (path, from_ref, to_ref) whose target is a node of the same file."""
    return wanted.join(nodes.select("path", F.col("ref").alias("to_ref")).distinct(), ["path", "to_ref"], "left_semi").select(
        "path", *edge(F.col("from_ref"), F.col("to_ref"), "depends-on")
    )


def terraform(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = [F.regexp_extract_all("text", F.lit(RESOURCE), i) for i in (1, 2, 3)]
    r = files.select("path", F.explode(F.arrays_zip(*[c.alias(n) for c, n in zip(found, "knb")])).alias("r")).select("path", "r.*")
    ref = F.concat_ws(".", "k", "n")
    kind = rules.lookup(rules.TERRAFORM_TYPES, F.col("k"), "concept")
    short = F.regexp_replace(F.regexp_replace("k", r"^[^_]*_", ""), "_", " ")
    meta = metadata(resource_type=F.col("k"), resource_name=F.col("n"), provider=F.lit("terraform"), source=F.col("path"))
    nodes = r.select("path", *node(ref, kind, F.left(F.concat(short, F.lit(" "), "n"), F.lit(60)), F.concat(F.lit("Terraform "), "k", F.lit(": "), "n"), "iac_resource", meta))
    listed = F.regexp_extract_all(F.regexp_extract("b", r"depends_on\s*=\s*\[([^\]]+)\]", 1), F.lit(r"([\w.]+)"), 1)
    return nodes, _linked(nodes, r.select("path", ref.alias("from_ref"), F.explode(listed).alias("to_ref")))


def _list(text, path: str):
    """A JSON value that is one text or a list of them, as an array."""
    raw = F.get_json_object(text, path)
    return F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))


def cloudformation(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = files.select("path", F.from_json(as_json(F.col("text")), "Resources map<string,string>").alias("d"))
    r = d.select("path", F.explode("d.Resources").alias("id", "v")).withColumn("k", F.get_json_object("v", "$.Type")).where("k <> ''")
    kind = rules.lookup(rules.CFN_TYPES, F.col("k"), "concept")
    label = F.left(F.concat(F.element_at(F.split("k", "::"), -1), F.lit(" "), "id"), F.lit(60))
    meta = metadata(resource_type=F.col("k"), logical_id=F.col("id"), source=F.col("path"), region=F.get_json_object("v", "$.Properties.Region"))
    nodes = r.select("path", *node(F.col("id"), kind, label, F.concat("k", F.lit(" resource: "), "id"), "iac_resource", meta))
    return nodes, _linked(nodes, r.select("path", F.col("id").alias("from_ref"), F.explode(_list(F.col("v"), "$.DependsOn")).alias("to_ref")))


def compose(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services of compose files with their depends_on, written as a list or a map."""
    d = files.select("path", F.from_json(as_json(F.col("text")), "services map<string,string>").alias("d"))
    s = d.select("path", F.explode("d.services").alias("n", "v")).withColumn("image", F.get_json_object("v", "$.image"))
    summary = F.when(F.col("image").isNotNull(), F.concat(F.lit("Docker service "), "n", F.lit(" using image "), "image")).otherwise(F.concat(F.lit("Docker Compose service: "), "n"))
    meta = metadata(resource_type=F.lit("docker_service"), resource_name=F.col("n"), source=F.col("path"), image=F.col("image"))
    nodes = s.select("path", *node(F.col("n"), F.lit("concept"), F.concat("n", F.lit(" service")), summary, "iac_resource", meta))
    raw = F.get_json_object("v", "$.depends_on")
    names = F.when(raw.startswith("{"), F.json_object_keys(raw)).otherwise(_list(F.col("v"), "$.depends_on"))
    return nodes, _linked(nodes, s.select("path", F.col("n").alias("from_ref"), F.explode(names).alias("to_ref")))


def project(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All three kinds, told apart by name: *.tf, *compose*.yml/.yaml, other JSON and YAML as templates."""
    name = F.col("path")
    tf, comp = name.endswith(".tf"), name.rlike(r"compose[^/]*\.ya?ml$")
    parts = [terraform(files.where(tf)), compose(files.where(comp)), cloudformation(files.where(name.rlike(r"\.(json|ya?ml|template)$") & ~comp))]
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges
