"""API descriptions: OpenAPI 3, Swagger 2, AsyncAPI 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.files import as_json, metadata, node

METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]


def _keys(col: Column) -> Column:
    return F.coalesce(F.json_object_keys(col), F.array().cast("array<string>"))


def _operations(specs: DataFrame, methods: list[str], base: Column) -> DataFrame:
    paths = specs.select("path", base.alias("base"), F.explode(F.from_json(F.get_json_object("j", "$.paths"), "map<string,map<string,string>>")).alias("p", "ops"))
    ops = paths.select("path", "base", "p", F.explode("ops").alias("m", "op")).where(F.col("m").isin(methods) & F.col("op").startswith("{"))
    at = F.concat(F.upper("m"), F.lit(" "), "base", "p")
    op_id = F.coalesce(F.get_json_object("op", "$.operationId"), F.lit(""))
    text = F.left(F.coalesce(F.get_json_object("op", "$.summary"), F.get_json_object("op", "$.description"), F.lit("")), F.lit(120))
    return ops.select(
        "path", "op", at.alias("at"), F.upper("m").alias("method"), F.concat("base", "p").alias("url"), op_id.alias("op_id"),
        F.left(F.coalesce(F.nullif(op_id, F.lit("")), at), F.lit(60)).alias("label"), F.coalesce(F.nullif(text, F.lit("")), F.concat(F.upper("m"), F.lit(" "), "p")).alias("summary"),
    )


def _schemes(specs: DataFrame, where: str, word: str) -> DataFrame:
    s = specs.select("path", F.explode(F.from_json(F.get_json_object("j", where), "map<string,string>")).alias("n", "v")).where(F.col("v").startswith("{"))
    kind = F.coalesce(F.get_json_object("v", "$.type"), F.lit(""))
    meta = metadata(scheme_name=F.col("n"), type=kind, flows=_keys(F.get_json_object("v", "$.flows")), source=F.col("path"))
    return s.select("path", *node(F.concat(F.lit("auth:"), "n"), F.lit("decision"), F.concat("n", F.lit(" auth")), F.concat(F.lit(f"{word}: "), "n", F.lit(" ("), kind, F.lit(")")), "auth_scheme", meta))


def openapi3(specs: DataFrame) -> DataFrame:
    """A skill per operation, a decision per security scheme, a concept per schema. specs: (path, j), j JSON text."""
    o = _operations(specs, METHODS, F.lit(""))
    answers = F.from_json(F.get_json_object("op", "$.responses"), "map<string,string>")
    content = F.transform(F.map_values(answers), lambda r: F.map_values(F.from_json(F.get_json_object(r, "$.content"), "map<string,string>")))
    refs = F.filter(F.transform(F.flatten(F.filter(content, lambda c: c.isNotNull())), lambda m: F.get_json_object(m, "$.schema['$ref']")), lambda x: x.isNotNull())
    meta = metadata(
        method=F.col("method"), path=F.col("url"), operation_id=F.col("op_id"), tags=F.from_json(F.get_json_object("op", "$.tags"), "array<string>"), status_codes=F.map_keys(answers), source=F.col("path"),
        response_schemas=F.transform(refs, lambda r: F.element_at(F.split(r, "/"), -1)),
    )
    ops = o.select("path", *node(F.concat(F.lit("op:"), "at"), F.lit("skill"), F.col("label"), F.col("summary"), "endpoint", meta))
    s = specs.select("path", F.explode(F.from_json(F.get_json_object("j", "$.components.schemas"), "map<string,string>")).alias("n", "v")).where(F.col("v").startswith("{"))
    props = _keys(F.get_json_object("v", "$.properties"))
    about = F.concat(F.lit("Schema: "), "n", F.when(F.size(props) > 0, F.concat(F.lit(" — "), F.array_join(F.slice(props, 1, 5), ", "))).otherwise(""))
    schemas = s.select("path", *node(F.concat(F.lit("schema:"), "n"), F.lit("concept"), F.left("n", F.lit(60)), about, "schema", metadata(schema_name=F.col("n"), schema_keys=F.slice(props, 1, 10), source=F.col("path"))))
    return ops.unionByName(_schemes(specs, "$.components.securitySchemes", "Security scheme")).unionByName(schemas)


def swagger2(specs: DataFrame) -> DataFrame:
    """A skill per operation, its path under basePath, and a decision per security definition."""
    o = _operations(specs, METHODS[:5], F.coalesce(F.get_json_object("j", "$.basePath"), F.lit("")))
    lists = {k: F.from_json(F.get_json_object("op", f"$.{k}"), "array<string>") for k in ("consumes", "produces")}
    meta = metadata(method=F.col("method"), path=F.col("url"), operation_id=F.col("op_id"), source=F.col("path"), **lists)
    ops = o.select("path", *node(F.concat(F.lit("op:"), "at"), F.lit("skill"), F.col("label"), F.col("summary"), "endpoint", meta))
    return ops.unionByName(_schemes(specs, "$.securityDefinitions", "Security definition"))


def asyncapi(specs: DataFrame) -> DataFrame:
    """A skill per channel and operation."""
    c = specs.select("path", F.explode(F.from_json(F.get_json_object("j", "$.channels"), "map<string,map<string,string>>")).alias("c", "ops"))
    o = c.select("path", "c", F.explode("ops").alias("m", "op")).where(F.col("m").isin("publish", "subscribe"))
    op_id = F.nullif(F.get_json_object("op", "$.operationId"), F.lit(""))
    text = F.nullif(F.get_json_object("op", "$.summary"), F.lit(""))
    label = F.left(F.coalesce(op_id, F.concat("m", F.lit(" "), "c")), F.lit(60))
    about = F.coalesce(text, F.concat(F.lit("AsyncAPI "), "m", F.lit(" on "), "c"))
    return o.select("path", *node(F.concat_ws(":", F.lit("op"), "m", "c"), F.lit("skill"), label, about, "endpoint", metadata(channel=F.col("c"), operation=F.col("m"), source=F.col("path"))))


def api_nodes(files: DataFrame) -> DataFrame:
    """Nodes of the API descriptions among (path, text), JSON or YAML, told apart by their version key."""
    specs = files.select("path", as_json(F.col("text")).alias("j"))
    has = lambda k: F.get_json_object("j", f"$.{k}").isNotNull()
    return (
        openapi3(specs.where(has("openapi")))
        .unionByName(swagger2(specs.where(~has("openapi") & has("swagger"))))
        .unionByName(asyncapi(specs.where(~has("openapi") & ~has("swagger") & has("asyncapi"))))
    )
