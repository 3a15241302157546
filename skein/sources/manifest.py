"""Dependencies of seven kinds of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.files import metadata, name_of, node, toml_to_json

OUT = ["path", "package", "version", "registry", "is_dev", "full_path"]
DEPENDENCY = r"^([A-Za-z0-9_.-]+)\s*([><=!~^,\s].+)?"


def _row(package: Column, version: Column, registry: str, is_dev: Column, full_path: Column | None = None) -> list[Column]:
    return [
        F.col("path"),
        package.alias("package"),
        F.trim(F.coalesce(version, F.lit(""))).alias("version"),
        F.lit(registry).alias("registry"),
        is_dev.alias("is_dev"),
        (F.lit(None).cast("string") if full_path is None else full_path).alias("full_path"),
    ]


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(name_of(F.col("path")).rlike(pattern)).select("path", "text")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(F.split("text", r"\r?\n")).alias("line"))


def _package_json(files: DataFrame) -> DataFrame:
    d = files.select("path", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("d"))
    parts = [d.select("path", F.explode(f"d.{c}").alias("p", "v"), F.lit(dev).alias("dev")) for c, dev in (("dependencies", False), ("devDependencies", True))]
    return parts[0].unionByName(parts[1]).select(*_row(F.col("p"), F.col("v"), "npm", F.col("dev")))


def _pyproject(files: DataFrame) -> DataFrame:
    schema = "project struct<dependencies:array<string>,`optional-dependencies`:map<string,array<string>>>, tool struct<poetry:struct<dependencies:map<string,string>>>"
    d = files.select("path", F.from_json(toml_to_json("text"), schema).alias("d"))
    main = d.select("path", F.explode("d.project.dependencies").alias("s"), F.lit(False).alias("dev"))
    extra = d.select("path", F.explode("d.project.optional-dependencies").alias("g", "l")).select("path", F.explode("l").alias("s"), (F.col("g") == "dev").alias("dev"))
    listed = main.unionByName(extra).withColumn("s", F.trim("s"))
    a = listed.select(*_row(F.regexp_extract("s", DEPENDENCY, 1), F.regexp_extract("s", DEPENDENCY, 2), "pypi", F.col("dev")))
    poetry = d.select("path", F.explode("d.tool.poetry.dependencies").alias("p", "v")).where("p <> 'python'")
    version = F.when(F.col("v").startswith("{"), "").otherwise(F.col("v"))
    return a.unionByName(poetry.select(*_row(F.col("p"), version, "pypi", F.lit(False))))


def _requirements(files: DataFrame) -> DataFrame:
    form = r"^([A-Za-z0-9_.-]+)\s*([><=!~^].+)?"
    lines = _lines(files).withColumn("line", F.trim("line")).where(~F.col("line").rlike(r"^[#-]") & F.col("line").rlike(form))
    return lines.select(*_row(F.regexp_extract("line", form, 1), F.regexp_extract("line", form, 2), "pypi", F.lit(False)))


def _cargo(files: DataFrame) -> DataFrame:
    schema = "dependencies map<string,string>, `dev-dependencies` map<string,string>, workspace struct<dependencies:map<string,string>>"
    d = files.select("path", F.from_json(toml_to_json("text"), schema).alias("d"))
    version = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.version")).otherwise(F.col("v"))
    out = None
    for c, dev in (("dependencies", False), ("workspace.dependencies", False), ("dev-dependencies", True)):
        col = ".".join(f"`{x}`" for x in c.split(".")) if "." in c else f"`{c}`"
        part = d.select("path", F.explode(F.col(f"d.{col}")).alias("p", "v")).select(*_row(F.col("p"), version, "crates.io", F.lit(dev)))
        part = part.where("version <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def _go_mod(files: DataFrame) -> DataFrame:
    form = r"^\s*([a-zA-Z0-9./~_-]+)\s+(v\S+)"
    lines = _lines(files).where(F.col("line").rlike(form))
    full = F.regexp_extract("line", form, 1)
    out = lines.withColumn("full", full).where("full <> 'go' and not startswith(full, '//')")
    return out.select(*_row(F.regexp_extract("full", r"([^/]+)$", 1), F.regexp_extract("line", form, 2), "pkg.go.dev", F.lit(False), F.col("full")))


def _gemfile(files: DataFrame) -> DataFrame:
    form = r"^\s*gem\s+['\"]([^'\"]+)['\"](?:,\s*['\"]([^'\"]+)['\"])?"
    lines = _lines(files).where(F.col("line").rlike(form))
    return lines.select(*_row(F.regexp_extract("line", form, 1), F.regexp_extract("line", form, 2), "rubygems", F.lit(False)))


def _pom(files: DataFrame) -> DataFrame:
    blocks = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("b"))
    tag = lambda t: F.regexp_extract("b", f"<{t}>([^<]+)</{t}>", 1)
    return blocks.where(tag("artifactId") != "").select(*_row(tag("artifactId"), tag("version"), "maven", tag("scope").isin("test", "provided")))


PARSERS = [
    (r"^package\.json$", _package_json),
    (r"^pyproject\.toml$", _pyproject),
    (r"requirements\.txt$", _requirements),
    (r"^Cargo\.toml$", _cargo),
    (r"^go\.mod$", _go_mod),
    (r"^Gemfile$", _gemfile),
    (r"^pom\.xml$", _pom),
]


def dependencies(files: DataFrame) -> DataFrame:
    """(path, package, version, registry, is_dev, full_path) of all manifests among (path, text); other files give none."""
    out = None
    for pattern, parse in PARSERS:
        part = parse(_named(files, pattern)).select(*OUT)
        out = part if out is None else out.unionByName(part)
    return out


def project_dependencies(files: DataFrame, root: str) -> DataFrame:
    """:func:`dependencies` of the manifests right in a project's folder, not below it, with ``place``, the order of their kinds."""
    top = files.where(F.regexp_extract("path", r"^(?:file:)?/*(.*?)/*[^/]*$", 1) == root.strip("/"))
    names = ["package.json", "pyproject.toml", "requirements.txt", "Cargo.toml", "go.mod", "Gemfile", "pom.xml"]
    known = top.where(name_of(F.col("path")).isin(names))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), name_of(F.col("path")))
    return dependencies(known).withColumn("place", place.cast("int"))


def dependency_nodes(deps: DataFrame) -> DataFrame:
    """A skill node of subtype library for each dependency."""
    label = F.left("package", F.lit(50))
    summary = F.concat(
        "registry", F.lit(" library "), label, F.when(F.col("version") != "", F.concat(F.lit(" "), "version")).otherwise(""), F.when(F.col("is_dev"), " (dev dependency)").otherwise("")
    )
    meta = metadata(version=F.col("version"), registry=F.col("registry"), is_dev=F.col("is_dev"), full_path=F.col("full_path"))
    return deps.select("path", *node(F.concat_ws(":", "registry", "package"), F.lit("skill"), label, summary, "library", meta))
