"""Queries of the readers: files are written from the rows of a table, as texts, and read again; SQL gives what must come back
from the same rows. Every row makes a file; its key says of which kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.queries import QUERIES, SQL, query
from skein.session import table
from skein.sources import apispec, chats, documents, iac, manifest, testreport, vault

__all__ = ["QUERIES", "SQL"]


def _filled(template: str, **values: Column) -> Column:
    """A text with {names} replaced by columns, other braces doubled as in a format string."""
    out, at = [], 0
    plain = template.replace("{{", "\x01").replace("}}", "\x02")
    while (i := plain.find("{", at)) >= 0:
        j = plain.index("}", i)
        out += [F.lit(plain[at:i]), values[plain[i + 1 : j]].cast("string")]
        at = j + 1
    return F.translate(F.concat(*out, F.lit(plain[at:])), "\x01\x02", "{}")


def _files(spark: SparkSession, root: str, kinds: list[tuple[str, str]]) -> DataFrame:
    """(path, text): for each part a file of the kind its key says, from (ending of the path, template with {k} and {n})."""
    p = table(spark, root, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace("p_name", "[^A-Za-z0-9]", "").alias("n"))
    which = F.col("k") % len(kinds)
    path, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (ending, template) in enumerate(kinds):
        path = F.when(which == i, F.concat(F.lit("/src/"), "k", F.lit(ending))).otherwise(path)
        text = F.when(which == i, _filled(template, k=F.col("k"), n=F.col("n"))).otherwise(text)
    return p.select(path.alias("path"), text.alias("text"))


_PARTS = "(SELECT p_partkey AS k, regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') AS n FROM part)"

_IAC = [
    ("/main.tf", 'resource "aws_s3_bucket" "b{k}" {{\n  bucket = "{n}"\n  depends_on = [aws_subnet.s{k}, aws_lb.gone]\n}}\nresource "aws_subnet" "s{k}" {{\n  tags = {{ a = "b" }}\n}}\n'),
    ("/template.json", '{{"Resources": {{"B{k}": {{"Type": "AWS::S3::Bucket", "DependsOn": "R{k}"}}, "R{k}": {{"Type": "AWS::IAM::Role"}}, "X": {{"Type": "AWS::Odd::Thing", "DependsOn": ["B{k}", "Y"]}}}}}}'),
    ("/docker-compose.yml", "services:\n  web{k}:\n    image: img:{k}\n    depends_on: [db, cache]\n  db:\n    build: .\n"),
]


@query(
    f"""SELECT '/src/' || k || p AS path, replace(ref, '#', k::VARCHAR) AS ref, type, left(replace(label, '#', k::VARCHAR), 60) AS label FROM {_PARTS} JOIN (VALUES
    (0, '/main.tf', 'aws_s3_bucket.b#', 'decision', 's3 bucket b#'), (0, '/main.tf', 'aws_subnet.s#', 'concept', 'subnet s#'),
    (1, '/template.json', 'B#', 'decision', 'Bucket B#'), (1, '/template.json', 'R#', 'concept', 'Role R#'), (1, '/template.json', 'X', 'concept', 'Thing X'),
    (2, '/docker-compose.yml', 'web#', 'concept', 'web# service'), (2, '/docker-compose.yml', 'db', 'concept', 'db service')) v(i, p, ref, type, label) ON k % 3 = i"""
)
def source_infrastructure(spark, root):
    return iac.project(_files(spark, root, _IAC))[0].select("path", "ref", "type", "label")


@query(
    f"""SELECT '/src/' || k || p AS path, replace(a, '#', k::VARCHAR) AS from_ref, replace(b, '#', k::VARCHAR) AS to_ref, 'depends-on' AS relation FROM {_PARTS} JOIN (VALUES
    (0, '/main.tf', 'aws_s3_bucket.b#', 'aws_subnet.s#'), (1, '/template.json', 'B#', 'R#'), (1, '/template.json', 'X', 'B#'), (2, '/docker-compose.yml', 'web#', 'db')) v(i, p, a, b) ON k % 3 = i"""
)
def source_infrastructure_edges(spark, root):
    return iac.project(_files(spark, root, _IAC))[1].select("path", "from_ref", "to_ref", "relation")


_MANIFESTS = [
    ("/package.json", '{{"dependencies": {{"a{k}": "^1.{k}"}}, "devDependencies": {{"{n}": "2"}}}}'),
    ("/pyproject.toml", '[project]\ndependencies = ["a{k}>=1.{k}"]\n[project.optional-dependencies]\ndev = ["{n}"]\n'),
    ("/requirements.txt", "# made\n-r base.txt\na{k}>=1.{k}\n{n}\n"),
    ("/Cargo.toml", '[dependencies]\na{k} = "1.{k}"\n[dev-dependencies]\n{n} = {{ version = "2" }}\n'),
    ("/go.mod", "module x\n\ngo 1.21\n\nrequire (\n\texample.org/x/a{k} v1.{k}\n)\n"),
    ("/Gemfile", "source 'x'\ngem 'a{k}', '~> 1.{k}'\n  gem \"{n}\"\n"),
    ("/pom.xml", "<project><dependencies><dependency><artifactId>a{k}</artifactId><version>1.{k}</version></dependency><dependency><artifactId>{n}</artifactId><scope>test</scope></dependency></dependencies></project>"),
]


@query(
    f"""SELECT '/src/' || k || p AS path, replace(replace(package, '#', k::VARCHAR), '@', n) AS package, replace(v, '#', k::VARCHAR) AS version, r AS registry, d AS is_dev FROM {_PARTS} JOIN (VALUES
    (0, '/package.json', 'a#', '^1.#', 'npm', false), (0, '/package.json', '@', '2', 'npm', true), (1, '/pyproject.toml', 'a#', '>=1.#', 'pypi', false), (1, '/pyproject.toml', '@', '', 'pypi', true),
    (2, '/requirements.txt', 'a#', '>=1.#', 'pypi', false), (2, '/requirements.txt', '@', '', 'pypi', false), (3, '/Cargo.toml', 'a#', '1.#', 'crates.io', false), (3, '/Cargo.toml', '@', '2', 'crates.io', true),
    (4, '/go.mod', 'a#', 'v1.#', 'pkg.go.dev', false), (5, '/Gemfile', 'a#', '~> 1.#', 'rubygems', false), (5, '/Gemfile', '@', '', 'rubygems', false),
    (6, '/pom.xml', 'a#', '1.#', 'maven', false), (6, '/pom.xml', '@', '', 'maven', true)) v(i, p, package, v, r, d) ON k % 7 = i"""
)
def source_manifests(spark, root):
    return manifest.dependencies(_files(spark, root, _MANIFESTS)).select("path", "package", "version", "registry", "is_dev")


_REPORTS = [
    ("/jest.json", '{{"testResults": [{{"testFilePath": "/t/{n}.js", "testResults": [{{"fullName": "case {k}", "status": "failed", "failureMessages": ["no {k}"]}}, {{"title": "fine", "status": "passed"}}]}}]}}'),
    ("/pytest.json", '{{"tests": [{{"nodeid": "t/{n}.py::test_{k}", "outcome": "failed", "call": {{"crash": {{"message": "no {k}", "lineno": {k} }}}}}}, {{"nodeid": "t/x.py::ok", "outcome": "passed"}}]}}'),
    ("/junit.xml", '<testsuites><testsuite name="{n}"><testcase name="case{k}" classname="C"><failure message="at x:{k}"/></testcase><testcase name="ok"/><testcase name="s"><skipped/></testcase></testsuite></testsuites>'),
]


@query(
    f"""SELECT '/src/' || k || p AS path, t AS tool, replace(f, '@', n) AS file, replace(c, '#', k::VARCHAR) AS test, CASE WHEN i > 0 THEN k END AS line, replace(m, '#', k::VARCHAR) AS message FROM {_PARTS} JOIN (VALUES
    (0, '/jest.json', 'jest', '/t/@.js', 'case #', 'no #'), (1, '/pytest.json', 'pytest', 't/@.py', 'test_#', 'no #'), (2, '/junit.xml', 'junit', '@', 'C.case#', 'at x:#')) v(i, p, t, f, c, m) ON k % 3 = i"""
)
def source_test_reports(spark, root):
    return testreport.failures(_files(spark, root, _REPORTS)).select("path", "tool", "file", "test", "line", "message")


_SPECS = [
    ("/openapi.json", '{{"openapi": "3.0.0", "paths": {{"/p/{k}": {{"get": {{"operationId": "get{n}", "summary": "read {k}"}}, "post": {{}}}}}}, "components": {{"securitySchemes": {{"key{k}": {{"type": "apiKey"}}}}, "schemas": {{"S{k}": {{"properties": {{"a": {{}}, "b": {{}}}}}}}}}}}}'),
    ("/swagger.yaml", "swagger: '2.0'\nbasePath: /v1\npaths:\n  /p/{k}:\n    put:\n      description: write {k}\n"),
    ("/asyncapi.json", '{{"asyncapi": "2.0.0", "channels": {{"c/{k}": {{"publish": {{"operationId": "send{n}"}}, "subscribe": {{"summary": "hear {k}"}}}}}}}}'),
]


@query(
    f"""SELECT '/src/' || k || p AS path, t AS type, replace(replace(l, '#', k::VARCHAR), '@', n) AS label, replace(s, '#', k::VARCHAR) AS summary FROM {_PARTS} JOIN (VALUES
    (0, '/openapi.json', 'skill', 'get@', 'read #'), (0, '/openapi.json', 'skill', 'POST /p/#', 'POST /p/#'), (0, '/openapi.json', 'decision', 'key# auth', 'Security scheme: key# (apiKey)'), (0, '/openapi.json', 'concept', 'S#', 'Schema: S# — a, b'),
    (1, '/swagger.yaml', 'skill', 'PUT /v1/p/#', 'write #'), (2, '/asyncapi.json', 'skill', 'send@', 'AsyncAPI publish on c/#'), (2, '/asyncapi.json', 'skill', 'subscribe c/#', 'hear #')) v(i, p, t, l, s) ON k % 3 = i"""
)
def source_api_specs(spark, root):
    return apispec.api_nodes(_files(spark, root, _SPECS)).select("path", "type", "label", "summary")


_NOTE = "---\ntags: [Big{k}, '#plan']\nstatus: draft\n---\nAbout {n}.\n#inline/{k} at the start\n"


@query(
    f"SELECT '/src/' || k || '/note.md' AS path, 'Note: note | status: draft | tags: big' || k || ', plan, inline/' || k AS role_user, 'About ' || n || '.' || chr(10) || '#inline/' || k || ' at the start' AS role_assistant FROM {_PARTS}"
)
def source_notes(spark, root):
    return vault.note_turns(_files(spark, root, [("/note.md", _NOTE)])).select("path", "role_user", "role_assistant")


_HINT = "CASE k % 3 WHEN 0 THEN ' [decision — new feature]' WHEN 1 THEN ' [error — bug fix]' ELSE '' END"


@query(f"SELECT k::VARCHAR AS hash, 'Commit ' || left(k::VARCHAR, 8) || ': ' || CASE k % 3 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'fix(x): ' ELSE '' END || n || {_HINT} AS role_user, 'body ' || k || chr(10) || 'Changed files: a.py, ' || n || '.md' AS role_assistant FROM {_PARTS}")
def source_commits(spark, root):
    p = table(spark, root, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace("p_name", "[^A-Za-z0-9]", "").alias("n"))
    mark = F.when(F.col("k") % 3 == 0, "feat: ").when(F.col("k") % 3 == 1, "fix(x): ").otherwise("")
    c = p.select(
        F.col("k").cast("string").alias("hash"), F.concat(mark, "n").alias("subject"), F.concat(F.lit("body "), "k").alias("body"), F.array(F.lit("a.py"), F.concat("n", F.lit(".md"))).alias("files")
    )
    return documents.commit_turns(c)


_STRIPPED = r"regexp_replace(coalesce(text, ''), '^[\t\n\x0b\f\r\x{85}\p{Z}]+|[\t\n\x0b\f\r\x{85}\p{Z}]+$', '', 'g')"


@query(f"SELECT row_id::VARCHAR AS path, CASE WHEN row_id % 3 = 2 THEN 'c' || row_id ELSE '0' END AS conv, 0 AS pos, CASE lower(coalesce(sender, '')) WHEN 'human' THEN 'user' ELSE lower(coalesce(sender, '')) END AS role, {_STRIPPED} AS text FROM claude_export")
def source_chat_exports(spark, root):
    """Every message as an export file of its own, in the three shapes: a list, an object with messages, a list of chats."""
    e = table(spark, root, "claude_export")
    own = F.struct(F.col("sender"), F.when(F.col("row_id") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("row_id") % 2 == 1, F.col("text")).alias("content"))
    shapes = [F.to_json(F.array(own)), F.to_json(F.struct(F.array(own).alias("messages"))), F.to_json(F.array(F.struct(F.concat(F.lit("c"), "row_id").alias("uuid"), F.array(own).alias("chat_messages"))))]
    text = F.when(F.col("row_id") % 3 == 0, shapes[0]).when(F.col("row_id") % 3 == 1, shapes[1]).otherwise(shapes[2])
    return chats.export_messages(e.select(F.col("row_id").cast("string").alias("path"), text.alias("text")))


@query("SELECT seq::VARCHAR AS path, coalesce(session_id, 'unknown') AS original_session_id, id, type, label, status, epoch_us(date_trunc('second', created_at)) AS created FROM nodes WHERE id IS NOT NULL AND label IS NOT NULL")
def source_session_exports(spark, root):
    """Every node as a session export of its own."""
    n = table(spark, root, "nodes")
    own = F.struct("id", "type", "label", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    text = F.to_json(F.struct("session_id", F.array(own).alias("nodes"), F.array().cast("array<string>").alias("edges")))
    nodes, _ = chats.session_export(n.select(F.col("seq").cast("string").alias("path"), text.alias("text")))
    return nodes.select("path", "original_session_id", "id", "type", "label", "status", F.unix_micros("created_at").alias("created"))
