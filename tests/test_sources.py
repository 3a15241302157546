"""Files of every supported kind."""

import json

import pytest
from pyspark.sql import functions as F

from skein.plans import turns
from skein.sources import apispec, chats, documents, files, iac, manifest, testreport, vault


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_manifests(spark):
    rows = texts(
        spark,
        ("a/package.json", json.dumps({"dependencies": {"react": "^18"}, "devDependencies": {"jest": "29"}})),
        ("a/requirements.txt", "# x\nrequests>=2.0\n-r other.txt\n\nnumpy\n"),
        ("a/pyproject.toml", '[project]\ndependencies = ["httpx >=0.2"]\n[project.optional-dependencies]\ndev = ["pytest"]\n[tool.poetry.dependencies]\npython = "3"\nrich = {version = "1"}\n'),
        ("a/Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["x"] }\n[dev-dependencies]\nrand = "0.8"\n'),
        ("a/go.mod", "module x\nrequire (\n\tgithub.com/foo/bar v1.2.3\n)\n"),
        ("a/Gemfile", "gem 'rails', '~> 7'\ngem \"puma\"\n"),
        ("a/pom.xml", "<dependency><artifactId>junit</artifactId><version>4</version><scope>test</scope></dependency>"),
        ("a/broken/package.json", "{"),
        ("a/other.txt", "requests"),
    )
    got = {(r.package, r.version, r.registry, r.is_dev) for r in manifest.dependencies(rows).collect()}
    assert got == {
        ("react", "^18", "npm", False), ("jest", "29", "npm", True), ("requests", ">=2.0", "pypi", False), ("numpy", "", "pypi", False),
        ("httpx", ">=0.2", "pypi", False), ("pytest", "", "pypi", True), ("rich", "", "pypi", False), ("serde", "1.0", "crates.io", False),
        ("tokio", "1.2", "crates.io", False), ("rand", "0.8", "crates.io", True), ("bar", "v1.2.3", "pkg.go.dev", False),
        ("rails", "~> 7", "rubygems", False), ("puma", "", "rubygems", False), ("junit", "4", "maven", True),
    }
    node = manifest.dependency_nodes(manifest.dependencies(rows)).where("label = 'jest'").first()
    assert node.summary == "npm library jest 29 (dev dependency)" and node.type == "skill"


def test_test_reports(spark):
    jest = {"numPassedTests": 1, "testResults": [{"testFilePath": "src/a.test.js", "testResults": [{"fullName": "adds", "status": "passed"}, {"fullName": "subtracts two numbers", "status": "failed", "failureMessages": ["expected 1"]}]}]}
    pytest_report = {"tests": [{"nodeid": "tests/t.py::test_x", "outcome": "failed", "call": {"crash": {"message": "boom", "lineno": 42}}}, {"nodeid": "tests/t.py::test_y", "outcome": "passed"}]}
    junit = '<testsuites><testsuite name="s" file="t.xml"><testcase name="a" classname="C"><failure message="at f.py:7">x</failure></testcase><testcase name="b"/><testcase name="c"><skipped/></testcase></testsuite></testsuites>'
    single = '<testsuite name="only"><testcase name="z"><error message="bad"/></testcase></testsuite>'
    rows = texts(spark, ("j.json", json.dumps(jest)), ("p.json", json.dumps(pytest_report)), ("u.xml", junit), ("v.xml", single))
    got = {(r.tool, r.file, r.test, r.line) for r in testreport.failures(rows).collect()}
    assert got == {("jest", "src/a.test.js", "subtracts two numbers", None), ("pytest", "tests/t.py", "test_x", 42), ("junit", "t.xml", "C.a", 7), ("junit", "only", "z", None)}
    nodes, edges = testreport.report_graph(rows)
    assert nodes.where("type = 'file'").count() == 4 and nodes.where("type = 'error'").count() == 4
    assert {r.relation for r in edges.collect()} == {"tested-by"} and edges.count() == 4


def test_infrastructure(spark):
    tf = 'resource "aws_lambda_function" "f" {\n  depends_on = [aws_iam_role.r]\n}\nresource "aws_iam_role" "r" {\n  x { y = 1 }\n}\n'
    cfn = {"Resources": {"Fn": {"Type": "AWS::Lambda::Function", "DependsOn": "Role"}, "Role": {"Type": "AWS::IAM::Role", "DependsOn": ["Nothing"]}, "Odd": 3}}
    comp = "services:\n  web:\n    image: nginx\n    depends_on: [db]\n  db: {}\n"
    nodes, edges = iac.project(texts(spark, ("m/main.tf", tf), ("m/t.json", json.dumps(cfn)), ("m/docker-compose.yml", comp)))
    assert {(r.label, r.type) for r in nodes.collect()} == {
        ("lambda function f", "decision"), ("iam role r", "concept"), ("Function Fn", "decision"), ("Role Role", "concept"), ("web service", "concept"), ("db service", "concept"),
    }
    assert {(r.from_ref, r.to_ref) for r in edges.collect()} == {("aws_lambda_function.f", "aws_iam_role.r"), ("Fn", "Role"), ("web", "db")}


def test_api_descriptions(spark):
    spec = """
openapi: 3.0.3
paths:
  /sessions:
    get:
      operationId: listSessions
      summary: List
      responses: {'200': {content: {application/json: {schema: {type: array}}}}}
    post: {description: Create}
  /sessions/{id}:
    get:
      operationId: getSession
      responses: {'200': {content: {application/json: {schema: {$ref: '#/components/schemas/Session'}}}}}
components:
  securitySchemes: {key: {type: apiKey}}
  schemas: {Session: {properties: {id: {type: string}}}, Error: {type: object}}
"""
    old = json.dumps({"swagger": "2.0", "basePath": "/v1", "paths": {"/x": {"get": {}}}, "securityDefinitions": {"basic": {"type": "basic"}}})
    chan = json.dumps({"asyncapi": "2.0", "channels": {"c": {"publish": {"summary": "Send"}, "subscribe": {"operationId": "onC"}}}})
    got = apispec.api_nodes(texts(spark, ("a.yaml", spec), ("b.json", old), ("c.json", chan), ("d.yaml", ": :"))).collect()
    by = {(r.path, r.label): r for r in got}
    assert len(got) == 10
    assert json.loads(by["a.yaml", "getSession"].metadata)["response_schemas"] == ["Session"]
    assert by["a.yaml", "POST /sessions"].summary == "Create" and by["a.yaml", "key auth"].type == "decision"
    assert by["a.yaml", "Session"].summary == "Schema: Session — id"
    assert by["b.json", "GET /v1/x"].type == "skill" and by["c.json", "onC"].subtype == "endpoint"


def test_vault(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / "a.md").write_text("---\ntags: [API, x]\nstatus: active\n---\nSee [[b|other]] and [[missing]].\n#inline\n")
    (tmp_path / "sub" / "b.md").write_text("No head.\n")
    (tmp_path / ".obsidian" / "c.md").write_text("system")
    notes = vault.read_notes(spark, str(tmp_path))
    assert notes.count() == 2
    head = {r.path.rsplit("/", 1)[1]: r for r in vault.front_matter(notes).collect()}
    assert head["a.md"].tags == ["api", "x", "inline"] and head["b.md"].tags == []
    turn = vault.note_turns(notes, ["API"]).collect()
    assert len(turn) == 1 and turn[0].role_user == "Note: a | status: active | tags: api, x, inline"
    docs = notes.select(F.monotonically_increasing_id().alias("doc_id"), "text", "path")
    assert vault.wikilink_edges(docs).count() == 1


def test_transcripts(spark, tmp_path):
    lines = [
        {"type": "session.start", "data": {"sessionId": "s1", "startTime": "2026-05-02T10:00:00Z"}},
        {"type": "user.message", "data": {"text": "first", "attachments": [{"name": "n.txt", "content": "body"}, {"name": "p.png"}]}},
        {"type": "assistant.message", "data": {"content": ""}},
        {"type": "assistant.message", "data": {"content": "one"}},
        {"type": "assistant.message", "content": "two"},
        {"type": "user.message", "content": "second"},
    ]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join([json.dumps(lines[0]), "", "{broken", *map(json.dumps, lines[1:])]))
    got = turns.transcript_turns(chats.read_transcripts(spark, str(path))).orderBy("turn_number").collect()
    assert [(r.session_id, r.turn_number, r.role_user, r.role_assistant) for r in got] == [
        ("s1", 1, "first\n\n[Attached file: n.txt]\nbody\n\n[Attached image: p.png]", "two"), ("s1", 2, "second", ""),
    ]
    assert got[0].ts == "2026-05-02T10:00:00Z"


def test_chat_exports(spark):
    flat = json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "user", "content": "alone"}])
    nested = json.dumps({"messages": [{"role": "assistant", "content": "early"}, {"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]})
    chat = json.dumps([{"uuid": "c1", "chat_messages": [{"sender": "human", "text": "h"}, {"sender": "assistant", "text": "r"}]}])
    m = chats.export_messages(texts(spark, ("1", flat), ("2", nested), ("3", chat), ("4", "no json")))
    pairs = turns.message_pairs(m, "path", "pos", "role", "text").collect()
    assert {(r.path, r.role_user, r.role_assistant) for r in pairs} == {("1", "q", "a b"), ("2", "x", "y"), ("3", "h", "r")}


def test_session_exports(spark):
    doc = {"session_id": "old", "nodes": [{"id": "1", "type": "task", "label": "a", "embedding": [1.0]}, {"id": "2", "type": "task", "label": "b", "created_at": "2026-01-01T00:00:00Z"}, {"id": "3"}], "edges": [{"from_id": "1", "to_id": "2", "relation": "uses"}, {"from_id": "1", "to_id": "9", "relation": "uses"}]}
    nodes, edges = chats.session_export(texts(spark, ("f", json.dumps(doc))))
    assert {(r.id, r.original_session_id) for r in nodes.collect()} == {("1", "old"), ("2", "old")} and edges.count() == 1
    assert chats.export_summary(texts(spark, ("f", json.dumps(doc)))).first()[1:] == ("old", 3, 2)


def test_documents(spark):
    md = "intro\n\n# One\nbody\n## Two\n" + "x" * 3000 + "\n\n" + "y" * 3000 + "\n#### deep\n"
    rows = texts(spark, ("a.md", md), ("b.json", '{"k": {"z": 1}, "t": "text"}'), ("c.yaml", "a: 1\nb: [x]\n"), ("d.txt", "p\n\nq"), ("e.json", "broken"), ("f.md", ""))
    got = {(r.path, r.heading): r.body for r in documents.sections(rows).collect()}
    assert got["a.md", ""] == "intro" and got["a.md", "One"] == "body" and ("a.md", "Two (1/2)") in got and ("a.md", "Two (2/2)") in got
    assert got["b.json", "k"] == '{\n  "k": {"z":1}\n}' and got["b.json", "t"] == '{\n  "t": "text"\n}' and ("c.yaml", "b") in got
    assert got["d.txt", ""] == "p\n\nq" and got["e.json", ""] == "broken" and ("f.md", "") not in got
    t = documents.document_turns(rows).where("path = 'a.md' and turn_number = 2").first()
    assert t.role_user == "Document: a.md — section: One"


def test_commits(spark, tmp_path):
    commits = spark.createDataFrame([("abcdef0123", "fix(x): y", "long\nbody", "2026-01-01", [f"f{i}" for i in range(12)])], "hash string, subject string, body string, date string, files array<string>")
    turn = documents.commit_turns(commits).first()
    assert turn.role_user == "Commit abcdef01: fix(x): y [error — bug fix]" and turn.role_assistant.startswith("long\nbody\nChanged files: f0") and "f10" not in turn.role_assistant
    log = spark.createDataFrame([("l", i, x) for i, x in enumerate(["COMMIT:a", "f1", "f2", "", "COMMIT:b", "f3"])], "log string, pos int, line string")
    assert {(r.hash, r.file) for r in documents.files_by_commit(log).collect()} == {("a", "f1"), ("a", "f2"), ("b", "f3")}


def test_graph_rows(spark):
    nodes, edges = iac.project(texts(spark, ("c/compose.yml", "services:\n  web: {depends_on: {db: {}}}\n  db: {}\n")))
    n, e = files.to_graph(nodes, edges, "s")
    ids = {r.label: r.id for r in n.collect()}
    assert [(r.from_id, r.to_id) for r in e.collect()] == [(ids["web service"], ids["db service"])]


def test_pdf_is_optional(spark, tmp_path):
    pytest.importorskip("pypdf")
    assert documents.pdf_pages(spark, str(tmp_path)).count() == 0
