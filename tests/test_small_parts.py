"""Titles, edits, imports, discovery of files and the second extractor."""

import json

import pytest
from pyspark.sql import functions as F

from skein import store
from skein.operators import graph
from skein.plans import pipeline
from skein.session import session_name
from skein.sources import chats, documents, manifest
from test_operators import edges, nodes


def test_transcripts_of_a_workspace(spark, tmp_path):
    old, new = tmp_path / "GitHub.copilot-chat" / "debug-logs", tmp_path / "GitHub.copilot-chat" / "sessions"
    for folder in (old, new):
        folder.mkdir(parents=True)
    lines = [
        {"type": "session.start", "data": {"sessionId": "s1", "startTime": "2026-01-01T00:00:00Z"}},
        {"type": "user.message", "data": "{'content': 'written as a literal', 'n': None}"},
        {"type": "assistant.message", "content": "answer"},
    ]
    (old / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (new / "b.jsonl").write_text("")
    assert [r.path.rsplit("/", 1)[1] for r in chats.transcripts(spark, str(tmp_path)).collect()] == ["a.jsonl"]
    got = chats.with_source(chats.workspace_turns(spark, str(tmp_path)), "paste").collect()
    assert [(r.session_id, r.role_user, r.role_assistant, r.source) for r in got] == [("s1", "written as a literal", "answer", "paste")]
    assert chats.workspace_turns(spark, str(tmp_path), "a").count() == 1 and chats.workspace_turns(spark, str(tmp_path), "c").count() == 0


def test_chat_files_in_json_or_as_text(spark):
    rows = [("j", '[{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]'), ("t", "User: q2\nAssistant: r2"), ("x", '["a", "b"]'), ("n", None)]
    got = {(r.path, r.role_user, r.role_assistant) for r in chats.chat_file_turns(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("j", "q", "r"), ("t", "q2", "r2"), ("x", '["a", "b"]', "")}


def test_documents_and_manifests_of_a_project(spark):
    files = spark.createDataFrame([("/p/CHANGELOG.md", "# B\nlater"), ("/p/README.md", "# A\nfirst\n## C\nsecond"), ("/p/sub/README.md", "no"), ("/p/docs/README.md", "last"), ("/p/package.json", '{"dependencies": {"a": "1"}}'), ("/p/sub/package.json", '{"dependencies": {"b": "1"}}'), ("/p/requirements.txt", "c==2"), ("/p/dev-requirements.txt", "d")], "path string, text string")
    commits = spark.createDataFrame([(0, "Commit 1", "x"), (1, "Commit 2", "y")], "pos int, role_user string, role_assistant string")
    got = [(r.turn_number, r.source, r.role_assistant) for r in documents.project_turns(files, "/p", commits).orderBy("turn_number").collect()]
    assert got == [(1, "codebase", "x"), (2, "codebase", "y"), (3, "codebase_doc", "first"), (4, "codebase_doc", "second"), (5, "codebase_doc", "later"), (6, "codebase_doc", "last")]
    deps = {(r.package, r.place) for r in manifest.project_dependencies(files, "/p").collect()}
    assert deps == {("a", 1), ("c", 3)}


def test_titles_edits_and_imports(spark, tmp_path):
    s = spark.createDataFrame([("a", "old", "web")], "session_id string, title string, platform string")
    assert {tuple(r) for r in store.set_title(s, "a", "new").collect()} == {("a", "new", "web")}
    assert {tuple(r) for r in store.set_title(s, "b", "t").collect()} == {("a", "old", "web"), ("b", "t", None)}
    n, e = nodes(spark, {}, {"seq": 1}), edges(spark, ("n0", "n1"))
    out = {r.id: r for r in store.edit_node(n, "s", "n1", "done", "why").collect()}
    assert (out["n1"].status, out["n1"].summary, out["n1"].status_history) == ("done", "why", None) and out["n0"].status != "done"
    with pytest.raises(ValueError):
        store.edit_node(n, "s", "n1", "odd")
    with pytest.raises(LookupError):
        store.edit_node(n, "s", "gone", "done")
    text = json.dumps({"session_id": "z", "nodes": [{"id": "k", "label": "l", "type": "task"}], "edges": []})
    more = chats.session_export(spark.createDataFrame([("f", text)], "path string, text string"))
    both, links = store.append_export(n, e, *more)
    assert {(r.session_id, r.id) for r in both.collect()} == {("s", "n0"), ("s", "n1"), ("z", "k")} and links.count() == 1
    store.write_text(str(tmp_path / "d" / "f.md"), "one")
    store.write_text(str(tmp_path / "d" / "f.md"), "two")
    assert (tmp_path / "d" / "f.md").read_text() == "two" and len(list((tmp_path / "d").iterdir())) == 1
    assert session_name("/x/My Project/", "2026-01-01") == "my-project-2026-01-01" and session_name("/x", "d", " own ") == "own"


def test_neighbourhoods_may_be_capped(spark):
    n, e = nodes(spark, *[{"seq": i} for i in range(6)]), edges(spark, *[("n0", f"n{i}") for i in range(1, 6)])
    seeds = spark.createDataFrame([("s", "n0")], "session_id string, id string")
    assert {r.id for r in graph.neighbourhood(n, e, seeds, 1, 3).collect()} == {"n0", "n1", "n2"}


def test_second_extractor_and_its_fall_back(spark):
    t = spark.createDataFrame([("s", i, "u", "a") for i in range(1, 5)], "session_id string, turn_number int, u string, a string")
    first, good, bad = (lambda u, a, x=x: F.lit(x) for x in ('{"nodes": [1]}', '{"nodes": [2]}', "no json"))
    for second, want in ((good, ["1", "2", "1", "2"]), (bad, ["1"] * 4)):
        answer = pipeline.hybrid_extractor(first, second, F.col("turn_number"), 2)(F.col("u"), F.col("a"))
        assert [r.x for r in t.orderBy("turn_number").select(F.get_json_object(answer, "$.nodes[0]").alias("x")).collect()] == want
