"""The way from turns to a merged, repaired graph."""

import datetime as dt
import json

from pyspark.sql import functions as F

from skein.plans import pipeline
from skein.schema import EDGES, NODES

AT = dt.datetime(2026, 1, 1)


def turns(spark, *rows):
    return spark.createDataFrame([("s", i + 1, u, a, AT) for i, (u, a) in enumerate(rows)], "session_id string, turn_number int, role_user string, role_assistant string, ts timestamp")


def said(answer):
    return lambda u, a: F.lit(json.dumps(answer))


def test_candidates_are_checked_in_order(spark):
    answer = {
        "nodes": [
            {"type": "decision", "label": "Use Redis cache layer", "status": "adopted", "confidence": 0.9},
            {"type": "gadget", "label": "gpt-9 adapter", "status": "odd", "confidence": "0.9"},
            {"type": "file", "label": "Issue #12", "status": "active", "confidence": 0.9},
            {"type": "task", "label": "invented words nowhere seen", "confidence": 1},
            {"type": "task"},
        ],
        "edges": [{"from": "use redis CACHE layer", "to": "issue #12", "relation": "likes"}, {"from": "x", "to": "issue #12"}],
    }
    nodes, edges = pipeline.candidates(turns(spark, ("We use the Redis cache layer, Issue #12, gpt-9 adapter", "ok")), said(answer))
    got = {r.label: r for r in nodes.collect()}
    assert len(got) == 4
    assert (got["Use Redis cache layer"].type, got["Use Redis cache layer"].status) == ("decision", "adopted")
    assert got["gpt-9 adapter"].type == "concept" and "model_name_unverified" in got["gpt-9 adapter"].metadata
    assert (got["Issue #12"].type, got["Issue #12"].status) == ("task", "done") and "file" in got["Issue #12"].metadata
    assert got["invented words nowhere seen"].status == "unconfirmed" and got["invented words nowhere seen"].confidence < 0.5
    rel = {r.relation for r in edges.collect()}
    assert rel == {"relates-to", "references", "implements"} and edges.count() == 3


def test_broken_answers_give_nothing(spark):
    nodes, edges = pipeline.candidates(turns(spark, ("a", "b"), (None, None)), lambda u, a: F.lit("no json"))
    assert nodes.count() == 0 and edges.count() == 0


def test_rules_find_things_and_mask_first(spark):
    t = turns(spark, ("Why does the index fail? password = hunter2", "We rejected the old cache. See ./src/app.py\n- [ ] write tests\n"), ("x", "y"))
    nodes, _ = pipeline.candidates(t)
    got = {(r.type, r.label) for r in nodes.collect()}
    assert ("question", "Why does the index fail?") in got and ("file", "./src/app.py") in got and ("task", "write tests") in got
    assert not any("hunter2" in label for _, label in got)


def stored(spark, *rows):
    base = dict.fromkeys(f.name for f in NODES.fields)
    out = []
    for r in rows:
        d = base | {"session_id": "s", "id": f"n{r['seq']}", "type": "decision", "label": "x", "summary": "", "status": "active", "confidence": 0.6, "created_at": AT, "updated_at": AT} | r
        out.append(tuple(d[f.name] for f in NODES.fields))
    return spark.createDataFrame(out, NODES)


def test_merge_and_repair(spark):
    old = stored(spark, {"seq": 0, "label": "Use Redis", "status": "adopted"}, {"seq": 1, "label": "Deploy script", "type": "task"})
    new = stored(spark, {"seq": 10, "label": "use redis", "status": "proposed", "confidence": 0.9, "summary": "again"}, {"seq": 11, "label": "Cache layer size", "type": "concept"}, {"seq": 12, "label": "Cache layer speed", "type": "concept", "confidence": 0.2})
    links = spark.createDataFrame([("s", "n10", "n11", "relates-to", 1.0), ("s", "n11", "gone", "uses", 1.0)], "session_id string, from_id string, to_id string, relation string, weight double")
    nodes, edges = pipeline.merge_batch(old, spark.createDataFrame([], EDGES), new, links, at="2026-01-02")
    got = {r.seq: r for r in nodes.collect()}
    assert set(got) == {0, 1, 11, 12} and got[0].status == "conflicted" and got[0].summary == "again" and got[0].confidence == 0.9
    assert got[0].status_history[0].status == "adopted"
    e = {(r.from_id, r.to_id, r.relation) for r in edges.collect()}
    assert ("n0", "n11", "relates-to") in e and ("n0", "n0", "contradicts") in e and all("gone" not in x for x in e)
    nodes2, edges2 = pipeline.repair_all(nodes, edges, at="2026-01-02")
    assert {r.seq: r.status for r in nodes2.collect()}[12] == "unconfirmed"
    e2 = {(r.from_id, r.to_id, r.relation) for r in edges2.collect()}
    assert ("n0", "n11", "documents") in e2 and ("n11", "n12", "relates-to") in e2


def test_labels_said_again_in_a_batch_meet_their_first_node(spark):
    old = stored(spark, {"seq": 0, "label": "Old one", "status": "adopted"})
    new = stored(spark, {"seq": 10, "label": "Write tests", "type": "task", "status": "done", "confidence": 0.5}, {"seq": 11, "label": "Other", "type": "task"}, {"seq": 12, "label": "write TESTS", "type": "task", "status": "pending", "summary": "later", "confidence": 0.8}, {"seq": 13, "label": None}, {"seq": 14, "label": None})
    links = spark.createDataFrame([("s", "n12", "n11", "depends-on", 1.0)], "session_id string, from_id string, to_id string, relation string, weight double")
    nodes, edges = pipeline.merge_batch(old, spark.createDataFrame([], EDGES), new, links, at="2026-01-02")
    got = {r.seq: r for r in nodes.collect()}
    assert set(got) == {0, 10, 11, 13, 14} and (got[10].status, got[10].summary, got[10].confidence) == ("conflicted", "later", 0.8)
    assert ("n10", "n11", "depends-on") in {(r.from_id, r.to_id, r.relation) for r in edges.collect()}


def test_near_duplicates_are_merged_related_and_healed(spark):
    old = stored(spark, {"seq": 0, "embedding": [1.0, 0.0, 0.0]}, {"seq": 1, "label": "y", "type": "error"}, {"seq": 2, "label": "z", "type": "error"}, {"seq": 3, "label": "t", "type": "task", "embedding": [0.0, 0.0, 1.0]})
    had = spark.createDataFrame([("s", "n1", "n2", "uses", 1.0)] * 4, "session_id string, from_id string, to_id string, relation string, weight double")
    vectors = {"a": [0.99, 0.1, 0.0], "b": [0.8, 0.6, 0.0], "c": [0.0, 0.1, 0.99], "d": [0.0, 0.0, 1.0], "e": [0.81, 0.6, 0.0]}
    embedder = lambda c: F.element_at(F.create_map(*[x for k, v in vectors.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), c)
    new = stored(spark, {"seq": 10, "label": "a", "summary": "more", "confidence": 0.9}, {"seq": 11, "label": "b"}, {"seq": 12, "label": "c", "type": "decision"}, {"seq": 13, "label": "d", "type": "question"}, {"seq": 14, "label": "e"})
    links = had.limit(0).unionByName(spark.createDataFrame([("s", "n10", "n12", "uses", 1.0)], had.schema))
    nodes, edges = pipeline.merge_batch(old, had, new, links, at="2026-01-02", embedder=embedder)
    got = {r.seq: r for r in nodes.collect()}
    assert set(got) == {0, 1, 2, 3, 11, 12, 13} and (got[0].summary, got[0].confidence) == ("more", 0.9)
    e = [(r.from_id, r.to_id, r.relation) for r in edges.collect() if r.weight != 0.5]
    # four edges without a relates-to leave room for one across types: the first
    assert sorted(set(e)) == [("n0", "n12", "uses"), ("n1", "n2", "uses"), ("n11", "n0", "relates-to"), ("n12", "n3", "relates-to")]
    lone = stored(spark, {"seq": 0, "label": "p", "embedding": [1.0, 0.0]}, {"seq": 1, "label": "q", "embedding": [0.9, 0.1]}, {"seq": 2, "label": "r"})
    one = had.limit(0).unionByName(spark.createDataFrame([("s", "n1", "n2", "uses", 1.0)], had.schema))
    assert {(r.from_id, r.to_id) for r in pipeline.repair_all(lone, one, at="2026-01-02")[1].collect()} == {("n1", "n2"), ("n0", "n1")}


def test_rules_find_all_of_a_kind(spark):
    asked = [f"Why does index number {i} fail?" for i in range(25)]
    nodes, _ = pipeline.candidates(turns(spark, (" ".join(asked), "ok")))
    assert {r.label for r in nodes.where("type = 'question'").collect()} == set(asked)
