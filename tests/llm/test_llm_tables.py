"""Survivors, near-duplicates, containers and mixes against brute force."""

import datetime as dt
import math
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import mixing, neardup, packing, representative

ROOT = "/root/testdata/sf0.001"
NODE = "seq long, session_id string, type string, label string, summary string, status string, confidence double, created_at timestamp, updated_at timestamp, embedding array<float>, n_records int, _seq long"


def nodes(spark, *rows):
    base = {"session_id": "s", "type": "task", "label": "Same Label", "summary": None, "status": None, "confidence": None, "created_at": dt.datetime(2026, 1, 1), "updated_at": None, "embedding": None, "n_records": 1, "_seq": 5}
    out = [(base | {"seq": i}) | r for i, r in enumerate(rows)]
    names = [x.split()[0] for x in NODE.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in out], NODE)


# --- survivors ---


def test_survivors_field_by_field(spark):
    day = lambda n: dt.datetime(2026, 2, n)
    rows = [
        {"summary": "short", "status": "Done ", "confidence": 0.4, "updated_at": day(3)},
        {"label": "same-label", "summary": "the longest one", "status": "wip", "confidence": 0.9, "updated_at": day(9)},
        {"label": "ＳＡＭＥ label", "summary": "the longest two", "status": "fixed", "confidence": 69.1, "updated_at": dt.datetime(2084, 1, 1)},
        {"summary": "(no summary) ", "status": "ACTIVE", "confidence": float("nan"), "updated_at": dt.datetime(2025, 1, 1)},
        {"label": "Other"}, {"label": "other!", "type": "skill"}, {"label": "?!"}, {"label": "?!"}, {"session_id": None}, {"session_id": None}, {"label": None}, {"label": None},
    ]
    got = {(r.group_seq, r.field): r.from_seq for r in representative.field_origins(representative.survivors(nodes(spark, *rows))).collect()}
    assert got == {(0, "summary"): 1, (0, "status"): 0, (0, "confidence"): 1, (0, "updated_at"): 1}
    s = representative.survivors(nodes(spark, *rows)).collect()
    assert len(s) == 1 and s[0].status == "done" and s[0].n_records == 4


def test_survivors_against_a_loop(spark):
    df = spark.read.parquet(f"{ROOT}/nodes.parquet")
    rows = [r.asDict() for r in df.collect()]
    end = dt.datetime(2026, 7, 1)
    statuses = set(representative.NODE_STATUSES)
    groups = {}
    for r in rows:
        k = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", r["label"] or "").casefold())
        k = "".join(c for c in k if c.isalnum())
        if k and r["session_id"] and r["type"]:
            groups.setdefault((r["session_id"], r["type"], k), []).append(r)
    want = set()
    bad = {"", "tbd", "n/a", "null", "todo", "(no summary)", "-", "…"}
    for g in groups.values():
        if len(g) < 2:
            continue
        lead = min(r["seq"] for r in g)
        clean = lambda s: (s or "").replace("​", "").strip()
        timely = [r for r in g if r["updated_at"] and r["updated_at"] >= r["created_at"] and r["updated_at"] < end]
        fields = {
            "summary": [(len(clean(r["summary"])), -r["seq"]) for r in g if clean(r["summary"]).lower() not in bad],
            "confidence": [(r["confidence"], -r["seq"]) for r in g if r["confidence"] is not None and 0 <= r["confidence"] <= 1],
            "updated_at": [(r["updated_at"], -r["seq"]) for r in timely],
            "status": [(r["updated_at"], -r["seq"]) for r in timely if (r["status"] or "").strip().lower() in statuses],
        }
        want |= {(lead, f, -max(v)[1]) for f, v in fields.items() if v}
    got = {tuple(r) for r in representative.field_origins(representative.survivors(df)).collect()}
    assert got == want and want


def test_consensus():
    values = [("the graph index is slow", 1.0, 1), ("the graph index was slow today", 0.2, 2), ("a graph index is slow", 0.2, 3), ("completely different words", 0.9, 4)]
    assert representative.consensus(values) == 1
    assert representative.consensus([("a b", 1.0, 7), ("a b", 1.0, 3)]) == 3


def slow_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_winners_are_the_nearest_to_the_vote():
    rnd = random.Random(6)
    for _ in range(40):
        base = [rnd.choice("abcdef") for _ in range(rnd.randrange(1, 9))]
        values = [(" ".join(rnd.choice("abcdef") if rnd.random() < 0.3 else t for t in base), rnd.choice([0.2, 0.5, 1.0]), i) for i in range(rnd.randrange(2, 7))]
        tokens = {i: representative.tokens_of(t) for t, _, i in values}
        vote = [t for col in representative.profile_of([(tokens[i], w, i) for _, w, i in values]) if (t := max(col.items(), key=lambda x: (x[1], x[0]))[0])]
        apart = {i: slow_distance(tokens[i], vote) for i in tokens}
        assert all(representative.distance(tokens[i], vote) == d for i, d in apart.items())
        assert apart[representative.consensus(values)] == min(apart.values())


def test_consensus_of_scripts_without_blanks_and_of_long_texts(spark):
    assert representative.tokens_of("索引v2很慢 ok") == ["索", "引", "v2", "很", "慢", "ok"]
    assert representative.consensus([("图的索引很慢", 0.5, 1), ("图的索引很快", 0.5, 2), ("图的索引很慢了", 0.5, 3), ("完全不同的句子", 0.6, 4)]) in (1, 3)
    long = [" ".join(f"w{i}" for i in range(900))] * 2
    values = [(long[0], 0.5, 1), (long[1].replace("w3 ", "x "), 0.4, 2), (long[0].replace("w850 ", "y z "), 0.4, 3)]
    assert representative.consensus(values) == 1


def test_consensus_rounds_are_bounded(spark):
    rows = [{"summary": f"the graph index number {i} is slow", "confidence": 0.5} for i in range(150)] + [{"summary": "the graph index is slow"}] + [{"summary": "the graph index is slow"}]
    got = representative.consensus_text(nodes(spark, *rows)).collect()
    assert len(got) == 1 and got[0].value.startswith("the graph index")
    long = nodes(spark, {"summary": "word " * 5000}, {"summary": "word " * 4999 + "end"}, {"summary": None})
    assert representative.consensus_text(long, max_tokens=50).count() == 1
    assert representative.consensus_text(nodes(spark).where("false")).count() == 0


def test_consensus_is_one_method_at_any_size(spark):
    rows, want = [], {}
    for seed in (5, 13, 17, 21, 37, 41):
        rnd, made = random.Random(seed), {}
        size = rnd.choice([65, 66, 70, 80])
        while len(made) < size:
            made[" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(3, 9)))] = 1
        for n in (size, 64, 3):
            own = [{"label": f"group {seed} {n}", "summary": x, "confidence": rnd.choice([0.2, 0.5, 0.9])} for x in list(made)[:n]]
            want[len(rows)] = representative.consensus([(r["summary"], r["confidence"] + 0.01, len(rows) + i) for i, r in enumerate(own)])
            rows += own
    got = {r.group_seq: r.from_seq for r in representative.consensus_text(nodes(spark, *rows)).collect()}
    assert got == want


def test_consensus_of_long_texts_is_that_of_their_tokens(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [{"summary": " ".join(t for t in base if rnd.random() < 0.8), "confidence": 0.5} for _ in range(9)]
    want = representative.consensus([(r["summary"], 0.51, i) for i, r in enumerate(rows)])
    for bound in (1, 7, 25, 8192):
        assert [r.from_seq for r in representative.consensus_text(nodes(spark, *rows), max_tokens=bound).collect()] == [want], bound


# --- near-duplicates ---


def brute(rows):
    import re

    words = {s: set(re.findall(r"[^\W_]+", f"{lab or ''} {sm or ''}".lower())) for s, lab, sm, _ in rows}
    out = set()
    for i, (s, *_, e) in enumerate(rows):
        for t, *_, f in rows[i + 1 :]:
            a, b = words[s], words[t]
            close = len(a) >= 10 and len(b) >= 10 and len(a & b) / len(a | b) >= 0.6
            if e and f and len(e) == len(f) and any(e) and any(f):
                x, y = np.array(e, dtype=float), np.array(f, dtype=float)
                close |= x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9
            if close:
                out.add((min(s, t), max(s, t)))
    return out


def test_pairs_against_brute_force(spark):
    rnd, rng = random.Random(4), np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, seq = [], 0
    for _ in range(40):
        base, vec = rnd.sample(vocabulary, 20), rng.standard_normal(16)
        for _ in range(rnd.randrange(1, 7)):
            edited = [w if rnd.random() > 0.12 else rnd.choice(vocabulary) for w in base]
            rnd.shuffle(edited)
            v = vec + rng.standard_normal(16) * rnd.choice([0.02, 0.15, 2])
            emb = rnd.choice([None, [], [0.0] * 16, v.tolist(), v.tolist(), v.tolist()])
            rows.append((seq, edited[0], " ".join(edited[1:]), emb))
            seq += 1
    rows += [(seq + i, None, rows[0][2], None) for i in range(3)] + [(seq + 5, "few words", None, None), (seq + 6, "few words", None, None)]
    data = [{"seq": s, "label": a, "summary": b, "embedding": e} for s, a, b, e in rows]
    data += [{"seq": None, "label": "x", "summary": rows[0][2]}]
    df = nodes(spark, *data)
    rounded = [(s, a, b, None if e is None else np.array(e, dtype=np.float32).astype(float).tolist()) for s, a, b, e in rows]
    want = brute(rounded)
    got = {tuple(r) for r in neardup.near_pairs(df).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and want
    groups = {r.seq: r.group_seq for r in neardup.near_groups(df).collect()}
    assert set(groups) == {r[0] for r in rows} and all(groups[a] == groups[b] for a, b in got)


@pytest.mark.parametrize("alike", [28, 12])
def test_crowded_regions_go_deeper_or_are_compared_in_blocks(spark, alike):
    rnd = random.Random(alike)
    base = [f"w{i}" for i in range(alike)]
    texts = [base + rnd.sample([f"x{j}" for j in range(400)], 30 - alike) for _ in range(150)]
    df = nodes(spark, *[{"label": "", "summary": " ".join(t)} for t in texts])
    one = neardup.word_classes(df).groupBy("cls").agg(F.first("words").alias("words"))
    found = neardup.forest_pairs(one, neardup.word_forest, neardup.word_sides, 0.6, 0.6, neardup.WORDS_ALIKE, crowd=16)
    want = {(i, j) for i in range(150) for j in range(i) if len(set(texts[i]) & set(texts[j])) / len(set(texts[i]) | set(texts[j])) >= 0.6}
    seq = {r.cls: r.seq for r in neardup.word_classes(df).collect()}
    got = {(max(seq[r.a], seq[r.b]), min(seq[r.a], seq[r.b])) for r in found.collect()}
    assert len(got & want) >= 0.99 * len(want) and (len(want) == 150 * 149 // 2 if alike == 28 else len(got) < 150 * 149 // 2)


def test_trees_keep_the_chance_to_meet():
    for agree in (0.6, neardup.vectors_agree(0.9)):
        for depth in (1, 2, 3, 5):
            assert 1 - (1 - agree**depth) ** neardup.trees_for(agree, depth) >= 1 - neardup.LOSS
    assert neardup.depth_for(10, 1 / 12) == 1 < neardup.depth_for(100_000, 1 / 12) < neardup.depth_for(10**9, 1 / 12)


@pytest.mark.parametrize("dim", [5, 64])
def test_sketches_lose_no_link(dim):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, dim))
    x = np.concatenate([x, x + rng.standard_normal((60, dim)) * 0.3])
    batch = neardup.pa.RecordBatch.from_arrays([neardup.pa.array(range(120)), neardup.pa.array([0] * 120), neardup.pa.array(x.tolist())], names=["cls", "top", "vector"])
    rows = next(neardup.vector_forest(1, 1)([batch]))
    sketch = np.stack([np.frombuffer(b, dtype=np.uint8) for b in rows.column("sketch").to_pylist()])
    left, right, _, bound = neardup.vector_sides(sketch, 0.9)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert ((left @ right.T >= bound) | (unit @ unit.T < 0.9)).all() and (left @ right.T >= bound).mean() < 0.5


def test_no_records(spark):
    assert neardup.near_pairs(nodes(spark).where("false")).count() == 0
    assert neardup.near_groups(nodes(spark).where("false")).count() == 0


# --- containers ---


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plans_place_all_and_fit(histogram):
    plan = packing.plan_bins(histogram, 64)
    bins, placed = {}, {}
    for n, a, b, first, per in plan:
        assert placed.get(n, 0) == a
        placed[n] = b
        for r in range(a, b):
            k = first + (r - a) // per
            bins[k] = bins.get(k, 0) + n
    assert placed == histogram and all(v <= 64 for v in bins.values())
    total = sum(n * c for n, c in histogram.items())
    least = max(math.ceil(total / 64), sum(c for n, c in histogram.items() if n > 32))
    assert least <= len(bins) <= 1.5 * least + 1


def test_packing(spark):
    rnd = random.Random(9)
    texts = ["é" * rnd.randrange(0, 40) for _ in range(400)] + [None, "", "x" * 1000, "x" * 100, "x" * 100]
    rows = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)] + [(None, "nul", 1, 1)], "doc_id long, text string, tokens int, bin_id int")
    out = packing.pack(rows, capacity=100, run_rows=7).collect()
    sizes = {i: len((t or "").encode()) for i, t in enumerate(texts)} | {None: 3}
    assert {r.doc_id for r in out} == set(sizes)
    used = {}
    for i, size in sizes.items():
        own = sorted((r.piece_no, r.piece_start, r.tokens, r.n_pieces, r.bin_id) for r in out if r.doc_id == i)
        assert sum(p[2] for p in own) == size and len(own) == own[0][3] == max(1, math.ceil(size / 100))
        assert [p[1] for p in own] == [sum(q[2] for q in own[:k]) for k, _ in enumerate(own)] and max(p[2] for p in own) <= 100 and all((p[4] is None) == (size == 0) for p in own)
        for p in own:
            if p[4] is not None:
                used[p[4]] = used.get(p[4], 0) + p[2]
    assert max(used.values()) <= 100 and len(used) <= math.ceil(sum(sizes.values()) / 100) + 2
    sound = packing.soundness(packing.pack(rows, capacity=100), 100).first()
    assert sound.over == 0 and sound.tokens == sum(sizes.values()) and sound.least <= sound.containers <= sound.least + 2
    wide = spark.createDataFrame([(1, "é" * 150), (2, "x" + "日" * 70)], "doc_id long, text string")
    got = sorted((r.doc_id, r.piece_start, r.tokens) for r in packing.pack(wide, capacity=101).collect())
    assert got == [(1, 0, 100), (1, 100, 100), (1, 200, 100), (2, 0, 100), (2, 100, 99), (2, 199, 12)]
    assert packing.pack(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(rows, capacity=0)


# --- mixes ---


def test_mix(spark):
    rnd = random.Random(8)
    docs = [(i, rnd.choice(["a", " A", "b", "c", None, "other"]) if i % 10 else "small", "x" * rnd.randrange(0, 60), 1) for i in range(600)] + [(None, "a", "yy", 1), (1, "a", None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, copy_no int")
    t = spark.createDataFrame([("a", 0.4, 3), ("b", 0.2, 2), ("c", 0.1, 9), ("small", 0.3, 2), ("none", 0.0, 5), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    members, report = mixing.mix(d, t)
    members, report = members.collect(), {r.source: r for r in report.collect()}
    size = {}
    for _, s, x, _ in docs:
        if s and x:
            size[s.strip().lower()] = size.get(s.strip().lower(), 0) + len(x)
    budget = sum(size.values())
    total = sum(r.tokens for r in members)
    assert budget - 60 <= total <= budget and max(r.upto for r in members) == total
    for s, r in report.items():
        assert r.mix_tokens == sum(m.tokens for m in members if m.source == s)
        if r.mix_tokens:
            assert r.share == pytest.approx(r.mix_tokens / total)
    assert report["small"].unreachable and report["small"].mix_tokens == 2 * size["small"] == report["small"].available
    assert not report["a"].unreachable and max((m.doc_id, m.source, m.copy_no) for m in members if m.source == "small")[2] == 2
    left = 1 - report["small"].share
    for s, w in (("a", 0.4), ("b", 0.2), ("c", 0.1)):
        if not report[s].unreachable:
            assert report[s].share == pytest.approx(left * w / 0.7, abs=0.02)
    seen = [(m.doc_id, m.source, m.copy_no, m.upto) for m in members]
    assert len(seen) == len(set(seen))


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeat int")
    members, report = mixing.mix(d, t)
    assert members.count() == 0 and report.first().mix_tokens == 0
    assert mixing.mix(d, t.where("false"))[1].count() == 0


def test_consensus_of_a_group_is_its_own(spark):
    small = [{"summary": x, "confidence": 0.5} for x in ("p q r", "p q s", "p t r")]
    rows = []
    for g in range(12):  # whichever two of the three met first in another split, each group must give the vote's own value
        rows += [r | {"label": f"small {g}"} for r in small]
    rows += [{"label": "hot", "summary": f"the index {i} is slow again", "confidence": 0.5} for i in range(500)]
    rows += [{"label": "hot", "summary": "the index is slow again", "confidence": 0.1}, {"label": "hot", "summary": "one heavy other text", "confidence": 1.0}]
    got = {r.group_seq: r.value for r in representative.consensus_text(nodes(spark, *rows)).collect()}
    assert [got[3 * g] for g in range(12)] == ["p q r"] * 12
    assert got[36].startswith("the index") and got[36].endswith("is slow again")


def test_pairs_of_a_dense_group(spark):
    rnd = random.Random(9)
    template = " ".join(f"t{i}" for i in range(15))
    rows = [(i, template, " ".join(rnd.sample([f"w{j}" for j in range(100)], 5)), None) for i in range(300)]
    got = {(r.seq_a, r.seq_b) for r in neardup.near_pairs(nodes(spark, *[{"seq": s, "label": a, "summary": b} for s, a, b, _ in rows])).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 40_000
