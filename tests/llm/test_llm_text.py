"""Personal data, conversations, pieces and sentences against brute force, round trips and known texts."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from parity import same
from skein.llm import conversations as conv
from skein.llm import pii, queries, sentences, splitting

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, ROOT).count() > 0


# --- personal data ---

CASES = [
    ("Signed-off-by: Hana Belcroft <h.belcroft@mail.sorvin.example>", {("name", "Hana Belcroft"), ("email", "h.belcroft@mail.sorvin.example")}),
    ("write to ana dot lopez at corp dot sorvin dot example at once", {("email", "ana dot lopez at corp dot sorvin dot example")}),
    ("mail x_y(at)sorvin(dot)example today", {("email", "x_y(at)sorvin(dot)example")}),
    ("Clone git@forge.sorvin.test:a/b.git first.", set()),
    ("Pin sorvin@2.16.3 and use @pytest.fixture here.", set()),
    ("Call +44 7700 900615 if it breaks.", {("phone", "+44 7700 900615")}),
    ("tel: (467) 555-0120 or ０３－００００－９４７１", {("phone", "(467) 555-0120"), ("phone", "０３－００００－９４７１")}),
    ("My SSN is 975-27-4187, is that masked?", {("identity", "975-27-4187")}),
    ("Part no. 412-55-9200 is only a label.", set()),
    ("Build 202608-75879-67 is green. Set x = 30 23 125 in the mask.", set()),
    ("I live at 306 Hazel Terrace, Nebelstett, by the way.", {("address", "306 Hazel Terrace, Nebelstett")}),
    ("Ich wohne hier: Kupferplatz 24, 00449 Grauenfeld.", {("address", "Kupferplatz 24, 00449 Grauenfeld")}),
    ("The Lantern Street milestone covers the cursor.", set()),
    ("May the token rest; Will it load? Mark the index as lazy.", set()),
    ("thanks, BELCROFT, Hana", {("name", "BELCROFT, Hana")}),
    ("请找Hana Belcroft。", {("name", "Hana Belcroft")}),
]


def pairs_of(texts, df):
    found = {}
    for r in df.collect():
        found.setdefault(r.row_id, set()).add((r.kind, texts[r.row_id][r.start_at : r.end_at]))
    return found


def test_mentions_and_masking(spark):
    base = [r.text for r in splitting.message_texts(spark.read.parquet(f"{ROOT}/copilot_session.parquet"), spark.read.parquet(f"{ROOT}/claude_export.parquet")).collect()]
    texts = [c for c, _ in CASES] + ["", None, "x" * 200_000 + " reach me under +44 7700 900615", *base]
    rows = spark.createDataFrame([("t", i, t, "clash", 1) for i, t in enumerate(texts)], "src string, row_id long, text string, found string, k int")
    found = pii.mentions(rows)
    got = pairs_of(texts, found)
    for i, (text, want) in enumerate(CASES):
        assert got.get(i, set()) == want, text
    n = len(CASES)
    assert n not in got and n + 1 not in got and got[n + 2] == {("phone", "+44 7700 900615")}
    masked = {r.row_id: r.text for r in pii.masked(rows.select("src", "row_id", "text"), found).collect()}
    assert masked[0] == "Signed-off-by: [NAME] <[EMAIL]>" and masked[n] == "" and masked[n + 1] is None
    for i, t in enumerate(texts):
        if t and i not in got:
            assert masked[i] == t


HELD_OUT = "Saoirse Kinsella|Ngozi Okafor|Thandiwe Mbeki|Zbigniew Kowalczyk|Ximena Ortega|Oluwaseun Adeyemi|Ragnhild Solberg|Tamsin Wetherby|Bartosz Zielinski|Xochitl Reyes"
FRAMES = [
    "Thanks, {first}", "Hi {first},\nthe index is slow.", "Please ask {full} about the logs.", "Signed-off-by: {full} <x@y.org>", "owner: {lower}", "Dear {full},", "Ping {first} before the merge.",
    "{full} wrote the parser.", "I met {full} and we fixed it.", "Call {full} on +44 20 7946 0958.", "author={first}", "cc {full}", "Mrs. {last} called.", "Reviewed-by: {full}",
]


def test_held_out_names_in_held_out_frames(spark):
    base = [r.text for r in splitting.message_texts(spark.read.parquet(f"{ROOT}/copilot_session.parquet"), spark.read.parquet(f"{ROOT}/claude_export.parquet")).collect()]
    texts, want = list(base), {}
    for name in HELD_OUT.split("|"):
        first, last = name.split()
        assert first not in pii.GIVEN.split()
        for frame in FRAMES:
            want[len(texts)] = {"first": first, "full": name, "lower": name.lower(), "last": last}[frame.split("{")[1].split("}")[0]]
            texts.append(frame.format(first=first, full=name, lower=name.lower(), last=last))
    plain = ["The Cache is slow.", "Call the server again.", "Ask for the token.", "Hi there, the Parser failed.", "Thanks for the quick fix.", "owner: data team", "To Do: rename it."]
    texts += plain
    rows = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "src string, row_id long, text string")
    got = pairs_of(texts, pii.mentions(rows))
    right = sum(("name", w) in got.get(i, set()) for i, w in want.items())
    assert right >= 0.9 * len(want)
    assert sum(len(got.get(len(texts) - 1 - i, ())) for i in range(len(plain))) <= 1


def test_names_and_addresses_of_more_languages():
    for text, kind, span in [
        ("担当は紗英です。", 4, "紗英"), ("请找欧阳明月。", 4, "欧阳明月"), ("请找王伟。", 4, "王伟"), ("Prinsengracht 263, 1016 Amsterdam", 3, "Prinsengracht 263, 1016 Amsterdam"),
        ("ul. Marszałkowska 10 jest", 3, "ul. Marszałkowska 10"), ("Storgatan 12, Malmö", 3, "Storgatan 12, Malmö"),
    ]:
        assert (kind, span) in [(k, text[a:b]) for k, a, b, *_ in pii.candidates(text)]


def test_no_texts_no_mentions(spark):
    empty = spark.createDataFrame([], "src string, row_id long, text string")
    assert pii.mentions(empty).count() == 0


def test_estimation_recovers_what_labelers_are_worth():
    rnd = random.Random(5)
    patterns, truth = {}, {}
    for _ in range(5000):
        y = rnd.random() < 0.7
        v = []
        for name in pii.LABELERS:
            p = pii.EXPECTED[name][0 if y else 1]
            v.append(rnd.choices((-1, 0, 1), p)[0])
        patterns[tuple(v)] = patterns.get(tuple(v), 0) + 1
        truth.setdefault(tuple(v), []).append(y)
    share, table, chances = pii.estimate(sorted(patterns.items()))
    right = sum((chances[k] >= 0.5) == y for k, ys in truth.items() for y in ys) / 5000
    assert abs(share - 0.7) < 0.05 and right > 0.85 and abs(table.sum(axis=2) - 1).max() < 1e-6


def test_estimation_does_not_move_with_the_size():
    votes = [(1, 0, 1, 0, 0, 0, 0), (1, 0, 1, 0, 0, 0, 1), (1, 0, 1, 1, 0, 0, 0), (1, 0, 1, 1, 0, 0, 1), (1, 0, 0, 0, 0, 0, 1), (1, 0, 0, 1, 0, 0, 1), (1, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, -1, 0, 1)]
    counts = [2476, 1814, 1116, 843, 840, 439, 157, 4]  # nearly all are addresses
    for size in (0.1, 1, 4, 40, 400, 4000):
        chances = pii.estimate([(v, n * size) for v, n in sorted(zip(votes, counts))])[2]
        assert [chances[v] >= 0.5 for v in votes] == [True] * 7 + [False], size


def test_articles_before_a_name_are_whole_words():
    against = lambda text: [v[pii.LABELERS.index("against")] for k, _, _, v, _ in pii.candidates(text) if k == 4]
    assert against("Llama a Iker Lundungard al 876 555 0111.") == [0] and against("Pregunta a Iker Lundungard.") == [0]
    assert against("In zeta Iker Lundungard wrote.") == [0] and against("On the Iker Lundungard day.") == [-1]


# --- conversations ---


def build(messages, spark):
    schema = "row_id long, sessionid string, line_no long, type string, starttime string, messageid string, content string, load_ts timestamp, frag int"
    at = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, s, n, t, None, m, c, at + dt.timedelta(seconds=l), 7) for i, (s, n, t, m, c, l) in enumerate(messages)], schema)


EXPORT = "row_id long, conv_uuid string, uuid string, sender string, text string, created_at string, load_ts timestamp"


def test_conversations_small(spark):
    u, a = "user.message", "assistantMessage"
    m = [
        ("ok", 0, u, "1", "q", 0), ("ok", 1, a, "2", "r", 1), ("ok", 2, "tool", None, "t", 1), ("ok", 3, u, "3", "q", 2), ("ok", 4, a, "4", "r", 3), ("ok", 9, a, "4", "again", 9), ("ok", 5, a, "5", "​ ", 3),
        ("gap", 0, u, "6", "q", 0), ("gap", None, a, "7", "r", 0),
        ("open", 0, u, "8", "q", 0), ("late", 0, a, "9", "r", 0), ("late", 1, u, "10", "q", 0), ("late", 2, a, "11", "r", 0),
        ("two", 0, u, "12", "q", 0), ("two", 1, u, "13", "q", 0), ("two", 2, a, "14", "r", 0),
        (None, 0, u, "15", "q", 0), ("blank", 0, u, "16", None, 0), ("ids", 0, u, None, "q", 0), ("ids", 1, a, "", "r", 0), ("ids", 2, a, None, "r", 0),
    ]
    got = conv.conversations(build(m, spark), spark.createDataFrame([], EXPORT)).collect()
    assert sorted((r.conv_key, r.msg_no, r.row_id) for r in got) == [("ids", 1, 18), ("ids", 2, 19), ("ids", 3, 20), ("ok", 1, 0), ("ok", 2, 1), ("ok", 3, 3), ("ok", 4, 4)]


@pytest.mark.parametrize("target", [2, 3, 7, 2048])
def test_fragments_do_not_matter(spark, target):
    rnd = random.Random(11)
    m = []
    for s in range(12):
        place = 0
        for k in range(rnd.randrange(0, 30)):
            place += rnd.choice([1, 1, 1, 40])
            kind = ("user.message", "assistant.message")[k % 2] if rnd.random() < 0.97 else "user.message"
            m.append((f"s{s}", place, kind, f"{s}-{k}", "text", rnd.randrange(100)))
    rnd.shuffle(m)
    rows = build(m, spark)
    got = sorted((r.conv_key, r.msg_no, r.row_id) for r in conv.conversations(rows, spark.createDataFrame([], EXPORT), target).collect())
    want = []
    for s in {x[0] for x in m}:
        own = sorted((n, i, t) for i, (k, n, t, *_) in enumerate(m) if k == s)
        roles = ["u" if t.startswith("user") else "a" for _, _, t in own]
        if roles[0] == "u" and roles[-1] == "a" and "uu" not in "".join(roles):
            want += [(s, j + 1, i) for j, (_, i, _) in enumerate(own)]
    assert got == sorted(want) and want


def test_overlapping_fragments_join_where_it_is_unambiguous(spark):
    f = [("c", "A", [1, 2, 3, 4]), ("c", "B", [3, 4, 5]), ("c", "C", [5, 6]), ("d", "X", [1, 2]), ("d", "Y", [2, 3]), ("d", "Z", [2, 9])]
    rows = spark.createDataFrame([("t", c, n, h) for c, n, h in f], "src string, conv_key string, frag string, hashes array<long>")
    e = conv.overlap_edges(rows)
    assert {(r.a, r.b, r.k) for r in e.collect()} == {("A", "B", 2), ("B", "C", 1)}
    paths = conv.merge_paths(rows.select("src", "conv_key", "frag", F.size("hashes").alias("n")), e, 3)
    got = {r.frag: (r["first"], r.offset) for r in paths.collect()}
    assert got["C"] == ("A", 7) and got["B"] == ("A", 4) and got["X"] == ("X", 0)




def test_exports_of_several_days_are_assembled(spark):
    u, a = "user.message", "assistant.message"
    day = 86_400
    m = [("over", i, (u, a)[i % 2], f"o{i}", "t", day * d + i) for d, (lo, hi) in enumerate([(0, 6), (4, 10), (9, 12)]) for i in range(lo, hi)]
    m += [("apart", i, (u, a)[i % 2], f"p{i}", "t", day * d + i) for d, (lo, hi) in enumerate([(0, 4), (4, 8)]) for i in range(lo, hi)]
    m += [("once", 0, u, "x", "t", 0), ("once", 1, a, "y", "t", 1)]
    rows = build(m, spark)
    none = spark.createDataFrame([], EXPORT)
    got = {r.conv_key: (r.fragments, r.edges, r.whole) for r in conv.assembled(conv.deliveries(conv.message_rows(rows, none))).collect()}
    assert got == {"over": (3, 2, True), "apart": (2, 0, False), "once": (1, 0, True)}
    report = conv.delivery_report(rows, none).collect()
    assert [tuple(r) for r in report] == [("copilot_session", 3, 2, 5, 2, 1)]
    assert conv.delivery_report(rows.where("false"), none).count() == 0


def test_written_times(spark):
    rows = [("2026-01-01T00:00:00Z", 1767225600), ("2026-01-01 00:00:00", 1767225600), ("1767225600000", 1767225600), ("2026-01-01T09:00:00+09:00", 1767225600), ("unknown", None), ("0000-00-00T00:00:00Z", None), ("", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", conv.instant(F.col("t")).alias("v"))
    got = {r.t: r.v for r in df.collect()}
    assert got == {t: None if s is None else s * 1_000_000 for t, s in rows}


def test_deliveries_are_days_at_any_size(spark):
    m = []
    for n in (30, 1500, 3000):  # three days each, of which the first two overlap
        for day, (lo, hi) in enumerate([(0, n // 2), (n // 3, n), (n, n + n // 3)]):
            m += [(f"c{n}", i, ("user.message", "assistant.message")[i % 2], f"{n}-{i}", "t", 86_400 * day + i) for i in range(lo, hi)]
    fragments = conv.deliveries(conv.message_rows(build(m, spark), spark.createDataFrame([], EXPORT)))
    got = {r.conv_key: (r.fragments, r.edges, r.whole) for r in conv.assembled(fragments).collect()}
    assert got == {f"c{n}": (3, 1, False) for n in (30, 1500, 3000)}
    sizes = {(r.conv_key, r.n) for r in fragments.select("conv_key", F.size("hashes").alias("n")).collect()}
    assert sizes == {(f"c{n}", k) for n in (30, 1500, 3000) for k in (n // 2, n - n // 3, n // 3)}


# --- pieces ---

MARKDOWN = """Intro line
wrapped.

# Heading
Text after.
- item
  more
  - nested

- item two

1. other list

> quote
lazy
```py
# no heading

- no list
```
| a | b |
|---|---|
| 1 | 2 |

Setext
======
~~~
never closed
"""


def test_blocks():
    got = [(k, MARKDOWN[a:].split("\n")[0]) for a, k in splitting.scan(MARKDOWN, 0, len(MARKDOWN), splitting.START)[0]]
    assert got == [
        ("paragraph", "Intro line"), ("heading", "# Heading"), ("paragraph", "Text after."), ("list", "- item"), ("list", "1. other list"),
        ("quotation", "> quote"), ("code", "```py"), ("table", "| a | b |"), ("paragraph", "Setext"), ("code", "~~~"),
    ]


@pytest.mark.parametrize("size", [64, 333, 4096])
def test_ranges_give_the_same_blocks_and_cover_the_text(spark, size):
    rnd = random.Random(size)
    parts = MARKDOWN.replace("~~~\nnever closed\n", "").split("\n\n")
    texts = ["\n\n".join(rnd.choice(parts) for _ in range(150)), "word " * 3000, "x" * 9000, ("A line. " * 9 + "\n") * 60 + "# H\n" + "y" * 3000, MARKDOWN, None, ""]
    rows = spark.createDataFrame([("t", i, t, 3) for i, t in enumerate(texts)], "src string, row_id long, text string, no int")
    limit, overlap = 1200, 50
    out = splitting.oversized(rows, limit, overlap, size).collect()
    for i in (0, 1, 2, 3):
        t = texts[i]
        whole = splitting.boundaries(t, 0, len(t), splitting.START, limit - overlap)
        levels = [[b for b, _ in whole[0]], *whole[1:]]
        want = sorted(splitting.scan(t, 0, len(t), splitting.START)[0])
        assert sorted((r.start_at, r.what) for r in out if r.row_id == i and r.what != "piece") == want
        p = sorted((r.start_at, r.end_at) for r in out if r.row_id == i and r.what == "piece")
        every = [levels[0], *(sorted(m.end() for m in f.finditer(t)) for f in (re.compile("\n"), splitting.SENTENCE, splitting.SPACE))]
        assert p == splitting.cuts(0, len(t), levels, limit, overlap) == splitting.cuts(0, len(t), every, limit, overlap)
        assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < b - a <= limit for a, b in p)
        assert all(y[0] == x[1] - overlap for x, y in zip(p, p[1:]))
        assert t[: p[0][1]] + "".join(t[a + overlap : b] for a, b in p[1:]) == t
    assert {r.row_id for r in out} == {0, 1, 2, 3}


@pytest.mark.parametrize("fence", ["~~~~", "`" * 80, "~" * 1600])
def test_fences_open_over_many_ranges(spark, fence):
    lines = "".join("~" * n + "\n\ntext\n\n" for n in range(3, 90))
    t = f"intro\n\n{fence}\n# no heading\n{lines}{fence}~{fence[0]}\n\nlast\n" + "end. " * 300
    out = splitting.oversized(spark.createDataFrame([("t", 1, t)], "src string, row_id long, text string"), 500, 20, 128).collect()
    assert sorted((r.start_at, r.what) for r in out if r.what != "piece") == sorted(splitting.scan(t, 0, len(t), splitting.START)[0])


def test_giant_texts_are_cut_anew_by_segments(spark):
    t = "\n\n".join(f"paragraph {i} " + "word " * 30 for i in range(200))
    rows = spark.createDataFrame([("t", 1, t)], "src string, row_id long, text string")
    ranges = rows.withColumn("copy", F.lit(0).cast("long")).mapInPandas(
        lambda parts: (splitting.pd.DataFrame([("t", 1, 0, no, lo - a, min(lo + 500, len(t)) - a, lo + 500 >= len(t), t[a:b])], columns=splitting.RANGES.names) for _ in parts for no, lo in enumerate(range(0, len(t), 500)) for a, b in [splitting.context(t, lo, min(lo + 500, len(t)))]),
        splitting.RANGES,
    )
    p = sorted((r.start_at, r.end_at) for r in splitting.pieces(splitting.stitched(ranges, 980), 1000, 20, segment=4000).collect())
    assert t[: p[0][1]] + "".join(t[a + 20 : b] for a, b in p[1:]) == t and all(b - a <= 1000 for a, b in p)


def test_files_by_byte_ranges(spark, tmp_path):
    text = "# Überschrift\n\n" + "日本語の文。 " * 3000 + "\n\n- a\n- b\n\n" + "end " * 4000
    path = tmp_path / "big.md"
    path.write_text(text, encoding="utf-8")
    (tmp_path / "none.md").write_text("")
    out = splitting.split_files(spark, [str(path), str(tmp_path / "none.md")], 3000, 100, size=20_011).collect()
    assert {r.row_id for r in out} == {0}
    assert sorted((r.start_at, r.what) for r in out if r.what != "piece") == sorted(splitting.scan(text, 0, len(text), splitting.START)[0])
    p = sorted((r.start_at, r.end_at) for r in out if r.what == "piece")
    assert text[: p[0][1]] + "".join(text[a + 100 : b] for a, b in p[1:]) == text


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        splitting.oversized(spark.createDataFrame([], "src string, row_id long, text string"), 100, 60)


# --- sentences ---

SENTENCES = [
    ["Dr. No came at 5 p.m.", "Then Ms. Ray left."],
    ["Version 4.5.1 is out.", "See fig. 3 and sec. 1.2 of no. 7."],
    ['He wrote, "Stop it! Now." and left.', '"Is it done?" asked Ms. Ray.', 'The log said "none found."', "It ended."],
    ["We wait ... then we go.", "It hangs…", "Next."],
    ["(This was decided in no. 8.)", "It holds."],
    ["Manche Quellen, z. B. eine, sind leer.", "Am 8. März war es d. h. gut.", "Fr. X sagte: „Nein!“, und ging."],
    ["¿Por qué?", "¡No borres el nodo!", "El Sr. X usa EE. UU. desde marzo."],
    ["М. А. Иванов проверил т. к. надо.", "«Готово? Тогда запускай!» — сказал он."],
]


@pytest.mark.parametrize("want", SENTENCES)
def test_known_sentences(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences.split_sentences(text)] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("他只说“可以。”请先检查。真的吗？！“好了吗？”有人问。", ["他只说“可以。”", "请先检查。", "真的吗？！", "“好了吗？”有人问。"]),
        ("「終わった？」と聞かれた。待つ…そして失敗。（第2回で決めた。）次。", ["「終わった？」と聞かれた。", "待つ…そして失敗。", "（第2回で決めた。）", "次。"]),
        ("गाँव है। क्या?", ["गाँव है।", "क्या?"]),
        ("Γιατί χάνεται; Πρώτα δες.", ["Γιατί χάνεται;", "Πρώτα δες."]),
        ("กรุณาเปิด ทำไมหาย ใช้ 3 แถว", ["กรุณาเปิด", "ทำไมหาย", "ใช้ 3 แถว"]),
        ("# Head\nLine one\ngoes on. Two\n- a\n- beta. c\n1. x\n\nUser: hi. you", ["# Head", "Line one\ngoes on.", "Two", "- a", "- beta.", "c", "1. x", "User: hi.", "you"]),
        ("one.Two three!Four a.b.c 3.5x", ["one.", "Two three!", "Four a.b.c 3.5x"]),
        ('The log said "none found." vajox reports 3 s. It holds notes, etc. vajox too. It holds etc. and more.', ['The log said "none found."', "vajox reports 3 s.", "It holds notes, etc.", "vajox too.", "It holds etc. and more."]),
        (" \n\t ", []),
        ("", []),
    ],
)
def test_scripts_and_blocks(text, want):
    assert [text[a:b] for a, b in sentences.split_sentences(text)] == want


@pytest.mark.parametrize("chunk", [300, 1111])
def test_ranges_give_the_same_sentences(spark, chunk):
    rows = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").withColumn("copy", F.lit("x")).withColumn("no", F.lit(1))
    rows = rows.unionByName(rows.where("doc_id < 5"))
    got = sorted(tuple(r) for r in sentences.sentences(rows, chunk=chunk).collect())
    want = sorted((r.doc_id, a, b) for r in rows.collect() for a, b in sentences.split_sentences(r.text))
    assert got == want


@pytest.mark.parametrize("chunk", [200, 4096])
def test_long_quotations_deep_nesting_and_giant_paragraphs(spark, chunk):
    inner = "It holds. " * 70
    quote = f'He wrote, "{inner}done" and left. Next one.'
    deep = "He said " + "".join(f"{o}so. " for o in "«“「«“「«") + "".join(f"{c} so. " for c in "»”」»”」»") + "and left. Next."
    texts = [quote, deep, (quote + " ") * 40, "一句。" * 9000, ("word " * 30 + ". ") * 300, "a\n\n" * 4000, quote.replace('"', "")]
    assert [quote[a:b] for a, b in sentences.split_sentences(quote)] == [quote[: -len(" Next one.")], "Next one."]
    got = sorted(tuple(r) for r in sentences.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk=chunk).collect())
    assert got == sorted((i, a, b) for i, t in enumerate(texts) for a, b in sentences.split_sentences(t))


def test_transfer_functions_compose():
    rnd = random.Random(2)
    kinds = [rnd.randrange(sentences.SYMBOLS) for _ in range(200)]
    parts = [kinds[i : i + 9] for i in range(0, 200, 9)]
    import numpy as np

    states = sentences.prefix_states(np.array([sentences.transfer(p) for p in parts]))
    state = 0
    for p, got in zip(parts, states):
        assert got == state
        for x in p:
            state = sentences.NEXT[state][x]


def test_overlaps_of_any_length(spark):
    rows = spark.createDataFrame([("s", "c", 0, list(range(60))), ("s", "c", 1, list(range(20, 90))), ("s", "c", 2, list(range(89, 99)))], "src string, conv_key string, frag int, hashes array<long>")
    assert sorted((r.a, r.b, r.k) for r in conv.overlap_edges(rows).collect()) == [(0, 1, 40), (1, 2, 1)]
