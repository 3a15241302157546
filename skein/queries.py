"""The engine's queries over the standard tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import rules
from skein.functions import extract as X
from skein.functions import text as T
from skein.operators import graph, merge, repair, views
from skein.plans import active_thread as thread
from skein.plans import reports, turns
from skein.schema import (
    ACTIVE_NODES, ACTIVE_THREAD, ALWAYS_ALLOWED, DIGEST_ACTIVE, DIGEST_RESOLVED, NODE_STATUSES, NODE_TYPES, OPEN, RELATIONS,
    REMEDIATE_SKIP, RESOLVED_SUMMARY, TERMINAL,
)
from skein.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The graph as it stood at this time is "existing", what came later "incoming".
SPLIT = "2026-03-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "nodes")


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "edges")


def _halves(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    n = _nodes(spark, root)
    return n.where(F.col("created_at") < F.lit(SPLIT).cast("timestamp")), n.where(F.col("created_at") >= F.lit(SPLIT).cast("timestamp"))


# --- pieces of SQL ----------------------------------------------------------------------------------------------------


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _case(values: dict[str, str], key: str, default: str = "NULL") -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rules(values: list[tuple[str, str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}', '{r}')" for a, b, r in values) + ")"


WS = r"[\t\n\x0b\f\r\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _ordered(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _first(x: str, n: int) -> str:
    return f"list_slice({_ordered(x)}, 1, {n})"


OLD = f"(SELECT * FROM nodes WHERE created_at < TIMESTAMPTZ '{SPLIT} 00:00:00+00')"
NEW = f"(SELECT * FROM nodes WHERE created_at >= TIMESTAMPTZ '{SPLIT} 00:00:00+00')"
ENDS = "(SELECT session_id, from_id AS id FROM edges WHERE from_id IS NOT NULL UNION SELECT session_id, to_id FROM edges WHERE to_id IS NOT NULL)"
IDS = "(SELECT DISTINCT session_id, id FROM nodes WHERE id IS NOT NULL AND session_id IS NOT NULL)"
REAL = f"(SELECT e.* FROM edges e SEMI JOIN {IDS} a ON e.session_id = a.session_id AND e.from_id = a.id SEMI JOIN {IDS} b ON e.session_id = b.session_id AND e.to_id = b.id)"
LINKS = f"(SELECT DISTINCT * FROM (SELECT session_id, from_id AS a, to_id AS b FROM {REAL} WHERE from_id <> to_id UNION ALL SELECT session_id, to_id, from_id FROM {REAL} WHERE from_id <> to_id))"
ORPHANS = f"(SELECT n.* FROM nodes n ANTI JOIN {ENDS} e ON n.session_id = e.session_id AND n.id = e.id)"
CONNECTED = f"(SELECT n.* FROM nodes n SEMI JOIN {ENDS} e ON n.session_id = e.session_id AND n.id = e.id)"
SURE = "coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, -1e9)"
PAIR_WORDS = r"regexp_extract_all(lower(label), '[\p{L}\p{N}_]+')"


def _label_words(label: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({label}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN {_in(stop)}))"


# --- text -------------------------------------------------------------------------------------------------------------


def _masked_sql(x: str) -> str:
    for p in rules.MASKS:
        x = f"regexp_replace({x}, {_q(p)}, '[REDACTED]', 'g')"
    return x


@query(f"SELECT doc_id, {_masked_sql('text')} AS masked FROM documents")
def mask_secrets(spark, root):
    return table(spark, root, "documents").select("doc_id", T.mask(F.col("text")).alias("masked"))


_URLS = "list_transform(regexp_extract_all(text, 'https?://[^\\s''\"<>)]+'), lambda x: regexp_replace(x, '[.,;)]+$', ''))"


@query(f"SELECT doc_id, array_to_string({_first(_URLS, 10)}, ' ') AS urls FROM documents WHERE text IS NOT NULL")
def urls(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.array_join(T.urls(F.col("text")), " ").alias("urls"))


_PATHS = f"list_filter(list_zip(regexp_extract_all(content, {_q(rules.FILE_REF)}, 1), regexp_extract_all(content, {_q(rules.FILE_REF)}, 2)), lambda x: length(x[1]) >= 4)"


@query(
    f"WITH p AS (SELECT row_id, {_PATHS} AS p FROM copilot_session WHERE content IS NOT NULL), e AS (SELECT row_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p),"
    " f AS (SELECT row_id, x[1] AS path, min(i) AS i, arg_min(x[2], i) AS n FROM e GROUP BY ALL)"
    f" SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i)::INT AS no, path, TRY_CAST(nullif(n, '') AS INT) AS line, {_case(rules.LANGUAGES, 'lower(regexp_extract(path, ' + _q('[.]([A-Za-z]+)$') + ', 1))')} AS language"
    " FROM f QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY i) <= 10"
)
def file_refs(spark, root):
    t = table(spark, root, "copilot_session").where("content is not null").select("row_id", F.posexplode(T.file_mentions(F.col("content"))).alias("n", "f"))
    return t.select("row_id", (F.col("n") + 1).alias("no"), "f.*")


_LANGS = r"regexp_extract_all(content, '(?s)```(\w*)\n(.*?)```', 1)"
_BODIES = r"regexp_extract_all(content, '(?s)```(\w*)\n(.*?)```', 2)"
_LANG_OF = _case(rules.LANGUAGES, "lower(x)", "CASE WHEN x = '' THEN 'text' ELSE lower(x) END")


@query(
    f"SELECT row_id, len({_LANGS}) AS n_blocks, array_to_string(list_transform({_LANGS}, lambda x: {_LANG_OF}), ' ') AS languages,"
    f" coalesce(list_sum(list_transform({_BODIES}, lambda x: length(x))), 0)::BIGINT AS n_chars FROM copilot_session WHERE content IS NOT NULL"
)
def code_blocks(spark, root):
    b = table(spark, root, "copilot_session").where("content is not null").select("row_id", T.code_blocks(F.col("content")).alias("b"))
    return b.select(
        "row_id",
        F.size("b").alias("n_blocks"),
        F.array_join(F.transform("b", lambda x: x["language"]), " ").alias("languages"),
        F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + F.length(x["content"])).alias("n_chars"),
    )


_SYMBOLS = r"list_transform(regexp_extract_all(text, '(?m)(^(?:async )?def\s+\w+|^class\s+\w+)', 1), lambda x: regexp_replace(x, '^(?:async )?(?:def|class)\s+', ''))"


@query(f"SELECT doc_id, array_to_string({_first(_SYMBOLS, 20)}, ' ') AS symbols FROM documents WHERE text IS NOT NULL")
def python_symbols(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.array_join(T.symbols(F.col("text"), "python"), " ").alias("symbols"))


_PY, _JS = _q(rules.PYTHON_TRACE), _q(rules.SCRIPT_ERROR)
_PLACE = lambda i: f"regexp_extract_all(content, {_q(rules.PYTHON_PLACE)}, {i})[-1]"
_MESSAGE = f"left({_strip(f'regexp_extract(content, {_PY}, 2)')}, 200)"


@query(
    f"WITH j AS (SELECT row_id, content, unnest(regexp_extract_all(content, {_JS}, 1)) AS e, unnest(regexp_extract_all(content, {_JS}, 2)) AS m, generate_subscripts(regexp_extract_all(content, {_JS}, 1), 1)::INT AS no"
    f" FROM copilot_session WHERE NOT regexp_matches(content, {_PY}))"
    f" SELECT row_id, 1 AS no, regexp_extract(content, {_PY}, 1) AS exception, {_MESSAGE} AS message, {_PLACE(1)} AS file, TRY_CAST({_PLACE(2)} AS INT) AS line,"
    f" TRY_CAST(nullif(regexp_extract({_MESSAGE}, {_q(rules.HTTP_STATUS)}, 1), '') AS INT) AS http_status FROM copilot_session WHERE regexp_matches(content, {_PY})"
    f" UNION ALL SELECT row_id, no, e, left({_strip('m')}, 200), nullif(regexp_extract(content, {_q(rules.SCRIPT_FRAME)}, 1), ''), TRY_CAST(nullif(regexp_extract(content, {_q(rules.SCRIPT_FRAME)}, 2), '') AS INT), NULL FROM j"
)
def stack_traces(spark, root):
    t = table(spark, root, "copilot_session").select("row_id", F.posexplode(T.stack_traces(F.col("content"))).alias("n", "t"))
    return t.select("row_id", (F.col("n") + 1).alias("no"), "t.*")


_RUNS = f"list_concat(list_transform(regexp_extract_all(content, {_q(rules.PYTEST)}), lambda x: {{'tool': 'pytest', 's': x}}), list_transform(regexp_extract_all(content, {_q(rules.JEST)}), lambda x: {{'tool': 'jest', 's': x}}))"
_ARNS = f"regexp_extract_all(content, {_q(rules.ARN)})"
_NUMBER = lambda p, i=1: f"TRY_CAST(nullif(regexp_extract(s, {_q(p)}, {i}), '') AS INT)"


@query(
    f"WITH r AS (SELECT row_id, content, {_RUNS} AS r, {_ARNS} AS a FROM copilot_session WHERE content IS NOT NULL), x AS ("
    f"SELECT row_id, content, unnest(r, recursive := true), generate_subscripts(r, 1) AS i FROM r"
    f" UNION ALL SELECT row_id, content, 'npm', 'npm error detected', 1 FROM r WHERE len(r) = 0 AND regexp_matches(content, {_q(rules.NPM)})"
    " UNION ALL SELECT row_id, content, 'aws', 'AWS ARNs found: ' || a[1] || CASE WHEN len(a) > 1 THEN '...' ELSE '' END, 1000000 FROM r WHERE len(a) > 0)"
    f" SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i)::INT AS no, tool, CASE WHEN tool = 'pytest' THEN TRY_CAST(nullif(regexp_extract(content, {_q(rules.EXIT_CODE)}, 1), '') AS INT) END AS exit_code,"
    f" CASE tool WHEN 'pytest' THEN {_NUMBER(chr(40) + chr(92) + 'd+) passed')} WHEN 'jest' THEN {_NUMBER(rules.JEST)} END AS passed, CASE tool WHEN 'pytest' THEN {_NUMBER(chr(40) + chr(92) + 'd+) failed')} WHEN 'jest' THEN {_NUMBER(rules.JEST, 2)} END AS failed,"
    f" CASE tool WHEN 'jest' THEN regexp_extract(s, {_q(rules.JEST)}, 1) || ' passed, ' || regexp_extract(s, {_q(rules.JEST)}, 2) || ' failed' WHEN 'pytest' THEN {_strip('s')} ELSE s END AS signal FROM x"
)
def cli_outputs(spark, root):
    t = table(spark, root, "copilot_session").where("content is not null").select("row_id", F.posexplode(T.cli_outputs(F.col("content"))).alias("n", "t"))
    return t.select("row_id", (F.col("n") + 1).alias("no"), "t.*")


@query()
def schema_blobs(spark, root):
    t = table(spark, root, "documents").where("text is not null").select("doc_id", F.posexplode(T.schema_blobs(F.col("text"))).alias("n", "k"))
    return t.select("doc_id", (F.col("n") + 1).alias("no"), F.array_join("k", " ").alias("keys"))


@query()
def block_symbols(spark, root):
    t = table(spark, root, "copilot_session").where("content is not null").select("row_id", F.posexplode(T.code_blocks(F.col("content"))).alias("n", "b"))
    t = t.select("row_id", (F.col("n") + 1).alias("no"), "b.language", T.block_symbols(F.col("b.content"), F.col("b.language")).alias("s"))
    return t.select("row_id", "no", "language", F.array_join("s", " ").alias("symbols"))


def _chunks_sql(src: str, most: int) -> str:
    packed = (
        f"list_reduce(list_prepend([''], list_transform(regexp_split_to_array({src}, '\\n{{2,}}'), lambda x: [x])), lambda a, x:"
        f" CASE WHEN length(a[-1]) + length(x[1]) > {most} AND a[-1] <> '' THEN list_append(a, x[1])"
        " ELSE list_append(list_slice(a, 1, len(a) - 1), regexp_replace(a[-1] || chr(10) || chr(10) || x[1], '^\\n+', '')) END)"
    )
    return packed


@query(
    f"WITH p AS (SELECT doc_id, {_chunks_sql('text', 4000)} AS c FROM documents WHERE text IS NOT NULL),"
    f" s AS (SELECT doc_id, unnest(list_transform(c, lambda x: {_strip('x')})) AS chunk, generate_subscripts(c, 1) AS n, len(c) AS m FROM p)"
    " SELECT doc_id, n::INT AS chunk_no, chunk FROM s WHERE n < m OR chunk <> ''"
)
def para_chunks(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(T.paragraph_chunks(F.col("text"))).alias("n", "chunk")).select("doc_id", (F.col("n") + 1).alias("chunk_no"), "chunk")


_PARTS = "string_split(regexp_replace(text, '(?m)^(#{1,3}[ \\t]+[^\\s])', chr(1) || '\\1', 'g'), chr(1))"
_TITLED = "regexp_matches(p, '^#{1,3}[ \\t]+[^\\s]')"
_HEAD = "'^#{1,3}\\s+([^\\n]+)'"
_LIST = _chunks_sql("body", 4000)


@query(
    f"WITH p AS (SELECT doc_id, unnest({_PARTS}) AS p, generate_subscripts({_PARTS}, 1) AS i FROM documents WHERE text IS NOT NULL),"
    f" s AS (SELECT doc_id, i, {_TITLED} AS titled, CASE WHEN {_TITLED} THEN {_strip(f'regexp_extract(p, {_HEAD}, 1)')} ELSE '' END AS heading, {_strip(f"CASE WHEN {_TITLED} THEN regexp_replace(p, {_HEAD}, '') ELSE p END")} AS body FROM p),"
    f" c AS (SELECT *, CASE WHEN titled AND length(body) > 4000 THEN list_transform({_LIST}, lambda x: {_strip('x')}) ELSE [body] END AS l FROM s),"
    " d AS (SELECT doc_id, i, heading, CASE WHEN len(l) > 1 AND l[-1] = '' THEN list_slice(l, 1, len(l) - 1) ELSE l END AS l FROM c),"
    " x AS (SELECT doc_id, i, CASE WHEN len(l) > 1 THEN heading || ' (' || j || '/' || len(l) || ')' ELSE heading END AS heading, l[j] AS body, j FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM d))"
    " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j)::INT AS section_no, heading, body FROM x WHERE heading <> '' OR body <> ''"
)
def doc_sections(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    s = d.select("doc_id", F.posexplode(T.markdown_sections(F.col("text"))).alias("n", "s"))
    return s.select("doc_id", (F.col("n") + 1).alias("section_no"), "s.heading", "s.body")


@query(
    "SELECT doc_id, CASE WHEN e IN ('.md', '.mdx', '.markdown') THEN 'markdown' WHEN e = '.json' THEN 'json' WHEN e IN ('.yaml', '.yml') THEN 'yaml' ELSE 'text' END AS format"
    " FROM (SELECT doc_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS e FROM documents)"
)
def doc_format(spark, root):
    return table(spark, root, "documents").select("doc_id", T.document_format(F.col("path")).alias("format"))


@query(
    "SELECT seq, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(label, '') || ' ' || coalesce(summary, '')), '[a-z0-9]+'))), ' ') AS tokens FROM nodes"
)
def search_tokens(spark, root):
    t = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("summary", F.lit("")))
    return _nodes(spark, root).select("seq", F.array_join(F.array_sort(T.search_tokens(t)), " ").alias("tokens"))


@query(f"SELECT seq, array_to_string(list_sort({_label_words('label', rules.STOP)}), ' ') AS tokens FROM nodes WHERE label IS NOT NULL")
def label_tokens(spark, root):
    n = _nodes(spark, root).where("label is not null")
    return n.select("seq", F.array_join(F.array_sort(T.label_tokens(F.col("label"))), " ").alias("tokens"))


@query("SELECT seq, replace(replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM nodes")
def xml_escape(spark, root):
    return _nodes(spark, root).select("seq", T.escape_xml(F.col("summary")).alias("escaped"))


@query("SELECT row_id, regexp_replace(text, '<[^>]+>', '', 'g') AS plain FROM claude_export")
def strip_tags(spark, root):
    return table(spark, root, "claude_export").select("row_id", T.strip_tags(F.col("text")).alias("plain"))


@query(
    f"SELECT doc_id, {_case(rules.COMMIT_HINTS, 'lower(regexp_extract(text, ' + _q('^([\\p{L}\\p{N}_]+)[(:]') + ', 1))', chr(39) * 2)} AS hint FROM documents WHERE text IS NOT NULL"
)
def commit_hints(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", T.commit_hint(F.col("text")).alias("hint"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?m)^#([A-Za-z0-9_/-]+)', 1))), ' ') AS tags FROM documents WHERE text IS NOT NULL")
def vault_tags(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(F.array_sort(F.array_distinct(T.all_matches(F.col("text"), r"(?md)^#([A-Za-z0-9_/-]+)"))), " ").alias("tags"))


@query(
    r"""WITH l AS (SELECT doc_id, lower(trim(unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)))) AS target FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, lower(regexp_extract(path, '([^/.]+)\.[^./]+$', 1)) AS name FROM documents WHERE path IS NOT NULL)
    SELECT DISTINCT l.doc_id AS from_doc, p.doc_id AS to_doc FROM l JOIN p ON l.target = p.name"""
)
def wikilinks(spark, root):
    from skein.sources.vault import wikilink_edges

    return wikilink_edges(table(spark, root, "documents"))


# --- extraction -------------------------------------------------------------------------------------------------------

_STATUS = f"CASE WHEN status IN {_in(NODE_STATUSES)} THEN status ELSE 'active' END"


@query(
    f"SELECT seq, CASE WHEN type IN {_in(NODE_TYPES)} THEN type ELSE 'concept' END AS type, left(label, 120) AS label, left(summary, 500) AS summary,"
    f" CASE WHEN type = 'task' AND {_STATUS} = 'active' THEN 'pending' ELSE {_STATUS} END AS status FROM nodes"
)
def validate_nodes(spark, root):
    kind = X.valid_type(F.col("type"))
    return _nodes(spark, root).select(
        "seq", kind.alias("type"), F.left("label", F.lit(120)).alias("label"), F.left("summary", F.lit(500)).alias("summary"), X.valid_status(F.col("status"), kind).alias("status")
    )


_WORDS = r"regexp_extract_all(lower(label), '[\p{L}\p{N}_]+')"
_HITS = f"len(list_filter({_WORDS}, lambda w: contains(lower(coalesce(summary, '')), w)))"


@query(f"SELECT seq, {_HITS} >= CASE WHEN len({_WORDS}) < 2 THEN 1 ELSE greatest(2, round(len({_WORDS}) * 0.6)) END AS grounded FROM nodes WHERE label IS NOT NULL")
def grounding(spark, root):
    return _nodes(spark, root).where("label is not null").select("seq", X.grounded(F.col("label"), F.col("summary")).alias("grounded"))


def _speculative_sql() -> str:
    # the same without looking ahead: a version ends in a digit that no further sign of a word follows
    phantom = r"(?i)\b(?:(?:gpt-[5-9]|claude-[5-9]|gemini-[3-9])(?:[.\d]*\d)?(?:[^\w-]|$)|gpt-[1-9]\d(?:[.\d]*\d)?\b)"
    window = "substr(t, greatest(1, p - 120), p + 200 - greatest(1, p - 120))"
    reason = f"CASE WHEN regexp_matches(label, {_q(phantom)}) THEN 'model_name_unverified' WHEN p > 0 AND regexp_matches({window}, {_q(rules.SPECULATION)}) THEN 'speculative_language_in_context' END"
    return (
        "WITH n AS (SELECT seq, label, confidence, coalesce(summary, '') AS t, position(left(lower(label), 20) IN lower(coalesce(summary, ''))) AS p FROM nodes WHERE label IS NOT NULL),"
        f" r AS (SELECT seq, {reason} AS reason, confidence AS c FROM n)"
        " SELECT seq, reason, round(CASE WHEN isnan(c) THEN CASE WHEN reason IS NULL THEN NULL WHEN reason = 'model_name_unverified' THEN 0.40 ELSE 0.45 END WHEN reason = 'model_name_unverified' THEN least(c, 0.40) WHEN reason IS NOT NULL THEN least(c, 0.45) ELSE c END, 3) AS confidence FROM r"
    )


@query(_speculative_sql())
def speculative(spark, root):
    reason = X.speculative_reason(F.col("label"), F.col("summary"))
    n = _nodes(spark, root).where("label is not null").withColumn("reason", reason)
    return n.select("seq", "reason", F.round(X.capped(F.nanvl("confidence", F.lit(None).cast("double")), F.col("reason")), 3).alias("confidence"))


_TASK, _CONCEPT, _KEEP = _q(rules.FILE_TO_TASK), _q(rules.FILE_TO_CONCEPT), _q(rules.FILE_KEEP)


@query(
    f"SELECT seq, CASE WHEN type = 'file' AND NOT regexp_matches(label, {_KEEP}) AND regexp_matches(label, {_TASK}) THEN 'task'"
    f" WHEN type = 'file' AND NOT regexp_matches(label, {_KEEP}) AND regexp_matches(label, {_CONCEPT}) THEN 'concept' ELSE type END AS type,"
    f" CASE WHEN type = 'file' AND NOT regexp_matches(label, {_KEEP}) AND regexp_matches(label, {_TASK}) THEN CASE WHEN status = 'active' THEN 'done' ELSE status END"
    f" WHEN type = 'file' AND NOT regexp_matches(label, {_KEEP}) AND regexp_matches(label, {_CONCEPT}) THEN 'active' ELSE status END AS status FROM nodes"
)
def reclassify_files(spark, root):
    kind, status = X.reclassified(F.col("type"), F.col("status"), F.col("label"))
    return _nodes(spark, root).select("seq", kind.alias("type"), status.alias("status"))


@query(
    f"SELECT seq, CASE WHEN len({_WORDS}) = 0 THEN 0.0 ELSE round_even(least(1.0, sqrt({_HITS}::DOUBLE / len({_WORDS}) * CASE WHEN len({_WORDS}) <= 2 THEN 0.75 ELSE 1.0 END * confidence)), 3) END AS confidence"
    " FROM nodes WHERE label IS NOT NULL AND confidence >= 0 AND NOT isnan(confidence)"
)
def confidence(spark, root):
    n = _nodes(spark, root).where("label is not null and confidence >= 0 and not isnan(confidence)")
    return n.select("seq", X.confidence(F.col("label"), F.col("summary"), F.col("confidence")).alias("confidence"))


@query(
    f"""WITH named AS (SELECT e.session_id, a.label AS fl, b.label AS tl, e.relation, e.seq FROM edges e
     JOIN (SELECT session_id, id, arg_max(label, seq) AS label FROM nodes WHERE id IS NOT NULL GROUP BY ALL) a ON e.session_id = a.session_id AND e.from_id = a.id
     JOIN (SELECT session_id, id, arg_max(label, seq) AS label FROM nodes WHERE id IS NOT NULL GROUP BY ALL) b ON e.session_id = b.session_id AND e.to_id = b.id),
    ids AS (SELECT session_id, lower(label) AS l, arg_max(id, seq) AS id FROM nodes GROUP BY ALL)
    SELECT n.seq, x.id AS from_id, y.id AS to_id, CASE WHEN n.relation IN {_in(RELATIONS)} THEN n.relation ELSE 'relates-to' END AS relation
    FROM named n JOIN ids x ON n.session_id = x.session_id AND lower(n.fl) = x.l JOIN ids y ON n.session_id = y.session_id AND lower(n.tl) = y.l"""
)
def bind_edges(spark, root):
    nodes, edges = _nodes(spark, root), _edges(spark, root)
    label = nodes.where("id is not null").groupBy("session_id", "id").agg(F.max_by("label", "seq").alias("label"))
    named = edges.select("session_id", "from_id", "to_id", "relation", "seq")
    for end in ("from", "to"):
        named = named.join(label.select("session_id", F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label")), ["session_id", f"{end}_id"])
    return merge.bind_edges(nodes, named.drop("from_id", "to_id")).select("seq", "from_id", "to_id", "relation")


# --- merge ------------------------------------------------------------------------------------------------------------

_SETTLED, _FREE = f"t.status IN {_in(TERMINAL)} AND (n.status IN {_in(OPEN)} OR n.status IN {_in(TERMINAL)})", f"n.status IN {_in(ALWAYS_ALLOWED)}"
_CLASH = f"(t.seq IS NOT NULL AND coalesce(t.status <> n.status AND NOT ({_FREE}) AND {_SETTLED}, false))"


def _dedup_sql(settled: str) -> str:
    return (
        f"WITH t AS (SELECT session_id, type, lower(label) AS l, arg_max(id, struct_pack(c := created_at, s := seq)) AS id, arg_max(status, struct_pack(c := created_at, s := seq)) AS status,"
        f" max(struct_pack(c := created_at, s := seq)).s AS seq FROM {OLD} GROUP BY ALL),"
        " r AS (SELECT o.session_id, o.type, lower(o.label) AS l, o.id, o.status, o.seq, o.summary, o.confidence FROM t JOIN nodes o ON o.seq = t.seq)"
        f" SELECT n.seq, t.seq AS target_seq, CASE WHEN {_CLASH} THEN {settled} WHEN t.seq IS NOT NULL AND NOT coalesce(n.status <> '', false) THEN t.status ELSE n.status END AS status,"
        f" CASE WHEN t.seq IS NOT NULL AND coalesce(n.summary, '') = '' THEN t.summary ELSE n.summary END AS summary, {_CLASH} AS conflict,"
        " greatest(CASE WHEN NOT isnan(n.confidence) THEN n.confidence END, CASE WHEN NOT isnan(t.confidence) THEN t.confidence END) AS confidence"
        f" FROM {NEW} n LEFT JOIN r t ON n.session_id = t.session_id AND n.type = t.type AND lower(n.label) = t.l"
    )


def _dedup(spark, root, policy):
    old, new = _halves(spark, root)
    return merge.exact_dedup(old, new, policy).select("seq", "target_seq", "status", "summary", "conflict", "confidence")


@query(_dedup_sql("'conflicted'"))
def exact_dedup(spark, root):
    return _dedup(spark, root, "manual")


@query(_dedup_sql("n.status"))
def conflict_accept_incoming(spark, root):
    return _dedup(spark, root, "auto-accept-incoming")


@query(_dedup_sql("t.status"))
def conflict_keep_existing(spark, root):
    return _dedup(spark, root, "auto-keep-existing")


@query(
    f"SELECT t.status AS current, n.status AS incoming, t.status <> n.status AND NOT ({_FREE}) AND {_SETTLED} AS conflict FROM"
    f" (SELECT unnest({NODE_STATUSES}) AS status) t, (SELECT unnest({NODE_STATUSES}) AS status) n"
)
def conflict_matrix(spark, root):
    pairs = [(a, b) for a in NODE_STATUSES for b in NODE_STATUSES]
    d = spark.createDataFrame(pairs, "current string, incoming string")
    return d.withColumn("conflict", X.is_conflict(F.col("current"), F.col("incoming")))


def _match_sql(on: str, extra: str, least: float) -> str:
    return (
        f"WITH s AS (SELECT n.seq, e.seq AS m, list_cosine_similarity(n.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM {NEW} n JOIN {OLD} e ON n.session_id = e.session_id AND {on}"
        f" AND len(n.embedding) = len(e.embedding) AND n.seq <> e.seq {extra} WHERE len(n.embedding) > 0)"
        f" SELECT seq, arg_max(m, struct_pack(s := score, m := -m)) AS match_seq, round(max(score), 5) AS score FROM s WHERE score >= {least} AND NOT isnan(score) GROUP BY seq"
    )


@query(_match_sql("n.type = e.type", "", 0.70))
def best_match(spark, root):
    old, new = _halves(spark, root)
    return merge.best_match(old, new).withColumn("score", F.round("score", 5))


_CROSS = " OR ".join(f"(n.type = '{a}' AND e.type = '{b}') OR (n.type = '{b}' AND e.type = '{a}')" for a, b in rules.CROSS_PAIRS)


@query(_match_sql(f"({_CROSS})", "", 0.82))
def cross_type_match(spark, root):
    old, new = _halves(spark, root)
    return merge.cross_type_match(old, new).withColumn("score", F.round("score", 5))


@query(_match_sql(f"({_CROSS})", "", 0.30))
def cross_type_loose(spark, root):
    """As cross_type_match, at a threshold that more of the pairs reach."""
    old, new = _halves(spark, root)
    return merge.cross_type_match(old, new, 0.30).withColumn("score", F.round("score", 5))


@query()
def semantic_merge(spark, root):
    old, new = _halves(spark, root)
    known = _edges(spark, root).join(old.select("session_id", F.col("id").alias("from_id")).distinct(), ["session_id", "from_id"], "left_semi")
    known = known.join(old.select("session_id", F.col("id").alias("to_id")).distinct(), ["session_id", "to_id"], "left_semi")
    return merge.semantic_merge(old, new, budget=merge.relate_budget(known))


@query("SELECT session_id, greatest(0, floor(count(*) * 0.28) - count(*) FILTER (relation = 'relates-to'))::BIGINT AS budget FROM edges GROUP BY session_id")
def relate_budget(spark, root):
    return merge.relate_budget(_edges(spark, root))


_MAP = f"(SELECT n.session_id, n.id AS old_id, min(t.id) AS new_id FROM {NEW} n JOIN (SELECT session_id, type, lower(label) AS l, arg_max(id, struct_pack(c := created_at, s := seq)) AS id FROM {OLD} GROUP BY ALL) t ON n.session_id = t.session_id AND n.type = t.type AND lower(n.label) = t.l WHERE n.id IS NOT NULL AND t.id IS NOT NULL GROUP BY ALL)"


@query(
    f"SELECT e.seq, coalesce(a.new_id, e.from_id) AS from_id, coalesce(b.new_id, e.to_id) AS to_id FROM edges e LEFT JOIN {_MAP} a ON e.session_id = a.session_id AND e.from_id = a.old_id"
    f" LEFT JOIN {_MAP} b ON e.session_id = b.session_id AND e.to_id = b.old_id SEMI JOIN {IDS} x ON e.session_id = x.session_id AND coalesce(a.new_id, e.from_id) = x.id"
    f" SEMI JOIN {IDS} y ON e.session_id = y.session_id AND coalesce(b.new_id, e.to_id) = y.id"
)
def resolve_edges(spark, root):
    old, new = _halves(spark, root)
    m = merge.exact_dedup(old, new).where("target_id is not null and id is not null").select("session_id", F.col("id").alias("old_id"), F.col("target_id").alias("new_id"))
    return merge.resolve_edges(_edges(spark, root), _nodes(spark, root), m).select("seq", "from_id", "to_id")


@query(
    f"WITH c AS (SELECT o.session_id, o.seq AS from_seq, p.seq AS to_seq, r.r AS relation, row_number() OVER (PARTITION BY o.session_id, o.seq ORDER BY p.seq) AS n FROM {ORPHANS} o"
    f" JOIN nodes p ON o.session_id = p.session_id AND o.id <> p.id JOIN {_rules(rules.ORPHAN_EDGES)} r(a, b, r) ON o.type = r.a AND p.type = r.b)"
    " SELECT session_id, from_seq, to_seq, relation, 0.5::DOUBLE AS weight FROM c WHERE n = 1"
)
def orphan_patch(spark, root):
    return merge.orphan_patch(_nodes(spark, root), _edges(spark, root))


@query()
def minimum_edges(spark, root):
    n = _nodes(spark, root).where("id is not null").select(
        F.concat_ws("|", "session_id", F.date_format("created_at", "yyyy-MM-dd")).alias("batch"), "seq", "id", "type"
    )
    e = _edges(spark, root).join(n.select("batch", F.col("id").alias("from_id")).distinct(), "from_id").select("batch", "from_id", "to_id")
    return merge.minimum_edges(n, e)


# --- repair -----------------------------------------------------------------------------------------------------------


@query(f"SELECT seq, CASE WHEN confidence < 0.5 AND status NOT IN {_in(REMEDIATE_SKIP)} THEN 'unconfirmed' ELSE status END AS status, coalesce(len(status_history), 0) + coalesce((confidence < 0.5 AND status NOT IN {_in(REMEDIATE_SKIP)})::INT, 0) AS n_history FROM nodes")
def remediate(spark, root):
    return repair.remediate(_nodes(spark, root), at="2026-07-01").select("seq", "status", F.coalesce(F.size("status_history"), F.lit(0)).alias("n_history"))


_KINDS = "(SELECT session_id, id, arg_max(type, seq) AS t FROM nodes WHERE id IS NOT NULL GROUP BY ALL)"


@query(
    f"SELECT e.seq, CASE WHEN e.relation = 'relates-to' AND a.t <> b.t THEN coalesce(r.r, e.relation) ELSE e.relation END AS relation FROM edges e LEFT JOIN {_KINDS} a ON e.session_id = a.session_id AND e.from_id = a.id"
    f" LEFT JOIN {_KINDS} b ON e.session_id = b.session_id AND e.to_id = b.id LEFT JOIN {_rules(rules.UPGRADES)} r(x, y, r) ON a.t = r.x AND b.t = r.y"
)
def upgrade_relations(spark, root):
    return repair.upgrade_relations(_nodes(spark, root), _edges(spark, root)).select("seq", "relation")


@query(
    f"""WITH w AS (SELECT session_id, seq, id, type, {_label_words('label', rules.STOP)} AS w FROM nodes WHERE id IS NOT NULL AND session_id IS NOT NULL),
    x AS (SELECT session_id, seq, unnest(w) AS t FROM w),
    p AS (SELECT a.session_id, a.seq AS i, b.seq AS j, count(*) AS shared FROM x a JOIN x b ON a.session_id = b.session_id AND a.t = b.t AND a.seq < b.seq GROUP BY ALL HAVING count(*) >= 2),
    l AS (SELECT session_id, from_id AS f, to_id AS t FROM edges UNION SELECT session_id, to_id, from_id FROM edges),
    c AS (SELECT p.session_id, i, j, shared, a.type AS ta, b.type AS tb, len(a.w) AS la, len(b.w) AS lb FROM p JOIN w a ON p.session_id = a.session_id AND p.i = a.seq JOIN w b ON p.session_id = b.session_id AND p.j = b.seq
     ANTI JOIN l ON l.session_id = p.session_id AND l.f = a.id AND l.t = b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i, j) AS n FROM c)
    SELECT n.session_id, i AS from_seq, j AS to_seq, coalesce(r.r, s.r, 'relates-to') AS relation, round_even(shared::DOUBLE / greatest(la, lb), 3) AS weight FROM n
    LEFT JOIN {_rules(rules.INFERRED)} r(x, y, r) ON n.ta = r.x AND n.tb = r.y LEFT JOIN {_rules(rules.INFERRED)} s(x, y, r) ON n.tb = s.x AND n.ta = s.y WHERE n.n <= 200"""
)
def infer_edges(spark, root):
    return repair.infer_edges(_nodes(spark, root), _edges(spark, root))


_HEAL = (
    f" LEFT JOIN {_rules(rules.ORPHAN_EDGES)} r(x, y, r) ON h.ft = r.x AND h.tt = r.y LEFT JOIN {_rules(rules.ORPHAN_EDGES)} s(x, y, r) ON h.tt = s.x AND h.ft = s.y"
)


@query(
    f"WITH s AS (SELECT o.session_id, o.seq AS f, o.type AS ft, c.seq AS t, c.type AS tt, list_cosine_similarity(o.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM {ORPHANS} o JOIN {CONNECTED} c ON o.session_id = c.session_id"
    " AND len(o.embedding) = len(c.embedding) AND len(o.embedding) > 0 AND o.seq <> c.seq),"
    " h AS (SELECT session_id, f, ft, t, tt, score FROM s WHERE score >= 0.3 AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY f ORDER BY score DESC, t) = 1)"
    f" SELECT h.session_id, h.f AS from_seq, h.t AS to_seq, coalesce(r.r, s.r, 'relates-to') AS relation, round(h.score, 3) AS weight FROM h {_HEAL}"
)
def heal_orphans_vector(spark, root):
    return repair.heal_by_vector(_nodes(spark, root), _edges(spark, root), 0.3)


@query(
    f"WITH o AS (SELECT session_id, seq, type, unnest({_label_words('label', rules.STOP_HEAL)}) AS w FROM {ORPHANS}), c AS (SELECT session_id, seq, type, unnest({_label_words('label', rules.STOP_HEAL)}) AS w FROM {CONNECTED}),"
    " k AS (SELECT o.session_id, o.seq AS f, o.type AS ft, c.seq AS t, c.type AS tt, count(*) AS n FROM o JOIN c ON o.session_id = c.session_id AND o.w = c.w GROUP BY ALL),"
    " h AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, t) = 1)"
    f" SELECT h.session_id, h.f AS from_seq, h.t AS to_seq, coalesce(r.r, s.r, 'relates-to') AS relation, 0.5::DOUBLE AS weight FROM h {_HEAL}"
)
def heal_orphans_words(spark, root):
    return repair.heal_by_words(_nodes(spark, root), _edges(spark, root))


# --- views ------------------------------------------------------------------------------------------------------------


@query(f"SELECT seq, status FROM nodes WHERE status IN {_in(ACTIVE_NODES)}")
def active_nodes(spark, root):
    return views.active_nodes(_nodes(spark, root)).select("seq", "status")


@query("SELECT seq, label FROM nodes WHERE contains(lower(label), 'graph')")
def label_contains(spark, root):
    return views.label_contains(_nodes(spark, root), "graph").select("seq", "label")


@query("SELECT seq, label FROM nodes WHERE lower(label) IN (SELECT lower(label) FROM nodes WHERE seq = (SELECT min(seq) FROM nodes))")
def find_label(spark, root):
    n = _nodes(spark, root)
    label = n.agg(F.min_by("label", "seq").alias("l")).first()["l"]
    return views.find_by_label(n, label or "").select("seq", "label")


@query("SELECT seq, id FROM nodes WHERE starts_with(id, 'a')")
def id_prefix(spark, root):
    return views.by_id_prefix(_nodes(spark, root), "a").select("seq", "id")


@query("SELECT DISTINCT e.seq FROM edges e JOIN (SELECT DISTINCT session_id, id FROM nodes WHERE type = 'error' AND id IS NOT NULL) n ON e.session_id = n.session_id AND (e.from_id = n.id OR e.to_id = n.id)")
def edges_for_errors(spark, root):
    errors = _nodes(spark, root).where("type = 'error' and id is not null").select("session_id", "id")
    return views.edges_of(_edges(spark, root), errors).select("seq")


@query("SELECT seq, topic FROM nodes n WHERE topic = 'cache' OR NOT EXISTS (SELECT 1 FROM nodes m WHERE m.session_id = n.session_id AND m.topic = 'cache')")
def topic_filter(spark, root):
    return views.topic_filter(_nodes(spark, root), "cache").select("seq", "topic")


_SHOWN = "(SELECT DISTINCT session_id, id FROM nodes WHERE type IN ('task', 'error', 'file') AND status IN ('active', 'pending', 'blocked', 'done') AND id IS NOT NULL)"


@query(f"SELECT e.seq FROM edges e SEMI JOIN {_SHOWN} a ON e.session_id = a.session_id AND e.from_id = a.id SEMI JOIN {_SHOWN} b ON e.session_id = b.session_id AND e.to_id = b.id")
def view_filter(spark, root):
    return views.visible_graph(_nodes(spark, root), _edges(spark, root), ["task", "error", "file"], ["active", "pending", "blocked", "done"])[1].select("seq")


@query("SELECT session_id, type, seq, label FROM nodes WHERE status = 'deferred'")
def deferred(spark, root):
    return _nodes(spark, root).where("status = 'deferred'").select("session_id", "type", "seq", "label")


_SECTION = (
    "CASE WHEN status = 'conflicted' THEN 'conflicts' WHEN type = 'question' AND status = 'active' THEN 'questions'"
    f" WHEN type = 'error' AND status IN {_in(OPEN)} THEN 'errors' WHEN type = 'task' AND status IN ('pending', 'in_progress', 'blocked') THEN 'tasks'"
    " WHEN type = 'decision' AND status IN ('proposed', 'adopted') THEN 'decisions' END"
)


@query(f"SELECT seq, {_SECTION} AS section FROM nodes WHERE {_SECTION} IS NOT NULL")
def overview_sections(spark, root):
    return _nodes(spark, root).select("seq", views.section(F.col("type"), F.col("status")).alias("section")).where("section is not null")


_HIST = "list_filter(status_history, lambda h: h.status <> 'conflicted')"


@query(f"SELECT seq, ({_HIST})[-1].status AS keep_old, ({_HIST})[1].status AS keep_new FROM nodes WHERE status = 'conflicted'")
def conflict_keep(spark, root):
    h = F.col("status_history")
    return _nodes(spark, root).where("status = 'conflicted'").select("seq", views.kept_status(h, "old").alias("keep_old"), views.kept_status(h, "new").alias("keep_new"))


@query("SELECT seq, h.status AS status, epoch_us(h.ts) AS at, h.note AS note FROM (SELECT seq, unnest(CASE WHEN len(status_history) > 0 THEN status_history ELSE [NULL] END) AS h FROM nodes WHERE status = 'conflicted')")
def conflicts(spark, root):
    n = _nodes(spark, root).where("status = 'conflicted'").select("seq", F.explode_outer("status_history").alias("h"))
    return n.select("seq", "h.status", F.unix_micros("h.ts").alias("at"), "h.note")


@query(f"SELECT seq, {_case(rules.TERMINAL_BY_TYPE, 'type', chr(39) + 'resolved' + chr(39))} AS closed_as, {_case(rules.INITIAL_BY_TYPE, 'type', chr(39) + 'active' + chr(39))} AS opened_as FROM nodes")
def status_defaults(spark, root):
    return _nodes(spark, root).select("seq", views.terminal_status(F.col("type")).alias("closed_as"), views.initial_status(F.col("type")).alias("opened_as"))


@query(f"SELECT session_id, count(*) AS n_nodes FROM nodes WHERE NOT regexp_matches(session_id, {_q(views.SKIPPED_SESSIONS)}) GROUP BY session_id")
def live_sessions(spark, root):
    return views.live_sessions(_nodes(spark, root))


@query("SELECT session_id, CASE WHEN grouping(type) = 0 THEN 'type' ELSE 'status' END AS by, CASE WHEN grouping(type) = 0 THEN type ELSE status END AS value, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((session_id, type), (session_id, status))")
def status_counts(spark, root):
    return views.counts_by(_nodes(spark, root))


@query("SELECT DISTINCT session_id, topic FROM nodes WHERE topic IS NOT NULL")
def topics(spark, root):
    return _nodes(spark, root).where("topic is not null").select("session_id", "topic").distinct()


@query(
    f"SELECT session_id, count(*) FILTER (type = 'question' AND status IN {_in(DIGEST_ACTIVE)}) AS open_questions, count(*) FILTER (type = 'error' AND status NOT IN {_in(DIGEST_RESOLVED)}) AS open_errors,"
    f" count(*) FILTER (type = 'task' AND status IN {_in(DIGEST_ACTIVE)}) AS open_tasks, count(*) FILTER (type = 'decision' AND status IN ('adopted', 'proposed')) AS decisions,"
    f" count(*) FILTER (status IN {_in(DIGEST_RESOLVED)}) AS settled, count(*) FILTER (status = 'deferred') AS deferred FROM nodes GROUP BY session_id"
)
def digest_stats(spark, root):
    return views.digest_stats(_nodes(spark, root))


@query("WITH c AS (SELECT session_id, type, count(*) AS n, min(seq) AS f FROM nodes GROUP BY ALL) SELECT session_id, type, n FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) = 1")
def dominant_type(spark, root):
    return views.dominant_type(_nodes(spark, root), ["session_id"])


@query(f"WITH r AS (SELECT session_id, type, label, row_number() OVER (PARTITION BY session_id, type ORDER BY {SURE} DESC, seq) AS r FROM nodes) SELECT session_id, type, string_agg(label, ' / ' ORDER BY r) AS name FROM r WHERE r <= 3 GROUP BY session_id, type")
def group_label(spark, root):
    return views.group_label(_nodes(spark, root), ["session_id", "type"])


@query(
    "SELECT s.session_id, s.title, coalesce(n.n, 0) AS n_nodes, coalesce(e.n, 0) AS n_edges, epoch_us(n.u) AS last_change FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n, max(updated_at) AS u FROM nodes GROUP BY 1) n USING (session_id)"
    " LEFT JOIN (SELECT session_id, count(*) AS n FROM edges GROUP BY 1) e USING (session_id)"
)
def session_catalog(spark, root):
    c = views.session_catalog(_nodes(spark, root), _edges(spark, root), table(spark, root, "sessions"))
    return c.withColumn("last_change", F.unix_micros("last_change"))


@query(
    f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rank, count(*) OVER (PARTITION BY session_id) AS n FROM nodes WHERE status IN {_in(RESOLVED_SUMMARY)})"
    " SELECT session_id, rank, seq, greatest(0, n - 10) AS overflow FROM d WHERE rank <= 10"
)
def resolved_summary(spark, root):
    return views.resolved_summary(_nodes(spark, root)).select("session_id", "rank", "seq", "overflow")


@query("SELECT session_id, round(avg((relation = 'relates-to')::INT), 6) AS ratio, count(*) AS n FROM edges GROUP BY session_id")
def relates_ratio(spark, root):
    return _edges(spark, root).groupBy("session_id").agg(F.round(F.avg((F.col("relation") == "relates-to").cast("int")), 6).alias("ratio"), F.count(F.lit(1)).alias("n"))


@query("SELECT session_id, sum(length(coalesce(label, '')) + length(coalesce(summary, '')) + 65)::BIGINT + 100 AS chars FROM nodes GROUP BY session_id")
def size_estimate(spark, root):
    return _nodes(spark, root).groupBy("session_id").agg((F.sum(thread.size(F.col("label"), F.col("summary"))) + 100).alias("chars"))


_LAST = "(SELECT session_id, id, arg_max(status, seq) AS status, true AS here FROM {} WHERE id IS NOT NULL GROUP BY session_id, id)"


@query()
def graph_diff(spark, root):
    n = _nodes(spark, root)
    old, _ = _halves(spark, root)
    new = n.where(F.col("updated_at") >= F.lit("2026-01-01").cast("timestamp"))
    return views.diff(old, new)


SQL["graph_diff"] = (
    "WITH o AS (SELECT session_id, id, max(struct_pack(q := seq, s := status)).s AS status FROM " + OLD + " WHERE id IS NOT NULL GROUP BY ALL),"
    " n AS (SELECT session_id, id, max(struct_pack(q := seq, s := status)).s AS status FROM nodes WHERE updated_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND id IS NOT NULL GROUP BY ALL),"
    " j AS (SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.status IS DISTINCT FROM n.status THEN 'status' END AS change,"
    " o.status AS old_status, n.status AS new_status FROM o FULL JOIN n ON o.session_id = n.session_id AND o.id = n.id) SELECT * FROM j WHERE change IS NOT NULL"
)


_URGENT = "(SELECT DISTINCT session_id, id FROM nodes WHERE type IN ('error', 'task') AND status NOT IN ('fixed', 'done', 'deferred') AND id IS NOT NULL)"


@query(
    f"SELECT session_id, id FROM {_URGENT} UNION SELECT e.session_id, e.to_id FROM edges e JOIN {_URGENT} u ON e.session_id = u.session_id AND e.from_id = u.id WHERE e.to_id IS NOT NULL"
    f" UNION SELECT e.session_id, e.from_id FROM edges e JOIN {_URGENT} u ON e.session_id = u.session_id AND e.to_id = u.id WHERE e.from_id IS NOT NULL"
)
def high_priority(spark, root):
    return views.high_priority(_nodes(spark, root), _edges(spark, root))


@query("SELECT session_id, id, max(seq) AS seq FROM nodes WHERE id IS NOT NULL GROUP BY session_id, id")
def upsert_latest(spark, root):
    from skein.store import upsert

    old, new = _halves(spark, root)
    return upsert(old, new).select("session_id", "id", "seq")


@query("SELECT e.seq FROM edges e ANTI JOIN (SELECT DISTINCT session_id, id FROM nodes WHERE status = 'cancelled') d ON e.session_id = d.session_id AND e.from_id = d.id ANTI JOIN (SELECT DISTINCT session_id, id FROM nodes WHERE status = 'cancelled') f ON e.session_id = f.session_id AND e.to_id = f.id")
def cascade_delete(spark, root):
    from skein.store import delete_nodes

    gone = _nodes(spark, root).where("status = 'cancelled'").select("session_id", "id")
    return delete_nodes(_nodes(spark, root), _edges(spark, root), gone)[1].select("seq")


@query()
def export_json(spark, root):
    from skein.store import export_json as export

    return export(_nodes(spark, root), _edges(spark, root))


_SHOW = lambda c: f"round(coalesce(CASE WHEN NOT isnan({c}) THEN {c} END, 1.0), 6) AS {c}"


@query(f"SELECT session_id, seq, id, label, type, status, coalesce(summary, '') AS summary, {_SHOW('confidence')} FROM nodes WHERE id IS NOT NULL")
def viewer_graph(spark, root):
    from skein.store import viewer_nodes

    return viewer_nodes(_nodes(spark, root))


@query(f"SELECT session_id, seq, id, from_id, to_id, relation, {_SHOW('weight')} FROM edges")
def viewer_edges(spark, root):
    from skein.store import viewer_edges as shown

    return shown(_edges(spark, root))


@query(
    "SELECT session_id, count(*) AS n_nodes, count(*) FILTER (status = 'unconfirmed') AS unconfirmed, count(*) FILTER (status = 'conflicted') AS conflicted,"
    " count(*) FILTER (subtype = 'test_failure') AS test_failures, count(*) FILTER (subtype = 'endpoint') AS endpoints FROM nodes GROUP BY session_id"
)
def attention_counts(spark, root):
    return views.attention_counts(_nodes(spark, root))


_CLOSED = _case(rules.TERMINAL_BY_TYPE, "type", "'resolved'")


@query(f"SELECT seq, CASE WHEN status = 'deferred' THEN {_CLOSED} ELSE status END AS status, coalesce(len(status_history), 0) + coalesce((status = 'deferred')::INT, 0) AS n_history FROM nodes")
def close_deferred(spark, root):
    n = views.set_status(_nodes(spark, root), F.col("status") == "deferred", views.terminal_status(F.col("type")), "closed", "2026-07-01")
    return n.select("seq", "status", F.coalesce(F.size("status_history"), F.lit(0)).alias("n_history"))


@query("SELECT DISTINCT session_id, least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL")
def linked_pairs(spark, root):
    return views.linked_pairs(_edges(spark, root))


@query(
    f"WITH o AS (SELECT DISTINCT session_id, id FROM {OLD} WHERE id IS NOT NULL), n AS (SELECT DISTINCT session_id, id FROM {NEW} WHERE id IS NOT NULL)"
    " SELECT *, 'both' AS side FROM (SELECT * FROM o INTERSECT SELECT * FROM n) UNION ALL SELECT *, 'old' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'new' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)"
)
def id_changes(spark, root):
    return views.id_changes(*_halves(spark, root))


# --- ranks ------------------------------------------------------------------------------------------------------------

_ASKED = "['graph', 'cache', 'parser']"
_OWN = "list_distinct(regexp_extract_all(lower(coalesce(label, '') || ' ' || coalesce(summary, '')), '[a-z0-9]+'))"


@query(
    f"WITH t AS (SELECT session_id, seq, confidence, {_OWN} AS w FROM nodes), s AS (SELECT session_id, seq, round(len(list_intersect(w, {_ASKED}))::DOUBLE / len(list_distinct(list_concat(w, {_ASKED}))) * confidence, 6) AS score FROM t),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq) AS rank FROM s WHERE score > 0 AND NOT isnan(score)) SELECT session_id, seq, score, rank FROM r WHERE rank <= 5"
)
def search_topk(spark, root):
    return graph.search(_nodes(spark, root), "graph cache parser").drop("id")


@query(f"WITH r AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY {SURE} DESC, seq) AS rank FROM nodes) SELECT * FROM r WHERE rank <= 5")
def seed_topk(spark, root):
    return graph.top_confidence(_nodes(spark, root)).drop("id")


_CAPS = thread.caps(1200)
_CAP = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CAPS.items()) + " ELSE 2147483647 END"
_RANK = (
    "ORDER BY CASE WHEN section = 'tasks' THEN CASE status WHEN 'in_progress' THEN 0 WHEN 'blocked' THEN 1 ELSE 2 END ELSE 0 END,"
    " CASE WHEN section IN ('open_questions', 'errors') THEN coalesce(CASE WHEN isnan(confidence) THEN -1 ELSE confidence END, -1) ELSE 0 END DESC, CASE WHEN section = 'tasks' THEN epoch_us(created_at) ELSE 0 END DESC"
)
_WHICH = (
    "unnest(list_filter([CASE WHEN type = 'question' AND status IN ('active', 'deferred') THEN 'open_questions' END, CASE WHEN type = 'error' AND status NOT IN ('fixed', 'resolved') THEN 'errors' END,"
    " CASE WHEN type = 'decision' AND status IN ('proposed', 'adopted') THEN 'decisions' END, CASE WHEN type = 'task' AND status IN ('pending', 'in_progress', 'blocked') THEN 'tasks' END,"
    " CASE WHEN type IN ('skill', 'concept') AND status = 'active' THEN 'context' END, CASE WHEN type = 'file' THEN 'files' END, CASE WHEN status = 'conflicted' THEN 'conflicts' END], lambda x: x IS NOT NULL)) AS section"
)


@query(
    f"WITH s AS (SELECT *, {_WHICH} FROM nodes WHERE status IN {_in(ACTIVE_THREAD)}), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, section {_RANK}, seq) AS rank, count(*) OVER (PARTITION BY session_id, section) AS n FROM s)"
    f" SELECT session_id, section, rank, seq, greatest(0, n - {_CAP}) AS overflow FROM r WHERE rank <= {_CAP}"
)
def section_caps(spark, root):
    shown = thread.sections(_nodes(spark, root).where(F.col("status").isin(ACTIVE_THREAD)).withColumn("_order", F.col("seq")))
    return thread.ranked(shown).select("session_id", "section", "rank", "seq", "overflow")


@query(
    f"""WITH f AS (SELECT session_id, count(*) AS n, count(*) FILTER (status IN {_in(ACTIVE_THREAD)}) AS a, count(*) FILTER (type = 'task' AND status = 'pending') AS p FROM nodes GROUP BY 1),
    o AS (SELECT n.seq, row_number() OVER (PARTITION BY n.session_id ORDER BY created_at, seq) AS r, greatest(1, p // 2) AS h FROM nodes n JOIN f USING (session_id) WHERE type = 'task' AND status = 'pending' AND f.n >= 30 AND a > 50)
    SELECT seq, CASE WHEN seq IN (SELECT seq FROM o WHERE r <= h) THEN 'deferred' ELSE status END AS status FROM nodes"""
)
def stale_demotion(spark, root):
    return thread.demote_stale(_nodes(spark, root)).select("seq", "status")


@query(
    f"""WITH RECURSIVE a AS (SELECT *, length(coalesce(label, '')) + length(coalesce(summary, '')) + 65 AS size FROM nodes WHERE status IN {_in(ACTIVE_THREAD)}),
    u AS (SELECT DISTINCT session_id, id FROM a WHERE type IN ('error', 'task') AND status NOT IN ('fixed', 'done', 'deferred') AND id IS NOT NULL),
    t AS (SELECT session_id, id FROM u UNION SELECT e.session_id, e.to_id FROM edges e JOIN u ON e.session_id = u.session_id AND e.from_id = u.id UNION SELECT e.session_id, e.from_id FROM edges e JOIN u ON e.session_id = u.session_id AND e.to_id = u.id),
    p AS (SELECT a.session_id, a.seq, a.size, CASE WHEN status = 'deferred' THEN 0 WHEN type IN ('concept', 'skill') AND confidence < 0.5 THEN 1 WHEN type IN ('concept', 'skill') AND confidence < 0.7 THEN 2 WHEN type IN ('concept', 'skill') THEN 3
     WHEN type = 'decision' AND status = 'adopted' THEN 4 WHEN type = 'file' AND t.id IS NULL THEN 5 ELSE 10 END AS pr FROM a LEFT JOIN t ON a.session_id = t.session_id AND a.id = t.id),
    tot AS (SELECT session_id, sum(size) + 100 AS total, sum(CASE WHEN pr = 10 THEN size ELSE 0 END) + 100 AS kept FROM p GROUP BY 1),
    o AS (SELECT p.*, row_number() OVER (PARTITION BY session_id ORDER BY pr DESC, seq) AS k FROM p WHERE pr < 10),
    w AS (SELECT session_id, 0::BIGINT AS k, kept::BIGINT AS used, NULL::BIGINT AS seq, false AS ok FROM tot
     UNION ALL SELECT o.session_id, o.k, CASE WHEN w.used + o.size <= 4800 THEN w.used + o.size ELSE w.used END, o.seq, w.used + o.size <= 4800 FROM w JOIN o ON o.session_id = w.session_id AND o.k = w.k + 1)
    SELECT p.session_id, p.seq FROM p JOIN tot USING (session_id) WHERE total <= 4800 OR pr = 10 OR p.seq IN (SELECT seq FROM w WHERE ok)"""
)
def budget_fill(spark, root):
    a = _nodes(spark, root).where(F.col("status").isin(ACTIVE_THREAD))
    return thread.fit_budget(a, _edges(spark, root)).select("session_id", "seq")


_TYPES = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(NODE_TYPES)) + " ELSE 99 END"
_STATUSES = "CASE status " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(NODE_STATUSES)) + " ELSE 99 END"


@query(f"SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY {_TYPES}, {_STATUSES}, seq) AS place, seq FROM nodes")
def grid_sort(spark, root):
    return reports.grid(_nodes(spark, root))


# --- graph ------------------------------------------------------------------------------------------------------------


@query(f"SELECT session_id, from_id AS src, to_id AS dst, max(struct_pack(q := seq, r := relation)).r AS relation FROM {REAL} GROUP BY ALL")
def collapse_parallel(spark, root):
    return graph.build(_nodes(spark, root), _edges(spark, root)).select("session_id", "src", "dst", "relation")


@query(f"SELECT e.session_id, e.id, count(*) AS n_edges FROM (SELECT session_id, from_id AS id FROM edges UNION ALL SELECT session_id, to_id FROM edges) e SEMI JOIN {IDS} n ON e.session_id = n.session_id AND e.id = n.id GROUP BY ALL")
def node_degree(spark, root):
    return graph.degrees(_nodes(spark, root), _edges(spark, root))


@query(f"SELECT seq, session_id FROM {ORPHANS}")
def orphans(spark, root):
    return merge.orphans(_nodes(spark, root), _edges(spark, root)).select("seq", "session_id")


_SEEDS = f"(SELECT DISTINCT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY {SURE} DESC, seq) AS r FROM nodes) WHERE r <= 5 AND id IS NOT NULL)"


@query(
    f"WITH s AS (SELECT session_id, id, 0 AS hop FROM {_SEEDS}), l AS (SELECT * FROM {LINKS}), h1 AS (SELECT DISTINCT l.session_id, l.b AS id FROM l JOIN s ON l.session_id = s.session_id AND l.a = s.id), h2 AS (SELECT DISTINCT l.session_id, l.b AS id FROM l JOIN h1 ON l.session_id = h1.session_id AND l.a = h1.id)"
    " SELECT session_id, id, min(hop)::INT AS hop FROM (SELECT * FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL"
)
def neighbourhood(spark, root):
    n = _nodes(spark, root)
    seeds = graph.top_confidence(n).where("id is not null").select("session_id", "id").distinct()
    return graph.neighbourhood(n, _edges(spark, root), seeds, 2)


_ENDS2 = "(SELECT session_id, arg_min(id, seq) AS s, arg_max(id, seq) AS t FROM nodes WHERE id IS NOT NULL GROUP BY session_id)"


@query(
    f"WITH RECURSIVE l AS MATERIALIZED (SELECT * FROM {LINKS}), m AS MATERIALIZED (SELECT max(n) AS n FROM (SELECT count(DISTINCT id) AS n FROM nodes GROUP BY session_id)), e AS (SELECT * FROM {_ENDS2}), r AS (SELECT session_id, s AS id, 0 AS d FROM e UNION SELECT l.session_id, l.b, r.d + 1 FROM r JOIN l ON l.session_id = r.session_id AND l.a = r.id WHERE r.d < (SELECT n FROM m))"
    " SELECT e.session_id, e.s AS source, e.t AS target, min(r.d)::INT AS hops FROM e LEFT JOIN r ON e.session_id = r.session_id AND e.t = r.id GROUP BY ALL"
)
def shortest_path(spark, root):
    n = _nodes(spark, root)
    p = n.where("id is not null").groupBy("session_id").agg(F.min_by("id", "seq").alias("source"), F.max_by("id", "seq").alias("target"))
    return graph.shortest_paths(n, _edges(spark, root), p).drop("path")


@query()
def communities(spark, root):
    return graph.communities(_nodes(spark, root), _edges(spark, root))


@query()
def cluster_top(spark, root):
    n, e = _nodes(spark, root), _edges(spark, root)
    return reports.clusters(n, graph.communities(n, e))


_FOUND = f"(SELECT DISTINCT n.session_id, n.id FROM ({SQL['search_topk']}) s JOIN nodes n USING (seq) WHERE n.id IS NOT NULL)"
_FOCUS = (
    f"(WITH s AS (SELECT f.session_id, f.id FROM {_FOUND} f SEMI JOIN {IDS} i ON f.session_id = i.session_id AND f.id = i.id), h AS (SELECT session_id, id, min(hop)::INT AS hop FROM (SELECT *, 0 AS hop FROM s"
    f" UNION ALL SELECT l.session_id, l.b, 1 FROM {LINKS} l JOIN s ON l.session_id = s.session_id AND l.a = s.id) GROUP BY ALL)"
    " SELECT n.session_id, n.seq, n.id, n.type, n.status, n.label, h.hop FROM nodes n JOIN h ON n.session_id = h.session_id AND n.id = h.id QUALIFY row_number() OVER (PARTITION BY n.session_id ORDER BY hop, n.seq) <= 15)"
)


@query(f"SELECT * FROM {_FOCUS}")
def focus(spark, root):
    return reports.focus(_nodes(spark, root), _edges(spark, root), "graph cache parser")[0]


@query(
    f"WITH m AS MATERIALIZED (SELECT DISTINCT session_id, id FROM {_FOCUS}), r AS (SELECT e.session_id, e.from_id, e.to_id, e.relation, row_number() OVER (PARTITION BY e.session_id ORDER BY e.seq)::INT AS rank FROM edges e"
    " SEMI JOIN m a ON e.session_id = a.session_id AND e.from_id = a.id SEMI JOIN m b ON e.session_id = b.session_id AND e.to_id = b.id) SELECT * FROM r WHERE rank <= 20"
)
def focus_relationships(spark, root):
    return reports.focus(_nodes(spark, root), _edges(spark, root), "graph cache parser")[1]


def _thread_sql() -> str:
    view = f"SELECT n.* REPLACE (d.status AS status) FROM nodes n JOIN ({SQL['stale_demotion']}) d USING (seq)"
    own = lambda q: q.replace("FROM nodes WHERE", "FROM v WHERE")
    fits = own(SQL["budget_fill"]).replace("SELECT p.session_id, p.seq FROM p JOIN tot", "SELECT p.seq, CASE WHEN total <= 4800 THEN 0 ELSE -p.pr END AS o FROM p JOIN tot")
    text = "coalesce(label, '') || CASE WHEN section = 'files' THEN '' ELSE ': ' || coalesce(summary, '') END"
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{sign}', '{name}')"
    label = text.replace("coalesce(label, '') || CASE WHEN section = 'files' THEN '' ELSE ': ' || coalesce(summary, '') END", "coalesce(label, '')")
    return (
        f"WITH v AS MATERIALIZED ({view}), b AS ({fits}), s AS (SELECT v.*, b.o, {_WHICH} FROM v JOIN b USING (seq)),"
        f" r AS (SELECT *, row_number() OVER (PARTITION BY session_id, section {_RANK}, o, seq) AS rank, count(*) OVER (PARTITION BY session_id, section) AS n FROM s)"
        f" SELECT session_id, section, rank, seq, type, status, {text} AS text, greatest(0, n - {_CAP}) AS overflow FROM r WHERE rank <= {_CAP}"
        f" UNION ALL SELECT d.session_id, 'resolved_this_session', d.rank, d.seq, v.type, v.status, {label}, d.overflow FROM ({own(SQL['resolved_summary'])}) d JOIN v USING (seq)"
    )


@query(_thread_sql())
def active_thread(spark, root):
    return thread.active_thread(_nodes(spark, root), _edges(spark, root))


@query()
def active_thread_xml(spark, root):
    return thread.render(thread.active_thread(_nodes(spark, root), _edges(spark, root)))


@query()
def active_thread_text(spark, root):
    t = thread.render(thread.active_thread(_nodes(spark, root), _edges(spark, root)))
    return t.select("session_id", T.strip_tags(F.col("xml")).alias("text"))


@query()
def digest(spark, root):
    d = reports.digest(_nodes(spark, root), _edges(spark, root))
    return d.select("session_id", "part", F.array_join("place", "/").alias("place"), "seq", "line")


_LABEL = "coalesce(label, '')"
_SAYS = lambda sign: f"CASE WHEN coalesce(summary, '') <> '' THEN '{sign}' || summary ELSE '' END"


@query(
    f"SELECT session_id, 3 AS part, seq, '- [ ] ' || {_case(rules.ICONS, 'type', chr(39) + '•' + chr(39))} || ' **' || {_LABEL} || '**' || {_SAYS(' — ')} AS line FROM nodes WHERE status = 'deferred'"
    f" UNION ALL SELECT session_id, 4, seq, '- ❓ **' || {_LABEL} || '**' || {_SAYS(': ')} FROM nodes WHERE type = 'question' AND status IN {_in(DIGEST_ACTIVE)}"
)
def digest_open_ends(spark, root):
    return reports.open_ends(_nodes(spark, root))


@query()
def community_modularity(spark, root):
    n, e = _nodes(spark, root), _edges(spark, root)
    return graph.modularity(n, e, graph.communities(n, e)).withColumn("modularity", F.round("modularity", 6))


# --- turns ------------------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT sessionid, line_no, row_id, type, coalesce(content, '') AS c FROM copilot_session WHERE sessionid IS NOT NULL AND line_no IS NOT NULL AND type IN ('user.message', 'assistant.message')),
    g AS (SELECT *, sum((type = 'user.message')::INT) OVER (PARTITION BY sessionid ORDER BY line_no, row_id ROWS UNBOUNDED PRECEDING) AS g, row_number() OVER (PARTITION BY sessionid ORDER BY line_no, row_id) AS k FROM r),
    t AS (SELECT sessionid, g, coalesce(max(CASE WHEN type = 'user.message' THEN c END), '') AS u, coalesce(arg_max(c, k) FILTER (type = 'assistant.message' AND c <> ''), '') AS a FROM g GROUP BY ALL)
    SELECT sessionid AS session_id, (row_number() OVER (PARTITION BY sessionid ORDER BY g))::INT AS turn_number, u AS role_user, a AS role_assistant FROM t WHERE u <> '' OR a <> ''"""
)
def transcript_turns(spark, root):
    return turns.transcript_turns(table(spark, root, "copilot_session")).drop("ts")


@query(f"SELECT type, count(*) AS n FROM copilot_session WHERE coalesce(type, '') NOT IN {_in(turns.KNOWN_EVENTS)} GROUP BY type")
def unknown_events(spark, root):
    return turns.unknown_events(table(spark, root, "copilot_session"))


@query(
    f"""WITH m AS (SELECT conv_uuid, load_ts, row_id, lower(trim(sender)) AS r, {_strip("coalesce(text, '')")} AS t FROM claude_export WHERE conv_uuid IS NOT NULL),
    n AS (SELECT *, lead(r) OVER w AS nr, lead(t) OVER w AS nt FROM m WINDOW w AS (PARTITION BY conv_uuid ORDER BY row_id))
    SELECT conv_uuid, (row_number() OVER (PARTITION BY conv_uuid ORDER BY row_id))::INT AS turn_number, t AS role_user, nt AS role_assistant FROM n WHERE r = 'human' AND nr = 'assistant'"""
)
def chat_pairs(spark, root):
    m = table(spark, root, "claude_export").where("conv_uuid is not null").withColumn("_role", F.lower(F.trim("sender")))
    return turns.message_pairs(m, "conv_uuid", "row_id", "_role", "text", user="human")


_PACKED = (
    "list_reduce(list_prepend([''], list_transform(regexp_split_to_array(a, '\\n{2,}'), lambda x: [x])), lambda l, x: CASE WHEN length(l[-1]) + length(x[1]) > 6000 AND l[-1] <> '' THEN list_append(l, x[1])"
    f" ELSE list_append(list_slice(l, 1, len(l) - 1), {_strip('l[-1] || chr(10) || chr(10) || x[1]')}) END)"
)


@query(
    f"WITH t AS (SELECT session_id, turn_number, role_user AS u, role_assistant AS a FROM ({SQL['transcript_turns']})),"
    f" c AS (SELECT session_id, turn_number, CASE WHEN length(u) + length(a) > 6000 THEN {_PACKED} ELSE [a] END AS c, length(u) + length(a) > 6000 AS big FROM t),"
    f" x AS (SELECT session_id, turn_number, unnest(CASE WHEN big THEN list_filter(list_transform(c, lambda x, i: CASE WHEN i < len(c) THEN {_strip('x')} ELSE x END), lambda x, i: i < len(c) OR x <> '') ELSE c END) AS chunk,"
    f" generate_subscripts(CASE WHEN big THEN list_filter(c, lambda x, i: i < len(c) OR x <> '') ELSE c END, 1)::INT AS chunk_no FROM c)"
    " SELECT session_id, turn_number, chunk_no, chunk FROM x"
)
def turn_chunks(spark, root):
    t = turns.transcript_turns(table(spark, root, "copilot_session"))
    c = t.select("session_id", "turn_number", F.posexplode(T.turn_chunks(F.col("role_user"), F.col("role_assistant"))).alias("n", "chunk"))
    return c.select("session_id", "turn_number", (F.col("n") + 1).alias("chunk_no"), "chunk")


@query()
def delimited_turns(spark, root):
    return turns.delimited_turns(table(spark, root, "documents").where("text is not null"), "doc_id", "text")


@query(f"SELECT session_id, turn_number, CASE WHEN turn_number % 5 = 0 THEN 'second' ELSE 'first' END AS backend FROM ({SQL['transcript_turns']})")
def hybrid_route(spark, root):
    from skein.streaming.turns import route

    t = turns.transcript_turns(table(spark, root, "copilot_session"))
    return route(t, every=5).select("session_id", "turn_number", "backend")


# --- the whole way ----------------------------------------------------------------------------------------------------


def _extracted(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    from skein.plans import pipeline

    t = turns.transcript_turns(table(spark, root, "copilot_session"))
    return pipeline.candidates(t.withColumn("ts", T.iso_time(F.col("ts"))))


@query()
def extract_candidates(spark, root):
    return _extracted(spark, root)[0].select("session_id", "id", "type", "label", "status", F.round("confidence", 3).alias("confidence"))


def _ingested(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of all transcripts, in the order of their turns, merged into the stored graph and repaired. Nodes without an
    embedding get the word embedder's."""
    from skein.plans import pipeline

    new_nodes, new_edges = _numbered(*_extracted(spark, root))
    nodes, edges = pipeline.merge_batch(_nodes(spark, root), _edges(spark, root), new_nodes, new_edges, at="2026-07-01", embedder=pipeline.word_embedder)
    return pipeline.repair_all(nodes, edges, at="2026-07-01")


def _numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    from skein.session import cut

    nodes = nodes.orderBy("session_id", "_order", "id").withColumn("seq", F.lit(2**40) + F.monotonically_increasing_id())
    return cut(nodes.drop("_order", "batch"), "candidates"), edges


@query()
def ingest(spark, root):
    """The edges of the graph after an ingest."""
    return _ingested(spark, root)[1]


@query()
def ingest_nodes(spark, root):
    """The nodes of the graph after an ingest."""
    n = _ingested(spark, root)[0]
    return n.select("session_id", "id", "type", "label", "status", "summary", F.round("confidence", 3).alias("confidence"), F.size(F.coalesce("status_history", F.array())).alias("n_history"))


_ROW = "max(struct_pack(c := created_at, s := seq))"


@query(
    f"WITH o AS (SELECT session_id, type, lower(label) AS l, arg_max(seq, struct_pack(c := created_at, s := seq)) AS target FROM {OLD} WHERE label IS NOT NULL GROUP BY ALL),"
    f" n AS (SELECT n.*, o.target FROM {NEW} n LEFT JOIN o ON n.session_id = o.session_id AND n.type = o.type AND lower(n.label) = o.l),"
    " f AS (SELECT seq, target, coalesce(target, CASE WHEN session_id IS NOT NULL AND type IS NOT NULL AND label IS NOT NULL THEN first_value(seq) OVER (PARTITION BY session_id, type, lower(label), target IS NULL ORDER BY seq) ELSE seq END) AS stays FROM n)"
    " SELECT seq, stays FROM f"
)
def batch_fold(spark, root):
    """The node each incoming one ends in by exact labels: a stored one, the first of its batch, or itself."""
    old, new = _halves(spark, root)
    m = merge.exact_dedup(old, new).select("seq", "target_seq")
    own = new.select("seq", "session_id", "type", F.lower("label").alias("l")).join(m, "seq")
    firsts = own.where("target_seq is null and session_id is not null and type is not null and l is not null").groupBy("session_id", "type", "l").agg(F.min("seq").alias("first"))
    own = own.join(firsts, ["session_id", "type", "l"], "left")
    return own.select("seq", F.coalesce("target_seq", "first", "seq").alias("stays"))
