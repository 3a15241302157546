"""The queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import conversations as conv
from skein.llm import mixing, neardup, packing, pii, representative, sentences, splitting
from skein.session import table


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return splitting.message_texts(table(spark, root, "copilot_session"), table(spark, root, "claude_export"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return pii.mentions(_messages(spark, root)).select("src", "row_id", "kind", "start_at")


def p1_masked(spark: SparkSession, root: str) -> DataFrame:
    texts = _messages(spark, root)
    return pii.masked(texts, pii.mentions(texts))


def p1_labelers(spark: SparkSession, root: str) -> DataFrame:
    return pii.reliabilities(_messages(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return representative.field_origins(representative.survivors(table(spark, root, "nodes")))


def p2_survivors(spark: SparkSession, root: str) -> DataFrame:
    return representative.survivors(table(spark, root, "nodes"))


def p2_consensus(spark: SparkSession, root: str) -> DataFrame:
    return representative.consensus_text(table(spark, root, "nodes"))


def p2_agreement(spark: SparkSession, root: str) -> DataFrame:
    return representative.agreement(table(spark, root, "nodes"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    kept = conv.conversations(table(spark, root, "copilot_session"), table(spark, root, "claude_export"))
    return kept.select("src", "conv_key", "msg_no", "row_id")


def p3_fragments(spark: SparkSession, root: str) -> DataFrame:
    return conv.delivery_report(table(spark, root, "copilot_session"), table(spark, root, "claude_export"))


def _oversized(spark: SparkSession, root: str) -> DataFrame:
    return splitting.oversized(_messages(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.blocks_of(_oversized(spark, root))


def p4_cover(spark: SparkSession, root: str) -> DataFrame:
    """Every oversized text's characters, put together again from its pieces, and the pieces over the limit."""
    p = p4_pieces(spark, root)
    first = F.min("start_at")
    return p.groupBy("src", "row_id").agg(
        (F.sum(F.col("end_at") - F.col("start_at")) - 200 * (F.count(F.lit(1)) - 1)).alias("chars"), first.alias("begins"), F.max("end_at").alias("ends"), F.count_if(F.col("end_at") - F.col("start_at") > 6000).alias("over")
    )


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.pieces_of(_oversized(spark, root))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_pairs(table(spark, root, "nodes"))


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_groups(table(spark, root, "nodes"))


def p5_members(spark: SparkSession, root: str) -> DataFrame:
    """Every record's group."""
    return p5_groups(spark, root).select("seq", "group_seq")


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents")).where("n_pieces > 1 and piece_no = 0").select("doc_id")


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, root, "documents")))


def p6_sound(spark: SparkSession, root: str) -> DataFrame:
    return packing.soundness(packing.pack(table(spark, root, "documents"))).select("items", "tokens", "over", (F.col("containers") >= F.col("least")).alias("enough"), (F.col("containers") <= F.col("least") * 1.1 + 1).alias("tight"))


def p6_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Every document's tokens, put together again from its pieces."""
    packed = packing.pack(table(spark, root, "documents"))
    return packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 4096).alias("over"), F.min("piece_start").alias("begins"))


def p7_plan(spark: SparkSession, root: str) -> DataFrame:
    """What each source has and may give, and whether that is too little."""
    return p7_shares(spark, root).select("source", "target_share", "max_repeat", "source_tokens", "available", "unreachable")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_shares(spark, root).where("unreachable").select("source")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_masked, p1_labelers, p2_found, p2_survivors, p2_consensus, p2_agreement, p3_found, p3_fragments, p4_found, p4_pieces, p4_cover, p5_found, p5_groups, p5_members, p6_found, p6_packed, p6_fill, p6_sound, p6_sizes, p7_found, p7_plan, p7_shares, p7_mix, p8_found)
}

_INVISIBLE = r"\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}"
_ROLE = (
    "CASE WHEN regexp_replace(lower({0}), '[^a-z]', '', 'g') IN ('user', 'human', 'usermessage', 'humanmessage') THEN 'user'"
    " WHEN regexp_replace(lower({0}), '[^a-z]', '', 'g') IN ('assistant', 'ai', 'assistantmessage', 'aimessage') THEN 'assistant' END"
)
_AT = (
    r"CASE WHEN regexp_full_match(trim(created_at), '\d{1,15}') THEN trim(created_at)::BIGINT * 1000"
    r" WHEN regexp_matches(trim(created_at), '^\d{4}-\d{2}-\d{2}[T ]\d') THEN epoch_us(TRY_CAST(trim(created_at) ||"
    r" CASE WHEN regexp_matches(trim(created_at), '(?i)(z|utc|[+-]\d{2}:?\d{2})$') THEN '' ELSE 'Z' END AS TIMESTAMPTZ)) END"
)
_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce(label, '') || ' ' || coalesce(summary, '')), '[\p{L}\p{N}]+'))"
_SOURCE = r"lower(regexp_replace({0}, '^[\t\n\x0b\f\r\x{{85}}\p{{Z}}]+|[\t\n\x0b\f\r\x{{85}}\p{{Z}}]+$', '', 'g'))"

SQL: dict[str, str] = {
    "p3_found": f"""
        WITH m AS (SELECT 'copilot_session' AS src, sessionid AS conv_key, messageid AS mid, {_ROLE.format("type")} AS role, line_no AS pos, load_ts, row_id, content AS t FROM copilot_session
          UNION ALL SELECT 'claude_export', conv_uuid, uuid, {_ROLE.format("sender")}, {_AT}, load_ts, row_id, text FROM claude_export),
        d AS (SELECT * FROM m WHERE role IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY src, CASE WHEN trim(mid) <> '' THEN 'm' || mid ELSE 'r' || row_id END ORDER BY load_ts NULLS LAST, row_id) = 1),
        s AS (SELECT * FROM d WHERE trim(conv_key) <> '' AND regexp_matches(t, '[^{_INVISIBLE}]')),
        n AS (SELECT *, row_number() OVER w AS msg_no, lead(role) OVER w AS next FROM s WINDOW w AS (PARTITION BY src, conv_key ORDER BY pos, row_id)),
        bad AS (SELECT DISTINCT src, conv_key FROM n WHERE pos IS NULL OR (msg_no = 1 AND role <> 'user') OR (role = 'user' AND next IS DISTINCT FROM 'assistant'))
        SELECT n.src, n.conv_key, n.msg_no, n.row_id FROM n ANTI JOIN bad ON n.src = bad.src AND n.conv_key = bad.conv_key""",
    "p5_found": f"""
        WITH w AS (SELECT seq, {_WORDS} AS w FROM nodes WHERE seq IS NOT NULL), k AS (SELECT seq, len(w) AS n, unnest(w) AS x FROM w WHERE len(w) >= 10),
        j AS (SELECT a.seq AS a, b.seq AS b, a.n AS na, b.n AS nb, count(*) AS s FROM k a JOIN k b ON a.x = b.x AND a.seq < b.seq GROUP BY ALL),
        v AS (SELECT seq, embedding::DOUBLE[] AS e, len(embedding) AS d FROM nodes WHERE len(embedding) > 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)
        SELECT a AS seq_a, b AS seq_b FROM j WHERE s::DOUBLE / (na + nb - s) >= 0.6
        UNION SELECT a.seq, b.seq FROM v a JOIN v b ON a.d = b.d AND a.seq < b.seq AND list_cosine_similarity(a.e, b.e) >= 0.9""",
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
    "p7_found": f"""
        WITH d AS (SELECT {_SOURCE.format("source")} AS s, sum(strlen(text)) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT sum(size) AS total FROM d)
        SELECT t.source FROM mix_targets t CROSS JOIN b LEFT JOIN d ON d.s = {_SOURCE.format("t.source")} WHERE coalesce(d.size, 0) * t.max_repeat < t.target_share * b.total""",
}

_LONG = "(SELECT 'copilot_session' AS src, row_id, content AS t FROM copilot_session UNION ALL SELECT 'claude_export', row_id, text FROM claude_export)"
_DRAWN = f"(SELECT {_SOURCE.format('source')} AS s, sum(strlen(text)) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1)"
SQL |= {
    "p4_cover": f"SELECT src, row_id, length(t) AS chars, 0 AS begins, length(t) AS ends, 0 AS over FROM {_LONG} WHERE length(t) > 6000",
    "p5_members": f"""
        WITH RECURSIVE p AS MATERIALIZED ({SQL["p5_found"]}), l AS MATERIALIZED (SELECT seq_a AS a, seq_b AS b FROM p UNION SELECT seq_b, seq_a FROM p),
        r AS (SELECT seq AS a, seq AS b FROM nodes WHERE seq IS NOT NULL UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT a AS seq, min(b) AS group_seq FROM r GROUP BY a""",
    "p6_sound": "SELECT sum(greatest(1, ceil(strlen(text) / 4096)))::BIGINT AS items, sum(strlen(text))::BIGINT AS tokens, 0 AS over, true AS enough, true AS tight FROM documents WHERE strlen(text) > 0",
    "p6_sizes": "SELECT doc_id, coalesce(strlen(text), 0) AS tokens, 0 AS over, 0 AS begins FROM documents",
    "p7_plan": f"""
        WITH d AS (SELECT * FROM {_DRAWN}), b AS (SELECT sum(size) AS total FROM d)
        SELECT t.source, t.target_share, t.max_repeat::BIGINT AS max_repeat, coalesce(d.size, 0)::BIGINT AS source_tokens, (coalesce(d.size, 0) * t.max_repeat)::BIGINT AS available, coalesce(d.size, 0) * t.max_repeat < t.target_share * b.total AS unreachable
        FROM mix_targets t CROSS JOIN b LEFT JOIN d ON d.s = {_SOURCE.format("t.source")}""",
}
