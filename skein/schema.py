"""Fixed vocabulary and target schemas of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Node types, statuses and relations.
NODE_TYPES = ["question", "decision", "concept", "skill", "file", "error", "task"]
NODE_STATUSES = [
    "active", "resolved", "deferred", "proposed", "adopted", "rejected", "superseded", "fixed", "pending", "in_progress",
    "done", "blocked", "cancelled", "unconfirmed", "conflicted",
]
RELATIONS = [
    "resolves", "depends-on", "leads-to", "contradicts", "uses", "blocks", "supersedes", "replaced-by", "created-by",
    "references", "documents", "tested-by", "configures", "imports", "implements", "relates-to",
]

# The status sets the rules are written in.
TERMINAL = ["adopted", "resolved", "fixed", "done", "rejected"]
OPEN = ["active", "proposed", "pending", "in_progress", "blocked"]
ACTIVE_NODES = [*OPEN, "adopted", "conflicted", "unconfirmed"]
ACTIVE_THREAD = [*ACTIVE_NODES, "deferred"]
RESOLVED_SUMMARY = ["resolved", "fixed", "done", "adopted", "rejected"]
DIGEST_ACTIVE = [*OPEN, "conflicted"]
DIGEST_RESOLVED = [*TERMINAL, "superseded"]
REMEDIATE_SKIP = ["unconfirmed", "fixed", "done", "resolved", "adopted", "rejected", "cancelled", "superseded"]
ALWAYS_ALLOWED = ["deferred", "conflicted", "unconfirmed", "superseded"]
VIEWER_VALID = [s for s in NODE_STATUSES if s != "cancelled"]

HISTORY = T.ArrayType(
    T.StructType(
        [
            T.StructField("status", T.StringType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("note", T.StringType()),
            T.StructField("turn", T.IntegerType()),
        ]
    )
)
TURNS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("turn_number", T.IntegerType()),
        T.StructField("role_user", T.StringType()),
        T.StructField("role_assistant", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
NODES = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("session_id", "id", "type", "label", "summary", "status")],
        T.StructField("confidence", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in ("subtype", "source_url", "metadata", "topic")],
        T.StructField("status_history", HISTORY),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)
EDGES = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("session_id", "id", "from_id", "to_id", "relation")],
        T.StructField("weight", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)
