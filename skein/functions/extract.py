"""Validation, grounding and scoring of candidate nodes, as column expressions over one row each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import rules
from skein.functions.text import all_matches, WORD
from skein.schema import ALWAYS_ALLOWED, NODE_STATUSES, NODE_TYPES, OPEN, RELATIONS, TERMINAL


def valid_type(col: Column) -> Column:
    return F.when(col.isin(NODE_TYPES), col).otherwise("concept")


def valid_status(status: Column, kind: Column) -> Column:
    """Unknown statuses are active; an active task is pending."""
    known = F.when(status.isin(NODE_STATUSES), status).otherwise("active")
    return F.when((kind == "task") & (known == "active"), "pending").otherwise(known)


def valid_relation(col: Column) -> Column:
    return F.when(col.isin(RELATIONS), col).otherwise("relates-to")


def words(label: Column) -> Column:
    return all_matches(F.lower(label), WORD)


def hits(label: Column, source: Column) -> Column:
    """How many of a label's words occur, as parts of words too, in a source text."""
    text = F.lower(F.coalesce(source, F.lit("")))
    return F.size(F.filter(words(label), lambda w: F.contains(text, w)))


def grounded(label: Column, source: Column) -> Column:
    """Whether enough of a label's words occur: the larger of two and six tenths of them, one of one."""
    n = F.size(words(label))
    need = F.when(n < 2, 1).otherwise(F.greatest(F.lit(2), F.round(n * F.lit(0.6)).cast("int")))
    return hits(label, source) >= need


def speculative_reason(label: Column, source: Column) -> Column:
    """Why a label is speculation: an unknown model version, or words of speculation near its first occurrence; else null."""
    text = F.coalesce(source, F.lit(""))
    at = F.position(F.left(F.lower(label), F.lit(20)), F.lower(text))
    begin = F.greatest(F.lit(1), at - 120)
    window = F.substring(text, begin, at + 200 - begin)
    return F.when(label.rlike(rules.PHANTOM_MODEL), "model_name_unverified").when(
        (at > 0) & window.rlike(rules.SPECULATION), "speculative_language_in_context"
    )


def capped(confidence: Column, reason: Column) -> Column:
    """Confidence after the speculation check."""
    return F.when(reason == "model_name_unverified", F.least(confidence, F.lit(0.40))).when(
        reason.isNotNull(), F.least(confidence, F.lit(0.45))
    ).otherwise(confidence)


def reclassified(kind: Column, status: Column, label: Column) -> tuple[Column, Column]:
    """(type, status) of a node whose label shows that it is no file."""
    suspect = (kind == "file") & ~label.rlike(rules.FILE_KEEP)
    task = suspect & label.rlike(rules.FILE_TO_TASK)
    concept = suspect & ~label.rlike(rules.FILE_TO_TASK) & label.rlike(rules.FILE_TO_CONCEPT)
    return (
        F.when(task, "task").when(concept, "concept").otherwise(kind),
        F.when(task & (status == "active"), "done").when(concept, "active").otherwise(status),
    )


def confidence(label: Column, source: Column, reported: Column) -> Column:
    """Geometric mean of how far a label is grounded (three quarters of it for one or two words) and what was reported."""
    n = F.size(words(label))
    ratio = hits(label, source) / n * F.when(n <= 2, 0.75).otherwise(1.0)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.least(F.lit(1.0), F.sqrt(ratio * reported)), 3))


def is_conflict(current: Column, incoming: Column) -> Column:
    """Whether a new status reverses a settled one."""
    settled = current.isin(TERMINAL) & (incoming.isin(OPEN) | incoming.isin(TERMINAL))
    return (current != incoming) & ~incoming.isin(ALWAYS_ALLOWED) & settled


def push_status(history: Column, old: Column, note: Column, at: Column) -> Column:
    """A status history with the status that is left appended."""
    entry = F.struct(old.alias("status"), at.alias("ts"), note.alias("note"), F.lit(None).cast("int").alias("turn"))
    return F.array_append(F.coalesce(history, F.array().cast("array<struct<status:string,ts:timestamp,note:string,turn:int>>")), entry)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for different lengths, empty or zero vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def sum_of(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    dot = sum_of(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(sum_of(F.transform(a, lambda x: x * x))) * F.sqrt(sum_of(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot / norm).otherwise(0.0)
