"""Filters, counts and other reads over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import rules
from skein.functions.extract import push_status
from skein.operators.graph import node_ids, within
from skein.schema import ACTIVE_NODES, DIGEST_ACTIVE, DIGEST_RESOLVED, OPEN, RESOLVED_SUMMARY

SKIPPED_SESSIONS = r"^(test_.*|tmp.*|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"


def active_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status").isin(ACTIVE_NODES))


def find_by_label(nodes: DataFrame, label: str, kind: str | None = None) -> DataFrame:
    found = nodes.where(F.lower("label") == label.lower())
    return found.where(F.col("type") == kind) if kind else found


def label_contains(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("label"), F.lit(part.lower())))


def by_id_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.col("id").startswith(prefix))


def edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among (session_id, id), each once."""
    ends = ids.select("session_id", "id").distinct()
    out = edges.withColumn("id", F.explode(F.array_distinct(F.array("from_id", "to_id"))))
    return out.join(ends, ["session_id", "id"]).drop("id").dropDuplicates(["seq"])


def topic_filter(nodes: DataFrame, topic: str) -> DataFrame:
    """Of each session the nodes with a topic, or all of it where none has it."""
    has = nodes.where(F.col("topic") == topic).select("session_id").distinct().withColumn("_has", F.lit(True))
    return nodes.join(has, "session_id", "left").where((F.col("topic") == topic) | F.col("_has").isNull()).drop("_has")


def visible_graph(nodes: DataFrame, edges: DataFrame, kinds: list[str], statuses: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types and statuses, and the edges between two of them."""
    shown = nodes.where(F.col("type").isin(kinds) & F.col("status").isin(statuses))
    return shown, within(edges, node_ids(shown))


def section(kind: Column, status: Column) -> Column:
    """The section of the overview a node is listed in; null for none."""
    return (
        F.when(status == "conflicted", "conflicts")
        .when((kind == "question") & (status == "active"), "questions")
        .when((kind == "error") & status.isin(OPEN), "errors")
        .when((kind == "task") & status.isin("pending", "in_progress", "blocked"), "tasks")
        .when((kind == "decision") & status.isin("proposed", "adopted"), "decisions")
    )


def kept_status(history: Column, keep: str) -> Column:
    """What a conflict is resolved to: the last (old) or first (new) history status that isn't conflicted."""
    settled = F.filter(history, lambda h: h["status"] != "conflicted")
    return F.try_element_at(settled, F.lit(-1 if keep == "old" else 1))["status"]


def live_sessions(nodes: DataFrame) -> DataFrame:
    """(session_id, n_nodes) of sessions that are no tests, temporary or bare ids."""
    return nodes.where(~F.col("session_id").rlike(SKIPPED_SESSIONS)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def counts_by(nodes: DataFrame) -> DataFrame:
    """(session_id, by, value, n): counts by type and by status in one pass."""
    out = nodes.groupingSets([["session_id", "type"], ["session_id", "status"]], "session_id", "type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("type").alias("g")
    )
    return out.select(
        "session_id", F.when(F.col("g") == 0, "type").otherwise("status").alias("by"), F.when(F.col("g") == 0, F.col("type")).otherwise(F.col("status")).alias("value"), "n"
    )


def digest_stats(nodes: DataFrame) -> DataFrame:
    """Six counts a session: open questions, errors and tasks, live decisions, settled and deferred nodes."""
    k, s = F.col("type"), F.col("status")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return nodes.groupBy("session_id").agg(
        n((k == "question") & s.isin(DIGEST_ACTIVE)).alias("open_questions"),
        n((k == "error") & ~s.isin(DIGEST_RESOLVED)).alias("open_errors"),
        n((k == "task") & s.isin(DIGEST_ACTIVE)).alias("open_tasks"),
        n((k == "decision") & s.isin("adopted", "proposed")).alias("decisions"),
        n(s.isin(DIGEST_RESOLVED)).alias("settled"),
        n(s == "deferred").alias("deferred"),
    )


def dominant_type(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, type, n): the most frequent type of each group, ties to the one seen first."""
    each = nodes.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("f"))
    return each.groupBy(*by).agg(F.max_by(F.struct("type", "n"), F.struct("n", (-F.col("f")).alias("f"))).alias("t")).select(*by, "t.*")


def group_label(nodes: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """(by, name): the labels of the most confident nodes of each group, joined by slashes; ties by seq."""
    c = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(-1e9))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), "seq"))
    top = nodes.withColumn("_r", rank).where(F.col("_r") <= most)
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]), " / ").alias("name"))


def session_catalog(nodes: DataFrame, edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, title, n_nodes, n_edges, last_change) of every known session."""
    n = nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("updated_at").alias("last_change"))
    e = edges.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = sessions.select("session_id", "title").join(n, "session_id", "left").join(e, "session_id", "left")
    return out.select("session_id", "title", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "last_change")


def resolved_summary(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, rank, seq, type, status, label, overflow): the first settled nodes of each session and how many more."""
    by = Window.partitionBy("session_id")
    done = nodes.where(F.col("status").isin(RESOLVED_SUMMARY))
    n = done.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    first = done.withColumn("rank", F.row_number().over(by.orderBy("seq"))).where(F.col("rank") <= most)
    return first.join(n, "session_id").select("session_id", "rank", "seq", "type", "status", "label", F.greatest(F.lit(0), F.col("n") - most).alias("overflow"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, id, change, old_status, new_status): nodes added, removed and changed in status between two exports."""
    key = ["session_id", "id"]

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.where("id is not null").groupBy(*key).agg(F.max_by(F.struct("status"), "seq").alias("s")).select(*key, F.col("s.status").alias(name), F.lit(True).alias(f"in_{name}"))

    both = last(old, "old_status").join(last(new, "new_status"), key, "full_outer")
    change = (
        F.when(F.col("in_old_status").isNull(), "added")
        .when(F.col("in_new_status").isNull(), "removed")
        .when(~F.col("old_status").eqNullSafe(F.col("new_status")), "status")
    )
    return both.withColumn("change", change).where("change is not null").select(*key, "change", "old_status", "new_status")


def high_priority(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, id): unsettled errors and tasks and what they are tied to."""
    urgent = nodes.where(F.col("type").isin("error", "task") & ~F.col("status").isin("fixed", "done", "deferred") & F.col("id").isNotNull()).select("session_id", "id").distinct()
    both = edges.select("session_id", F.col("from_id").alias("id"), F.col("to_id").alias("o")).unionByName(
        edges.select("session_id", F.col("to_id").alias("id"), F.col("from_id").alias("o"))
    )
    tied = both.join(urgent, ["session_id", "id"], "left_semi").select("session_id", F.col("o").alias("id")).where("id is not null")
    return urgent.unionByName(tied).distinct()


def terminal_status(kind: Column) -> Column:
    return rules.lookup(rules.TERMINAL_BY_TYPE, kind, "resolved")


def initial_status(kind: Column) -> Column:
    return rules.lookup(rules.INITIAL_BY_TYPE, kind, "active")


def attention_counts(nodes: DataFrame) -> DataFrame:
    """Per session the nodes, and those that are unconfirmed, in conflict, test failures and endpoints."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return nodes.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        n(F.col("status") == "unconfirmed").alias("unconfirmed"),
        n(F.col("status") == "conflicted").alias("conflicted"),
        n(F.col("subtype") == "test_failure").alias("test_failures"),
        n(F.col("subtype") == "endpoint").alias("endpoints"),
    )


def set_status(nodes: DataFrame, which: Column, status: Column, note: str | None = None, at: str | None = None, history: bool = True) -> DataFrame:
    """Nodes with a new status where ``which`` holds and it differs; the old one goes to the history (unless ``history`` is
    off, as for edits in the viewer) and updated_at is set."""
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    change = F.coalesce(which, F.lit(False)) & ~F.col("status").eqNullSafe(status)
    out = nodes.withColumn("_c", change).withColumn("_s", status)
    if history:
        pushed = push_status(F.col("status_history"), F.col("status"), F.lit(note), when)
        out = out.withColumn("status_history", F.when(F.col("_c"), pushed).otherwise(F.col("status_history")))
    out = out.withColumn("status", F.when(F.col("_c"), F.col("_s")).otherwise(F.col("status")))
    return out.withColumn("updated_at", F.when(F.col("_c"), when).otherwise(F.col("updated_at"))).drop("_c", "_s")


def linked_pairs(edges: DataFrame) -> DataFrame:
    """The distinct (session_id, a, b) that some edge ties, in either direction, each once with a <= b."""
    ends = edges.where("from_id is not null and to_id is not null")
    return ends.select("session_id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()


def id_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, id, side) of ids that only the old, only the new or both exports hold."""
    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.where("id is not null").select("session_id", "id").distinct().withColumn(name, F.lit(True))

    both = ids(old, "o").join(ids(new, "n"), ["session_id", "id"], "full_outer")
    return both.select("session_id", "id", F.when(F.col("o") & F.col("n"), "both").when(F.col("o"), "old").otherwise("new").alias("side"))
