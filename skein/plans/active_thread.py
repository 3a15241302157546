"""The active thread: what a session is busy with, ranked, capped by section and fitted to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import escape_xml
from skein.operators.ranking import bucketed_running
from skein.operators.views import high_priority, resolved_summary
from skein.schema import ACTIVE_THREAD

CHARS_PER_TOKEN = 4


def caps(budget: int) -> dict[str, int]:
    """Rows each section may show, from the token budget: shares of the items that fit, with floors."""
    total = max(8, (budget * CHARS_PER_TOKEN - 800) // 180)
    shares = {"open_questions": (20, 3), "errors": (25, 3), "tasks": (30, 3), "decisions": (15, 2), "files": (7, 2), "context": (3, 1)}
    return {name: max(floor, total * share // 100) for name, (share, floor) in shares.items()}


def demote_stale(nodes: DataFrame, min_nodes: int = 30, min_active: int = 50) -> DataFrame:
    """In sessions of at least ``min_nodes`` nodes and more than ``min_active`` active ones, the older half of the pending
    tasks (at least one) shown as deferred."""
    pending = (F.col("type") == "task") & (F.col("status") == "pending")
    facts = nodes.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.coalesce(F.col("status").isin(ACTIVE_THREAD), F.lit(False))).alias("_active"),
        F.count_if(F.coalesce(pending, F.lit(False))).alias("_pending"),
    )
    stale = facts.where((F.col("_n") >= min_nodes) & (F.col("_active") > min_active) & (F.col("_pending") > 0))
    half = F.greatest(F.lit(1), F.floor(F.col("_pending") / 2))
    day = F.coalesce(F.floor(F.unix_micros("created_at") / 86_400_000_000), F.lit(-(2**40)))
    ranked_tasks = bucketed_running(nodes.where(pending).join(stale, "session_id").withColumn("_day", day), ["session_id"], "_day", ["created_at", "seq"], rank="_r")
    old = ranked_tasks.where(F.col("_r") < half).select("seq", F.lit(True).alias("_stale"))
    return nodes.join(old, "seq", "left").withColumn("status", F.when(F.col("_stale"), "deferred").otherwise(F.col("status"))).drop("_stale")


def size(label: Column, summary: Column) -> Column:
    return F.length(F.coalesce(label, F.lit(""))) + F.length(F.coalesce(summary, F.lit(""))) + 65


def priority(tied: Column) -> Column:
    """How late a node is left out: 10 never, 0 first; ``tied`` tells whether an open error or task refers to it."""
    kind, status, c = F.col("type"), F.col("status"), F.col("confidence")
    return (
        F.when(status == "deferred", 0)
        .when(kind.isin("concept", "skill") & (c < 0.5), 1)
        .when(kind.isin("concept", "skill") & (c < 0.7), 2)
        .when(kind.isin("concept", "skill"), 3)
        .when((kind == "decision") & (status == "adopted"), 4)
        .when((kind == "file") & ~tied, 5)
        .otherwise(10)
    )


def fit_budget(active: DataFrame, edges: DataFrame, budget: int = 1200) -> DataFrame:
    """Of each session's active nodes those that fit the budget, with ``_order``, their place.

    A session that fits as a whole stays in the order of seq. Else its nodes are taken by priority and seq; protected ones
    always stay, others only if they fit, and one that doesn't takes no room. Of the unprotected nodes of one size only as
    many as the budget holds can ever fit, so the fold runs over a bounded list however large the session is.
    """
    most = budget * CHARS_PER_TOKEN
    tied = high_priority(active, edges).withColumn("_tied", F.lit(True))
    rows = active.join(tied, ["session_id", "id"], "left").withColumn("_p", priority(F.coalesce("_tied", F.lit(False))))
    rows = rows.withColumn("_size", size(F.col("label"), F.col("summary")).cast("long")).drop("_tied")
    facts = rows.groupBy("session_id").agg(
        (F.sum("_size") + 100).alias("_all"), (F.sum(F.when(F.col("_p") == 10, F.col("_size")).otherwise(0)) + 100).alias("_kept")
    )
    same = Window.partitionBy("session_id", "_size").orderBy(F.desc("_p"), "seq")
    loose = rows.where("_p < 10").select("session_id", "_size", "_p", "seq").withColumn("_k", F.row_number().over(same))
    loose = loose.where(F.col("_k") * F.col("_size") <= most)
    lists = loose.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_p")).alias("p"), "seq", F.col("_size").alias("s")))).alias("l"))
    folded = lists.join(facts, "session_id").select(
        "session_id",
        F.explode(
            F.aggregate(
                "l",
                F.struct(F.col("_kept").alias("used"), F.array().cast("array<bigint>").alias("taken")),
                lambda st, x: F.when(
                    st["used"] + x["s"] <= most, F.struct((st["used"] + x["s"]).alias("used"), F.array_append(st["taken"], x["seq"]).alias("taken"))
                ).otherwise(st),
                lambda st: st["taken"],
            )
        ).alias("seq"),
    )
    fits = rows.join(facts, "session_id").join(folded.select("session_id", "seq", F.lit(True).alias("_fits")), ["session_id", "seq"], "left")
    whole = F.col("_all") <= most
    kept = fits.where(whole | (F.col("_p") == 10) | F.coalesce("_fits", F.lit(False)))
    return kept.withColumn("_order", F.struct(F.when(whole, 0).otherwise(-F.col("_p")).alias("p"), F.col("seq").alias("s"))).drop("_all", "_kept", "_fits", "_size", "_p")


def sections(active: DataFrame) -> DataFrame:
    """Active nodes by the section they are shown in, once per section."""
    k, s = F.col("type"), F.col("status")
    which = {
        "open_questions": (k == "question") & s.isin("active", "deferred"),
        "errors": (k == "error") & ~s.isin("fixed", "resolved"),
        "decisions": (k == "decision") & s.isin("proposed", "adopted"),
        "tasks": (k == "task") & s.isin("pending", "in_progress", "blocked"),
        "context": k.isin("skill", "concept") & (s == "active"),
        "files": k == "file",
        "conflicts": s == "conflicted",
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in which.items()]))
    return active.withColumn("section", F.explode(names))


def ranked(shown: DataFrame, budget: int = 1200) -> DataFrame:
    """Rows (session_id, section, rank, seq, overflow) of each section up to its cap: tasks by urgency and newest first,
    questions and errors by confidence, others in the given order (``_order``)."""
    limit = caps(budget)
    urgency = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "blocked", 1).otherwise(2)
    first = F.when(F.col("section") == "tasks", urgency).otherwise(0)
    sure = F.when(F.col("section").isin("open_questions", "errors"), F.coalesce(F.nanvl("confidence", F.lit(-1.0)), F.lit(-1.0))).otherwise(0.0)
    new = F.when(F.col("section") == "tasks", F.unix_micros("created_at")).otherwise(F.lit(0).cast("long"))
    by = Window.partitionBy("session_id", "section").orderBy(first, F.desc(sure), F.desc(new), "_order")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]), F.col("section"))
    n = shown.groupBy("session_id", "section").agg(F.count(F.lit(1)).alias("_n"))
    # the literal bound of all capped sections is pruned before the shuffle; conflicts have none
    capped = shown.where("section <> 'conflicts'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(limit.values())).withColumn("_cap", cap).where("rank <= _cap")
    top = capped.unionByName(shown.where("section = 'conflicts'").withColumn("rank", F.row_number().over(by)).withColumn("_cap", F.lit(2**31 - 1)))
    return top.join(n, ["session_id", "section"]).withColumn("overflow", F.greatest(F.lit(0), F.col("_n") - F.col("_cap"))).drop("_n", "_cap", "_order")


def active_thread(nodes: DataFrame, edges: DataFrame, budget: int = 1200) -> DataFrame:
    """(session_id, section, rank, seq, type, status, text, overflow): the active thread of every session as rows, settled
    nodes included as section resolved_this_session; text is escaped for XML."""
    view = demote_stale(nodes)
    active = fit_budget(view.where(F.col("status").isin(ACTIVE_THREAD)), edges, budget)
    text = F.concat(F.coalesce("label", F.lit("")), F.when(F.col("section") == "files", "").otherwise(F.concat(F.lit(": "), F.coalesce("summary", F.lit("")))))
    top = ranked(sections(active), budget).select("session_id", "section", "rank", "seq", "type", "status", escape_xml(text).alias("text"), "overflow")
    done = resolved_summary(view).select(
        "session_id", F.lit("resolved_this_session").alias("section"), "rank", "seq", "type", "status", escape_xml(F.coalesce("label", F.lit(""))).alias("text"), "overflow"
    )
    return top.unionByName(done)


TAGS = {"open_questions": "q", "errors": "error", "decisions": "d", "tasks": "t", "context": "item", "files": "f", "conflicts": "conflict", "resolved_this_session": "r"}


def render(thread: DataFrame, root: str = "session_context") -> DataFrame:
    """(session_id, xml): the rows of :func:`active_thread` as one document a session; sections are capped, so it is small,
    except for conflicts, which are all shown."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(TAGS) for x in (s, i)]), F.col("section"))
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), F.col("section"))
    line = F.concat(F.lit("    <"), tag, F.lit(' status="'), F.col("status"), F.lit('">'), F.col("text"), F.lit("</"), tag, F.lit(">"))
    per = thread.groupBy("session_id", "section", order.alias("o")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda r: r["x"]), "\n").alias("body"), F.max("overflow").alias("more")
    )
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n    <!-- +"), F.col("more").cast("string"), F.lit(" more -->"))).otherwise("")
    block = F.concat(F.lit("  <"), F.col("section"), F.lit(">\n"), F.col("body"), more, F.lit("\n  </"), F.col("section"), F.lit(">"))
    whole = per.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", block.alias("b")))), lambda r: r["b"]), "\n").alias("b"))
    head = F.concat(F.lit(f'<{root} session="'), escape_xml(F.col("session_id")), F.lit('">\n'))
    return whole.select("session_id", F.concat(head, F.col("b"), F.lit(f"\n</{root}>")).alias("xml"))
