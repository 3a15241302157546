"""Turns from transcripts, message exports and pasted chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import strip
from skein.operators.ranking import bucketed_running

KNOWN_EVENTS = ["session.start", "user.message", "assistant.message", "assistant.turn_start", "assistant.turn_end",
                "tool.execution_start", "tool.execution_complete"]

USERS, ASSISTANTS = "You|User|Human|Me", "Assistant|Claude|Copilot|GitHub Copilot|GPT|AI"


def transcript_turns(events: DataFrame, block: int = 4096) -> DataFrame:
    """(session_id, turn_number, role_user, role_assistant, ts) of transcript events (sessionid, line_no, type, content,
    starttime): each user message opens a turn, the last non-empty assistant message in it is its answer, an answer before any
    user message is a turn of its own, turns empty on both sides are dropped before they are numbered. ts is the session's
    start. Rows without session or place are ignored; of several rows at one place the smallest row_id comes first.

    Turns are counted over blocks of ``block`` lines with prefix sums, so a hot session isn't one task's work.
    """
    rows = events.where("sessionid is not null and line_no is not null").select(
        "sessionid", "line_no", "row_id", "type", F.coalesce("content", F.lit("")).alias("content"), "starttime"
    )
    said = rows.where(F.col("type").isin("user.message", "assistant.message"))
    said = said.withColumn("_u", (F.col("type") == "user.message").cast("long")).withColumn("_b", F.floor(F.col("line_no") / block))
    counted = bucketed_running(said, ["sessionid"], "_b", ["line_no", "row_id"], rank="_at", sums={"turn": "_u"})
    answer = F.when((F.col("_u") == 0) & (F.col("content") != ""), F.col("_at"))
    turns = counted.groupBy("sessionid", "turn").agg(
        F.max(F.when(F.col("_u") == 1, F.col("content"))).alias("role_user"), F.max_by("content", answer).alias("role_assistant")
    )
    turns = turns.select("sessionid", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role_user", "role_assistant")])
    turns = turns.where("role_user <> '' or role_assistant <> ''").withColumn("_b", F.floor(F.col("turn") / block))
    numbered = bucketed_running(turns, ["sessionid"], "_b", ["turn"], rank="n")
    starts = rows.where("type = 'session.start'").groupBy("sessionid").agg(F.min_by("starttime", F.struct("line_no", "row_id")).alias("start"))
    return numbered.join(starts, "sessionid", "left").select(
        F.col("sessionid").alias("session_id"), (F.col("n") + 1).cast("int").alias("turn_number"), "role_user", "role_assistant", F.col("start").alias("ts")
    )


def unknown_events(events: DataFrame) -> DataFrame:
    """(type, n): event types the reader doesn't know, with their counts."""
    return events.where(~F.coalesce(F.col("type"), F.lit("")).isin(KNOWN_EVENTS)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def message_pairs(messages: DataFrame, conv: str, pos: str, role: str, text: str, user: str = "user", assistant: str = "assistant", block: int = 4096) -> DataFrame:
    """(conv, turn_number, role_user, role_assistant): adjacent pairs of a user's and an assistant's message, in order of the whole
    numbers ``pos``. Places are counted over blocks of them with prefix sums and pairs meet by place, so a hot conversation isn't
    one task's work."""
    rows = messages.select(conv, pos, F.col(role).alias("_r"), strip(F.coalesce(F.col(text), F.lit(""))).alias("_t")).where(F.col(conv).isNotNull())
    placed = bucketed_running(rows.withColumn("_b", F.floor(F.col(pos) / block)), [conv], "_b", [pos], rank="_at")
    asked = placed.where(F.col("_r") == user).select(conv, (F.col("_at") + 1).alias("_at"), F.col("_t").alias("role_user"))
    pairs = asked.join(placed.where(F.col("_r") == assistant).select(conv, "_at", F.col("_t").alias("role_assistant")), [conv, "_at"])
    numbered = bucketed_running(pairs.withColumn("_b", F.floor(F.col("_at") / block)), [conv], "_b", ["_at"], rank="_n")
    return numbered.select(conv, (F.col("_n") + 1).cast("int").alias("turn_number"), "role_user", "role_assistant")


def delimited_turns(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn_number, role_user, role_assistant) of pasted chats, one text a row: split before speaker labels at line
    starts; a further user text opens a new turn if the last has both sides and else replaces it, a further answer replaces the
    last, text without label is added to the answer or, with no user text yet, is the user's; no label at all gives one turn."""
    label = f"(?i)^(?:{USERS}|{ASSISTANTS})\\s*:"
    segments = F.filter(F.transform(F.split(text, f"\\n(?=(?i:{USERS}|{ASSISTANTS})\\s*:)"), lambda s: strip(s)), lambda s: s != "")
    zero = F.struct(
        F.array().cast("array<struct<u:string,a:string>>").alias("done"), F.lit("").alias("u"), F.lit("").alias("a")
    )

    def take(state, seg):
        u, a, done = state["u"], state["a"], state["done"]
        body = strip(F.regexp_replace(seg, label + "\\s*", ""))
        is_user, is_answer = seg.rlike(f"(?i)^(?:{USERS})\\s*:"), seg.rlike(f"(?i)^(?:{ASSISTANTS})\\s*:")
        full = (u != "") & (a != "")
        return (
            F.when(
                is_user,
                F.struct(
                    F.when(full, F.array_append(done, F.struct(strip(u).alias("u"), strip(a).alias("a")))).otherwise(done).alias("done"),
                    body.alias("u"),
                    F.when(full, "").otherwise(a).alias("a"),
                ),
            )
            .when(is_answer, F.struct(done.alias("done"), u.alias("u"), body.alias("a")))
            .when(u != "", F.struct(done.alias("done"), u.alias("u"), F.concat(a, F.lit("\n"), seg).alias("a")))
            .otherwise(F.struct(done.alias("done"), seg.alias("u"), a.alias("a")))
        )

    def finish(state):
        last = F.struct(strip(state["u"]).alias("u"), strip(state["a"]).alias("a"))
        return F.when(state["u"] != "", F.array_append(state["done"], last)).otherwise(state["done"])

    turns = F.aggregate(segments, zero, take, finish)
    whole = strip(F.col(text))
    alone = F.array(F.struct(whole.alias("u"), F.lit("").alias("a")))
    turns = F.when((F.size(turns) == 0) & (whole != ""), alone).otherwise(turns)
    return texts.select(key, F.posexplode(turns).alias("p", "t")).select(
        key, (F.col("p") + 1).alias("turn_number"), F.col("t.u").alias("role_user"), F.col("t.a").alias("role_assistant")
    )
