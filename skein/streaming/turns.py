"""Streaming ingest: turns assembled per session from event micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, turn_number int, role_user string, role_assistant string"
STATE = "turn int, user string, answer string, open boolean"


def route(turns: DataFrame, every: int) -> DataFrame:
    """Each turn with the backend that reads it: every n-th one goes to the second; with less than 2 all do."""
    second = F.lit(True) if every < 2 else F.col("turn_number") % every == 0
    return turns.withColumn("backend", F.when(second, "second").otherwise("first"))


def fold(idle_ms: int) -> Callable:
    """The stateful fold of :func:`stream_turns`, whose open turns close after ``idle_ms`` without a row."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _fold(key, frames, state, idle_ms)

    return step


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    """Closed turns of one session. A turn closes when the next user message comes, or when the session's timer runs out."""
    turn, user, answer, is_open = state.get if state.exists else (0, "", "", False)
    out = []

    def close() -> None:
        nonlocal turn
        if user or answer:
            turn += 1
            out.append((key[0], turn, user, answer))

    if state.hasTimedOut:
        if is_open:
            close()
        state.update((turn, "", "", False))
    else:
        rows = pd.concat(list(frames)).sort_values(["line_no", "row_id"])
        for kind, content in zip(rows["type"], rows["content"]):
            text = content if isinstance(content, str) else ""
            if kind == "user.message":
                if is_open:
                    close()
                user, answer, is_open = text, "", True
            elif kind == "assistant.message" and text:
                answer, is_open = text, True
        state.update((turn, user, answer, is_open))
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=["session_id", "turn_number", "role_user", "role_assistant"])


def stream_turns(events: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """Turns (session_id, turn_number, role_user, role_assistant) of a stream of transcript events (sessionid, line_no,
    row_id, type, content). Events of a session must come in order of line_no across micro-batches (within one they are sorted);
    rows that come later than that are folded as they come. The state held for a session is its open turn and a counter; an open
    turn is given out when the next question comes or nothing came for ``idle_ms``."""
    said = events.where("sessionid is not null and line_no is not null and type in ('user.message', 'assistant.message')")
    return (
        said.select("sessionid", "line_no", "row_id", "type", "content")
        .groupBy("sessionid")
        .applyInPandasWithState(fold(idle_ms), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    )


def each_batch(stream: DataFrame, merge_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts merging a stream's micro-batches; a batch that fails is tried again from the checkpoint, never skipped."""
    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The stream without repeated keys; what is remembered of them is dropped ``delay`` after their time."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
