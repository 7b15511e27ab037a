"""Incremental refresh: each micro-batch is appended once, and only the sessions it touches are derived anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import session_stage
from ..operators.events import EVENT, sequenced
from ..sources import store


def touched(batch: DataFrame, all_events: DataFrame) -> DataFrame:
    """All events of the sessions that a batch touches."""
    return all_events.join(batch.select("session_id").distinct(), "session_id", "left_semi")


def merged(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """``old`` with the rows of the new sessions replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def session_tables(events: DataFrame, as_of) -> dict[str, DataFrame]:
    """The tables that one session's events decide on their own."""
    # the wall order: one late event without a clock must not change the order of sessions that the batch does not touch
    facts = session_stage.with_turns(sequenced(events, ["observed_at", "captured_at", "event_id"]))
    sessions = session_stage.sessions(facts, as_of)
    turns = session_stage.turns(facts, sessions)
    calls = session_stage.tool_calls(facts)
    return {"sessions": sessions, "turns": turns, "tool_calls": calls, "attempts": session_stage.attempts(calls, turns, sessions)}


def start(spark: SparkSession, source: str, table: str, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Read JSON event files as they come and append them to ``table``; duplicates and a repeated batch change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        store.ingest(batch, table)
        if on_batch is not None:
            on_batch(batch, touched(batch, store.read(batch.sparkSession, table)))

    stream = spark.readStream.schema(EVENT).json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def live(events: DataFrame, gap: str = "30 minutes", late: str = "24 hours") -> DataFrame:
    """Activity windows of each session, as a stream or a batch; state is dropped a day after it."""
    stamped = events.withWatermark("observed_at", late) if events.isStreaming else events
    return stamped.groupBy("session_id", F.session_window("observed_at", gap).alias("w")).agg(F.count("*").alias("events")).select("session_id", F.col("w.start").alias("active_from"), F.col("w.end").alias("active_until"), "events")
