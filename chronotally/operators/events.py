"""The canonical event, its ordering, and scans over it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

_S, _L, _T = StringType(), LongType(), TimestampType()
EVENT = StructType([
    StructField("event_id", _S), StructField("observed_at", _T), StructField("captured_at", _T), StructField("hlc", _L), StructField("source_seq", _L),
    StructField("provider", _S), StructField("project_id", _S), StructField("project_name", _S), StructField("provider_session_id", _S), StructField("session_id", _S), StructField("device_id", _S),
    StructField("agent_id", _S), StructField("kind", _S), StructField("tool_name", _S), StructField("tool_category", _S), StructField("tool_call_id", _S), StructField("paths", ArrayType(_S)),
    StructField("outcome_status", _S), StructField("outcome_class", _S), StructField("exit_code", IntegerType()), StructField("duration_ms", _L), StructField("command_category", _S), StructField("git_subcommand", _S),
    StructField("lines_added", _L), StructField("lines_removed", _L), StructField("tests_failed", _L), StructField("prompt", _S), StructField("note", _S), StructField("head", _S), StructField("branch", _S),
    StructField("attrs", MapType(_S, _S)), StructField("content", MapType(_S, _S)),
])
COLUMNS = [f.name for f in EVENT.fields]
# fixed values: the closed vocabularies
MUTATING = ("file_write", "file_edit", "notebook")
TOOL_ENDS = ("tool_call_finished", "tool_call_failed")
TOOL_KINDS = ("tool_call_started", *TOOL_ENDS, "permission_denied")
TURN_STOPS = ("turn_stopped", "turn_failed")
META = ("correction", "retraction")
BLOCKING = ("permission_prompt", "idle_prompt", "agent_needs_input")
INJECTED = ("<command-", "<local-command-", "<system-reminder>", "<task-notification>", "Caveat:", "[Request interrupted", "This session is being continued")


def conform(df: DataFrame) -> DataFrame:
    """All canonical columns, in order; missing ones are null. An event without a session id gets one by provider and project."""
    have = set(df.columns)
    out = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields])
    unnamed = F.coalesce("provider_session_id", F.lit("")).isin("", "unknown")
    own = F.when(unnamed, F.concat_ws("|", "provider", F.lit("unknown"), "project_id")).otherwise(F.concat_ws("|", "provider", "provider_session_id"))
    return out.withColumns({"session_id": F.coalesce("session_id", own), "hlc": F.coalesce("hlc", F.lit(0)), "source_seq": F.coalesce("source_seq", F.lit(0)), "captured_at": F.coalesce("captured_at", "observed_at"), "agent_id": F.coalesce("agent_id", F.lit("")), "paths": F.coalesce("paths", F.array().cast("array<string>"))})


def once(df: DataFrame) -> DataFrame:
    """Each event id once. An id belongs to one session, so deliveries meet where the session's events are dealt."""
    again = F.row_number().over(Window.partitionBy("session_id", "event_id").orderBy("captured_at"))
    return df.repartition("session_id").withColumn("_again", again).where("_again = 1").drop("_again")


def order_columns(events: DataFrame) -> list[str]:
    """Logical clock order if every event has one, else the wall clock's for all."""
    least = events.agg(F.min("hlc")).first()[0]
    return ["observed_at", "hlc", "source_seq", "event_id"] if least else ["observed_at", "captured_at", "event_id"]


def sequenced(events: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """``seq``: the event's place in its session."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy(*(order or order_columns(events)))))


def scan(events: DataFrame, project: str | None = None, session: str | None = None, since: datetime | None = None, until: datetime | None = None, providers: Sequence[str] = (), kinds: Sequence[str] = (), exclude_sessions: Sequence[str] = (), exclude_events: Sequence[str] = (), newest: int | None = None) -> DataFrame:
    """Events that meet every given condition; with ``newest``, the newest so many of them, oldest first."""
    conditions: list[Column] = []
    if project is not None:
        conditions.append(F.col("project_id") == project)
    if session is not None:
        conditions.append(F.col("session_id") == session)
    if since is not None:
        conditions.append(F.col("observed_at") >= F.lit(since))
    if until is not None:
        conditions.append(F.col("observed_at") <= F.lit(until))
    if providers:
        conditions.append(F.col("provider").isin(*providers))
    if kinds:
        conditions.append(F.col("kind").isin(*kinds))
    if exclude_sessions:
        conditions.append(~F.col("session_id").isin(*exclude_sessions))
    if exclude_events:
        conditions.append(~F.col("event_id").isin(*exclude_events))
    for condition in conditions:
        events = events.where(condition)
    if newest is not None:
        events = events.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(newest).orderBy("observed_at", "event_id")
    return events


def is_human_prompt() -> Column:
    injected = F.lit(False)
    for prefix in INJECTED:
        injected = injected | F.coalesce(F.ltrim("prompt").startswith(prefix), F.lit(False))
    return (F.col("kind") == "prompt_submitted") & ~injected


def ordered_distinct(value: Column, by: Column) -> Column:
    """Aggregate: distinct non-null values in the order of ``by``."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(by.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))
