"""Corrections and retractions: events about other events, applied to the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values
CORRECTION_TYPES = ("attempt_outcome", "attempt_note", "turn_objective")
CORRECTED_OUTCOMES = ("succeeded", "failed", "abandoned", "superseded")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _said(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind).select("event_id", F.col("observed_at").alias("said_at"), "session_id", "project_id", _attr("type").alias("type"), _attr("target_type").alias("target_type"), _attr("target").alias("target"), _attr("outcome").alias("new_outcome"), _attr("failure_class").alias("new_class"), _attr("reason").alias("reason"), F.coalesce(F.try_element_at("content", F.lit("note")), _attr("note")).alias("note"), F.try_element_at("content", F.lit("objective")).alias("new_objective"))


def retracted_events(events: DataFrame) -> DataFrame:
    """Event ids that a retraction of a session or an event takes out; meta events never are."""
    said = _said(events, "retraction")
    facts = events.where(~F.col("kind").isin("correction", "retraction"))
    by_session = facts.join(said.where("target_type = 'session'").select(F.col("target").alias("session_id")).distinct(), "session_id", "left_semi")
    by_event = facts.join(said.where("target_type = 'event'").select(F.col("target").alias("event_id")).distinct(), "event_id", "left_semi")
    return by_session.select("event_id", "session_id").unionByName(by_event.select("event_id", "session_id")).distinct()


def retract_attempts(attempts: DataFrame, meta_events: DataFrame) -> DataFrame:
    """Retracted attempts go; what pointed to them is cleared, and an attempt they superseded is failed again."""
    gone = _said(meta_events, "retraction").where("target_type = 'attempt'").select(F.col("target").alias("attempt_id")).distinct()
    kept = attempts.join(gone, "attempt_id", "left_anti")
    lost = gone.select(F.col("attempt_id").alias("gone_id"))
    kept = kept.join(lost, kept["superseded_by"] == lost["gone_id"], "left")
    kept = kept.withColumns({"outcome": F.when(F.col("gone_id").isNotNull(), "failed").otherwise(F.col("outcome")), "superseded_by": F.when(F.col("gone_id").isNull(), F.col("superseded_by"))}).drop("gone_id")
    kept = kept.join(lost, kept["supersedes"] == lost["gone_id"], "left")
    return kept.withColumn("supersedes", F.when(F.col("gone_id").isNull(), F.col("supersedes"))).drop("gone_id")


def retracted_sessions(meta_events: DataFrame) -> DataFrame:
    """session_id of the sessions that a retraction names."""
    return _said(meta_events, "retraction").where("target_type = 'session'").select(F.col("target").alias("session_id")).distinct()


def named_attempts(attempts: DataFrame, meta_events: DataFrame) -> DataFrame:
    """The attempts that a retraction names: their calls and the events that those rest on."""
    gone = _said(meta_events, "retraction").where("target_type = 'attempt'").select(F.col("target").alias("attempt_id")).distinct()
    return attempts.join(gone, "attempt_id", "left_semi").select("attempt_id", "session_id", "tool_call_ids", "evidence")


def without_calls(calls: DataFrame, gone: DataFrame) -> DataFrame:
    """``calls`` but those of retracted attempts; with them go the edges that are made of calls."""
    return calls.join(gone.select(F.explode("tool_call_ids").alias("tool_call_id")).distinct(), "tool_call_id", "left_anti")


def without_handoffs(handoffs: DataFrame, gone: DataFrame) -> DataFrame:
    """``handoffs`` but those that rest on an event of a retracted attempt."""
    cited = gone.select(F.explode("evidence").alias("event")).distinct()
    told = handoffs.select("to_turn", F.explode("evidence").alias("event")).join(cited, "event", "left_semi").select("to_turn").distinct()
    return handoffs.join(told, "to_turn", "left_anti")


def _latest(said: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("said_at"), F.desc("event_id")))
    return said.withColumn("n", newest).where("n = 1").drop("n")


def correct_attempts(attempts: DataFrame, meta_events: DataFrame) -> DataFrame:
    """The latest correction of an attempt's outcome, and of its note, wins; what was inferred is kept beside it."""
    said = _said(meta_events, "correction")
    outcome = _latest(said.where((F.col("type") == "attempt_outcome") & F.col("new_outcome").isin(*CORRECTED_OUTCOMES))).select(F.col("target").alias("attempt_id"), "new_outcome", "new_class", F.col("event_id").alias("by"), F.col("said_at").alias("at_"))
    note = _latest(said.where("type = 'attempt_note'")).select(F.col("target").alias("attempt_id"), "note", F.col("event_id").alias("note_by"), F.col("said_at").alias("note_at"))
    rows = attempts.join(outcome, "attempt_id", "left").join(note, "attempt_id", "left")
    changed = F.col("new_outcome").isNotNull()
    failure = F.col("new_outcome").isin("failed", "superseded")
    return rows.withColumns({
        "inferred_outcome": F.when(changed, F.col("outcome")), "inferred_failure_class": F.when(changed, F.col("failure_class")), "correction_type": F.when(changed, "attempt_outcome").when(F.col("note_by").isNotNull(), "attempt_note"),
        "corrected_by": F.coalesce("by", "note_by"), "corrected_at": F.coalesce("at_", "note_at"), "failure_class": F.when(changed, F.when(failure, F.coalesce("new_class", "failure_class"))).otherwise(F.col("failure_class")), "outcome": F.coalesce("new_outcome", "outcome"),
    }).drop("new_outcome", "new_class", "by", "at_", "note_by", "note_at")


def correct_turns(turns: DataFrame, meta_events: DataFrame) -> DataFrame:
    said = _latest(_said(meta_events, "correction").where("type = 'turn_objective' and new_objective is not null")).select(F.col("target").alias("turn_id"), "new_objective", F.col("event_id").alias("corrected_by"), F.col("said_at").alias("corrected_at"))
    rows = turns.join(said, "turn_id", "left")
    return rows.withColumns({"inferred_objective": F.when(F.col("new_objective").isNotNull(), F.col("objective")), "objective": F.coalesce("new_objective", "objective")}).drop("new_objective")


def corrections(meta_events: DataFrame, attempts: DataFrame, turns: DataFrame) -> DataFrame:
    """Every correction with what became of it."""
    said = _said(meta_events, "correction")
    known = attempts.select(F.col("attempt_id").alias("target"), F.lit("attempt").alias("is_a")).unionByName(turns.select(F.col("turn_id").alias("target"), F.lit("turn").alias("is_a")))
    gone = _said(meta_events, "retraction").where("target_type = 'attempt'").select("target", F.lit(True).alias("gone")).distinct()
    rows = said.join(known, "target", "left").join(gone, "target", "left")
    bad = ~F.coalesce(F.col("type").isin(*CORRECTION_TYPES), F.lit(False)) | ((F.col("type") == "attempt_outcome") & ~F.coalesce(F.col("new_outcome").isin(*CORRECTED_OUTCOMES), F.lit(False)))
    status = F.when(bad, "invalid").when(F.col("gone"), "target_retracted").when(F.col("is_a").isNull(), "target_not_found").when((F.col("type") == "turn_objective") & F.col("new_objective").isNull(), "content_unavailable").otherwise("applied")
    return rows.select("event_id", F.col("said_at").alias("corrected_at"), "session_id", "project_id", F.col("type").alias("correction_type"), F.col("is_a").alias("target_type"), "target", F.col("new_outcome").alias("outcome"), F.col("new_class").alias("failure_class"), "note", F.length("note").cast("long").alias("note_chars"), status.alias("status"), F.array("event_id").alias("evidence"), F.lit(1.0).alias("confidence"))


def retractions(events: DataFrame) -> DataFrame:
    """Every retraction with the number of events it took out."""
    said = _said(events, "retraction")
    facts = events.where(~F.col("kind").isin("correction", "retraction"))
    sizes = facts.groupBy(F.col("session_id").alias("target")).agg(F.count("*").alias("n")).withColumn("target_type", F.lit("session")).unionByName(facts.select(F.col("event_id").alias("target"), F.lit(1).cast("long").alias("n"), F.lit("event").alias("target_type")))
    rows = said.join(sizes, ["target", "target_type"], "left")
    return rows.select("event_id", F.col("said_at").alias("retracted_at"), "project_id", "target_type", "target", F.coalesce("reason", F.lit("other")).alias("reason"), "note", F.length("note").cast("long").alias("note_chars"), (F.col("n").isNotNull() | (F.col("target_type") == "attempt")).alias("matched"), F.coalesce("n", F.lit(0)).alias("retracted_events"), F.array("event_id").alias("evidence"), F.lit(1.0).alias("confidence"))


#: Columns of retracted rows that hold text or paths.
MASKED = {"events": ("prompt", "paths", "content"), "turns": ("objective", "inferred_objective"), "tool_calls": ("paths",), "attempts": ("objective", "note", "approach", "paths"), "corrections": ("note",)}


def masked(df: DataFrame, table: str, hidden: Column) -> DataFrame:
    """``df`` with the text columns of hidden rows null."""
    return df.withColumns({c: F.when(~hidden, F.col(c)) for c in MASKED.get(table, ()) if c in df.columns})
