"""Questions about a point in time: state, difference, reasons, evidence."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from .project_stage import unit_members, work_units
from .session_stage import STALE_S, WAITING_STALE_S

SESSION_FIELDS = ("is_open", "session_state", "current_turn", "turn_status", "in_flight_tool_calls", "last_attempt", "last_attempt_outcome", "last_failure_class", "blocked")
UNIT_FIELDS = ("phase", "status", "attempt_count", "failed_attempt_count", "session_count", "last_attempt")


def outcome_at(at: Column) -> Column:
    """An attempt's outcome as it was known at ``at``: in progress before its end, not superseded before its successor began."""
    return F.when(F.col("ended_at").isNull() | (F.col("ended_at") > at), "in_progress").when((F.col("outcome") == "superseded") & (F.coalesce("superseder_at", F.col("ended_at")) > at), "failed").otherwise(F.col("outcome"))


def state_at(projection, at: datetime, projects: Sequence[str] | None = None, session: str | None = None) -> DataFrame:
    """A row for each session that had begun by ``at`` and not ended before it."""
    t = F.lit(at).cast("timestamp")
    sessions = projection.sessions.where((F.col("started_at") <= t) & (F.col("ended_at").isNull() | (F.col("ended_at") >= t)))
    if projects is not None:
        sessions = sessions.where(F.col("project_id").isin(*projects))
    if session is not None:
        sessions = sessions.where(F.col("session_id") == session)
    turn = projection.turns.where(F.col("started_at") <= t).groupBy("session_id").agg(F.max_by(F.struct("turn_id", "turn_index", "status", "ended_at", "objective"), "turn_index").alias("turn"))
    calls = projection.tool_calls.where(F.col("started_at").isNotNull() & (F.col("started_at") <= t) & (F.col("finished_at").isNull() | (F.col("finished_at") > t))).groupBy("session_id").agg(F.count("*").alias("in_flight"))
    later = projection.attempts.select(F.col("attempt_id").alias("superseded_by"), F.col("started_at").alias("superseder_at"))
    attempts = projection.attempts.where(F.col("started_at") <= t).join(later, "superseded_by", "left").withColumn("outcome_then", outcome_at(t))
    # a class is known once the attempt has ended
    attempts = attempts.withColumn("class_then", F.when(F.col("outcome_then").isin("failed", "superseded"), F.col("failure_class")))
    place = F.struct("started_at", "turn_index", "attempt_index")
    ranked = attempts.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("started_at"), F.desc("turn_index"), F.desc("attempt_index"))))
    last = attempts.groupBy("session_id").agg(F.max_by(F.struct("attempt_id", "outcome_then", "class_then"), place).alias("last"), F.count("*").alias("attempt_count"), F.count_if(F.col("outcome_then").isin("failed", "superseded")).alias("failed_attempt_count"))
    twice = ranked.where("n <= 2").groupBy("session_id").agg(((F.count_if(F.col("outcome_then") == "failed") == 2) & (F.countDistinct("class_then") == 1)).alias("repeated"))
    waits = projection.signals.where((F.col("raised_at") <= t) & (F.col("cleared_at").isNull() | (F.col("cleared_at") > t)) & F.col("blocking")).groupBy("session_id").agg(F.max_by("event_id", "raised_at").alias("blocking_signal"))
    seen = projection.facts.where((F.col("observed_at") <= t) & (F.col("kind") != "session_ended")).groupBy("session_id").agg(F.max("observed_at").alias("last_activity_at"), F.max_by("kind", "seq").alias("last_kind"))
    rows = sessions.select("session_id", "provider", "project_id", "project_name", "started_at", "ended_at", "coverage").join(seen, "session_id", "left").join(turn, "session_id", "left").join(calls, "session_id", "left").join(last, "session_id", "left").join(twice, "session_id", "left").join(waits, "session_id", "left")
    ended = F.col("ended_at").isNotNull() & (F.col("ended_at") <= t)
    idle = (F.unix_micros(t) - F.unix_micros("last_activity_at")) / F.lit(1e6)
    limit = F.when(F.col("last_kind").isin("permission_requested", "turn_stopped", "notification"), WAITING_STALE_S).otherwise(STALE_S)
    blocked = F.when(F.col("blocking_signal").isNotNull(), "signal").when(F.coalesce("repeated", F.lit(False)), "repeated_failure")
    return rows.select(
        F.lit("session").alias("subject_type"), "session_id", "provider", "project_id", "project_name", "started_at", "last_activity_at", (~ended).alias("is_open"), F.when(ended, "closed").when(idle > limit, "stale").otherwise("open").alias("session_state"),
        F.col("turn.turn_id").alias("current_turn"), F.when(F.col("turn.ended_at") <= t, F.col("turn.status")).when(F.col("turn").isNotNull(), "in_progress").alias("turn_status"), F.col("turn.objective").alias("objective"), F.coalesce("in_flight", F.lit(0)).alias("in_flight_tool_calls"),
        F.col("last.attempt_id").alias("last_attempt"), F.col("last.outcome_then").alias("last_attempt_outcome"), F.col("last.class_then").alias("last_failure_class"), F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), F.coalesce("failed_attempt_count", F.lit(0)).alias("failed_attempt_count"),
        blocked.isNotNull().alias("blocked"), blocked.alias("blocked_by"), "blocking_signal", F.when(F.col("coverage") == "full", 0.9).when(F.col("coverage") == "partial", 0.7).when(F.col("coverage") == "minimal", 0.5).otherwise(0.3).alias("confidence"), t.alias("as_of"),
    )


def diff(before: DataFrame, after: DataFrame, key: str = "session_id", fields: tuple[str, ...] = SESSION_FIELDS) -> DataFrame:
    """One row for each subject that came, went, or changed, and each changed field."""
    text = lambda c: F.col(c).cast("string")
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[text(f) for f in fields])).alias(f"{name}_map"), F.col("confidence").alias(f"{name}_confidence"))
    both = side(before, "a").join(side(after, "b"), F.col("a_key") == F.col("b_key"), "full_outer")
    changes = F.transform(F.array(*map(F.lit, fields)), lambda f: F.struct(f.alias("field"), F.element_at("a_map", f).alias("before"), F.element_at("b_map", f).alias("after")))
    changed = F.filter(changes, lambda c: ~c["before"].eqNullSafe(c["after"]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    rows = both.select(F.coalesce("a_key", "b_key").alias("subject"), F.when(F.col("a_key").isNull(), "added").when(F.col("b_key").isNull(), "removed").otherwise("changed").alias("change"), F.explode(F.when(F.col("a_key").isNull() | F.col("b_key").isNull(), whole).otherwise(changed)).alias("c"), F.least(F.coalesce("a_confidence", "b_confidence"), F.coalesce("b_confidence", "a_confidence")).alias("confidence"))
    return rows.select("subject", "change", "c.field", "c.before", "c.after", "confidence")


def why_blocked(projection, at: datetime, projects: Sequence[str] | None = None, session: str | None = None) -> DataFrame:
    rows = state_at(projection, at, projects, session).where("blocked")
    claim = F.when(F.col("blocked_by") == "signal", F.concat(F.lit("waits for a human since "), F.col("blocking_signal"))).otherwise(F.concat(F.lit("the last two attempts failed alike: "), F.coalesce("last_failure_class", F.lit("unknown"))))
    return rows.select("session_id", claim.alias("claim"), F.coalesce("blocking_signal", "last_attempt").alias("because"), "confidence")


def why_failed(projection, attempt: str) -> DataFrame:
    rows = projection.attempts.where(F.col("attempt_id") == attempt)
    failed = F.col("outcome").isin("failed", "superseded")
    claim = F.when(failed, F.concat(F.lit("failed: "), F.coalesce("failure_class", F.lit("unknown")))).otherwise(F.concat(F.lit("not a failure: "), "outcome"))
    return rows.select("attempt_id", claim.alias("claim"), "outcome", "failure_class", "fail_event_id", "superseded_by", "corrected_by", "evidence", "confidence")


def work_units_at(projection, at: datetime) -> DataFrame:
    """Work units as they stood at ``at``: turns, calls, attempts, hand-offs, signals and commits up to then, outcomes as known then.

    Membership is sought anew among the turns that had begun; an end, a finish or a clearing that lay ahead is not known.
    """
    t = F.lit(at).cast("timestamp")
    by_then = lambda c: F.when(F.col(c) <= t, F.col(c))
    seen = projection.facts.where((F.col("observed_at") <= t) & F.col("turn_index").isNotNull() & ~F.col("kind").isin("session_started", "session_ended")).groupBy("session_id", "turn_index").agg(F.max("observed_at").alias("seen_at"))
    turns = projection.turns.where(F.col("started_at") <= t).join(seen, ["session_id", "turn_index"], "left")
    turns = turns.withColumns({"last_event_at": F.col("seen_at"), "status": F.when(F.col("ended_at") <= t, F.col("status")).otherwise("in_progress"), "ended_at": by_then("ended_at")}).drop("seen_at")
    done = F.col("finished_at").isNull() | (F.col("finished_at") <= t)
    calls = projection.tool_calls.where(F.col("at") <= t).withColumns({"outcome_status": F.when(done, F.col("outcome_status")), "finished_at": by_then("finished_at")})
    sessions = projection.sessions.where(F.col("started_at") <= t)
    later = projection.attempts.select(F.col("attempt_id").alias("superseded_by"), F.col("started_at").alias("superseder_at"))
    attempts = projection.attempts.where(F.col("started_at") <= t).join(later, "superseded_by", "left")
    attempts = attempts.withColumns({"outcome": outcome_at(t), "ended_at": by_then("ended_at")}).drop("superseder_at")
    signals = projection.signals.where(F.col("raised_at") <= t).withColumn("pending", F.col("cleared_at").isNull() | (F.col("cleared_at") > t))
    commits = projection.commits.where(F.col("committed_at") <= t)
    given = projection.handoffs.where(F.col("handoff_at") <= t)
    members = unit_members(turns, sessions, calls, given, projection.rules)
    return work_units(members, turns, attempts, calls, signals, commits, t, projection.rules)


SHARED = ("subject_type", "subject_id", "provider", "project_id", "project_name", "is_open", "last_activity_at", "last_attempt", "attempt_count", "failed_attempt_count", "blocked", "confidence")


def snapshot(projection, at: datetime, projects: Sequence[str] | None = None, session: str | None = None, work_unit: str | None = None) -> DataFrame:
    """Sessions that were there at ``at`` and work units that had not ended: of some projects, or one session alone, or one unit alone."""
    rows = None
    if work_unit is None:
        own = state_at(projection, at, projects, session)
        rows = own.select(F.lit("session").alias("subject_type"), F.col("session_id").alias("subject_id"), "session_id", F.lit(None).cast("string").alias("work_unit_id"), "provider", "project_id", "project_name", "is_open", "session_state", "current_turn", "turn_status", "in_flight_tool_calls", "last_attempt", "last_attempt_outcome", "last_failure_class", "last_activity_at", "blocked", "blocked_by", F.lit(None).cast("string").alias("phase"), F.lit(None).cast("string").alias("status"), "attempt_count", "failed_attempt_count", F.array("session_id").alias("sessions"), "confidence")
    if session is not None:
        return rows
    units = work_units_at(projection, at).where(F.col("ended_at").isNull() | (F.col("ended_at") > F.lit(at).cast("timestamp")))
    units = units.where(F.col("project_id").isin(*projects)) if projects is not None else units
    units = units.where(F.col("work_unit_id") == work_unit) if work_unit is not None else units
    none = lambda kind: F.lit(None).cast(kind)
    units = units.select(F.lit("work_unit").alias("subject_type"), F.col("work_unit_id").alias("subject_id"), none("string").alias("session_id"), "work_unit_id", F.array_join("actors", ",").alias("provider"), "project_id", "project_name", F.lit(True).alias("is_open"), none("string").alias("session_state"), none("string").alias("current_turn"), none("string").alias("turn_status"), none("bigint").alias("in_flight_tool_calls"), "last_attempt", none("string").alias("last_attempt_outcome"), none("string").alias("last_failure_class"), F.col("updated_at").alias("last_activity_at"), F.col("blocking_signal").isNotNull().alias("blocked"), F.when(F.col("blocking_signal").isNotNull(), "signal").alias("blocked_by"), "phase", "status", "attempt_count", "failed_attempt_count", "sessions", "confidence")
    return units if rows is None else rows.unionByName(units)


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """``diff`` of two snapshots, sessions by their fields and work units by theirs."""
    fields = tuple(dict.fromkeys([*SESSION_FIELDS, *UNIT_FIELDS]))
    sized = lambda df: df.withColumn("session_count", F.when(F.col("subject_type") == "work_unit", F.size("sessions")))
    # a session has no unit's counts and a unit no session's fields: those are null on both sides
    counts = {c: F.when(F.col("subject_type") == "work_unit", F.col(c)) for c in ("attempt_count", "failed_attempt_count")}
    flags = {c: F.when(F.col("subject_type") == "session", F.col(c)) for c in ("is_open", "blocked")}
    side = lambda df: sized(df).withColumns(counts | flags)
    return diff(side(before), side(after), "subject_id", fields)


def why_unit_blocked(projection, unit: str) -> DataFrame:
    """One row if the unit waits for a human, or its last two attempts failed alike; none else."""
    units = projection.work_units.where(F.col("work_unit_id") == unit)
    signal = projection.signals.select(F.col("event_id").alias("blocking_signal"), F.col("kind").alias("signal_kind"), "signal_type", "raised_at", "session_id")
    grade = projection.sessions.select("session_id", (F.col("coverage") == "full").alias("full"))
    asked = units.join(signal, "blocking_signal").join(grade, "session_id")
    what = F.when(F.col("signal_kind") == "permission_requested", "a permission request").otherwise(F.concat(F.lit("a "), F.coalesce("signal_type", F.lit("unknown")), F.lit(" notification")))
    waiting = asked.select("work_unit_id", "project_name", "phase", "status", "blocking_signal", "last_attempt", F.concat(F.lit("waits on "), what, F.lit(" raised at "), F.col("raised_at").cast("string"), F.lit(" in session "), "session_id").alias("claim"), F.when(F.col("full"), 0.85).otherwise(0.65).alias("confidence"), F.array("blocking_signal").alias("evidence"), "updated_at")
    members = units.select("work_unit_id", F.explode("attempts").alias("attempt_id")).join(projection.attempts, "attempt_id")
    newest = Window.partitionBy("work_unit_id").orderBy(F.desc("started_at"), F.desc("turn_index"), F.desc("attempt_index"))
    last = members.withColumn("n", F.row_number().over(newest)).where("n <= 2").join(projection.sessions.select("session_id", (F.col("coverage") == "full").alias("full")), "session_id")
    failed = F.col("outcome").isin("failed", "superseded") & F.col("ended_at").isNotNull() & F.col("failure_class").isNotNull()
    twice = last.groupBy("work_unit_id").agg(F.count_if(failed).alias("failed"), F.countDistinct("failure_class").alias("classes"), F.min("failure_class").alias("failure_class"), F.min("full").alias("full"), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("cited"), F.array_sort(F.collect_list("attempt_id")).alias("two")).where("failed = 2 and classes = 1")
    repeated = units.where("blocking_signal is null").join(twice, "work_unit_id").select("work_unit_id", "project_name", "phase", "status", "blocking_signal", "last_attempt", F.concat(F.lit("repeats itself: its last two attempts ("), F.array_join("two", " and "), F.lit(") both failed with "), "failure_class").alias("claim"), F.when(F.col("full"), 0.7).otherwise(0.5).alias("confidence"), F.col("cited").alias("evidence"), "updated_at")
    return waiting.unionByName(repeated)


def cited(projection, subject: str) -> DataFrame:
    """event_id: what a session, turn, call, attempt, work unit, commit, signal, hand-off, decision, conflict or edge rests on."""
    ids = projection.events.where(F.col("event_id") == subject).select("event_id")
    for table, keys in (("sessions", ["session_id"]), ("turns", ["turn_id"]), ("tool_calls", ["tool_call_id"]), ("attempts", ["attempt_id"]), ("work_units", ["work_unit_id"]), ("commits", ["commit_id"]), ("signals", ["event_id"]), ("handoffs", ["to_turn", "to_session"]), ("decisions", ["decision_id"]), ("conflicts", ["conflict_id"])):
        rows = projection.table(table)
        named = F.lit(False)
        for key in keys:
            named = named | (F.col(key) == subject)
        own = rows.where(named).select(F.explode("evidence").alias("event_id"))
        if table == "work_units":  # a unit cites turns; their events stand for them
            own = projection.turns.join(own.withColumnRenamed("event_id", "turn_id"), "turn_id").select(F.explode("evidence").alias("event_id"))
        ids = ids.unionByName(own)
    return ids.distinct()


def evidence(projection, ids: DataFrame) -> DataFrame:
    """The events of ``ids``, retracted ones flagged."""
    return projection.events.join(ids, "event_id", "left_semi").select("event_id", "observed_at", "session_id", "kind", "tool_name", "outcome_status", "outcome_class", "retracted").orderBy("observed_at", "event_id")
