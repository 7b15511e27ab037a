"""All tables of an event stream, each derived once, on first use.

Order of stages: corrections and retractions are taken from the stream first; retracted sessions and events never reach the
session stage; then sessions, turns, calls, attempts, signals and commits; hand-offs; retraction of attempts and corrections; work units,
decisions, conflicts and edges.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import meta, project_stage, session_stage
from ..operators.events import META, conform, once, sequenced
from ..operators.project_stage import Rules
from ..operators.tables import written


class Projection:
    def __init__(self, events: DataFrame, as_of: datetime | None = None, rules: Rules = Rules(), until: datetime | None = None):
        """as_of: the time of judgement, the last event's by default; until: leaves later events out."""
        self._tables: dict[str, DataFrame] = {}
        delivered = conform(events)
        self.delivered = delivered if until is None else delivered.where(F.col("observed_at") <= F.lit(until))
        self._as_of, self.rules = as_of or until, rules

    def _together(self, *names: str) -> None:
        """Tables that don't wait for each other are derived at the same time."""
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(lambda name: getattr(self, name), names))

    @cached_property
    def stats(self):
        """One pass over four columns: the clock in use, whether there are events about events and starts of calls, the last time."""
        return self.delivered.agg(F.min("hlc").alias("hlc"), F.count_if(F.col("kind").isin(*META)).alias("meta"), F.count_if(F.col("kind") == "tool_call_started").alias("starts"), F.max("observed_at").alias("last")).first()

    @cached_property
    def all_events(self) -> DataFrame:
        # telemetry without a meaning of its own never takes part
        telemetry = (F.col("kind") == "unknown") & (F.coalesce(F.try_element_at("attrs", F.lit("source")), F.lit("")) == "otel")
        rows = once(self.delivered.where(~telemetry))
        return written(rows, "events") if self.stats.meta else rows

    @cached_property
    def now(self) -> Column:
        return F.lit(self._as_of or self.stats.last).cast("timestamp")

    @cached_property
    def meta_events(self) -> DataFrame:
        return self.all_events.where(F.col("kind").isin(*META))

    @cached_property
    def retracted_ids(self) -> DataFrame:
        return written(meta.retracted_events(self.all_events), "retracted")

    def _staged(self, name: str, make) -> DataFrame:
        """A table that several others read, written once; ``make`` gives its plan."""
        if name not in self._tables:
            self._tables[name] = written(make(), name)
        return self._tables[name]

    def _facts_plan(self) -> DataFrame:
        if "facts" in self._tables:
            return self._tables["facts"]
        live = self.all_events
        if self.stats.meta:
            live = live.where(~F.col("kind").isin(*META)).join(self.retracted_ids.select("event_id"), "event_id", "left_anti")
        order = ["observed_at", "hlc", "source_seq", "event_id"] if self.stats.hlc else ["observed_at", "captured_at", "event_id"]
        return session_stage.with_turns(sequenced(live, order))

    @property
    def facts(self) -> DataFrame:
        """Live events in order with their turns, dealt by session once; staged, as several tables read them."""
        return self._staged("facts", self._facts_plan)

    @cached_property
    def events(self) -> DataFrame:
        if not self.stats.meta:
            return self.all_events.withColumn("retracted", F.lit(False))
        return self.all_events.join(self.retracted_ids.select("event_id", F.lit(True).alias("retracted")), "event_id", "left").withColumn("retracted", F.coalesce("retracted", F.lit(False)))

    # A table read alone is a plan on its inputs; tables that the next stages read more than once are staged by them.

    @property
    def sessions(self) -> DataFrame:
        return self._tables.get("sessions") or session_stage.sessions(self._facts_plan(), self.now)

    def _turns_plan(self) -> DataFrame:
        rows = session_stage.turns(self.facts, self._staged("sessions", lambda: session_stage.sessions(self.facts, self.now)))
        if self.stats.meta:
            return meta.correct_turns(rows, self.meta_events)
        none = {c: F.lit(None).cast("string") for c in ("corrected_by", "inferred_objective")}
        return rows.withColumns(none | {"corrected_at": F.lit(None).cast("timestamp")})

    @property
    def turns(self) -> DataFrame:
        return self._tables.get("turns") or self._turns_plan()

    def _calls_plan(self) -> DataFrame:
        rows = session_stage.tool_calls(self._facts_plan(), bool(self.stats.starts)).withColumn("turn_id", F.when(F.col("turn_index").isNotNull(), session_stage.turn_id()))
        return meta.without_calls(rows, self._retracted_attempts) if self.stats.meta else rows

    @property
    def tool_calls(self) -> DataFrame:
        return self._tables.get("calls") or self._calls_plan()

    @cached_property
    def _base(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Sessions, turns and calls, staged for the stages that read them more than once."""
        _ = self.facts, self.now
        with ThreadPoolExecutor(2) as pool:
            calls = pool.submit(lambda: self._staged("calls", self._calls_plan))
            sessions = self._staged("sessions", lambda: session_stage.sessions(self.facts, self.now))
            turns = self._staged("turns", self._turns_plan)
            return sessions, turns, calls.result()

    @cached_property
    def _raw_calls(self) -> DataFrame:
        """Calls of retracted attempts included."""
        return session_stage.tool_calls(self._facts_plan(), bool(self.stats.starts))

    @cached_property
    def _first_attempts(self) -> DataFrame:
        _ = self.facts
        sessions = session_stage.sessions(self.facts, self.now) if "sessions" not in self._tables else self._tables["sessions"]
        calls = self._raw_calls if self.stats.meta else self.tool_calls
        turns = self._tables.get("turns")
        if turns is None:
            turns = session_stage.turns(self.facts, sessions)
            turns = meta.correct_turns(turns, self.meta_events) if self.stats.meta else turns
        return self._staged("first_attempts", lambda: session_stage.attempts(calls, turns, sessions))

    @cached_property
    def _retracted_attempts(self) -> DataFrame:
        """Attempts that a retraction names, with what they hold."""
        return meta.named_attempts(self._first_attempts, self.meta_events)

    @property
    def supersessions(self) -> DataFrame:
        return self._tables.get("links") or session_stage.supersession(self._first_attempts)

    @cached_property
    def attempts(self) -> DataFrame:
        rows = session_stage.superseded(self._first_attempts, self.supersessions)
        if not self.stats.meta:
            none = {c: F.lit(None).cast("string") for c in ("note", "inferred_outcome", "inferred_failure_class", "correction_type", "corrected_by")}
            return rows.withColumns(none | {"corrected_at": F.lit(None).cast("timestamp")})
        return self._staged("attempts", lambda: meta.correct_attempts(meta.retract_attempts(rows, self.meta_events), self.meta_events))

    @cached_property
    def signals(self) -> DataFrame:
        return self._staged("signals", lambda: session_stage.signals(self._facts_plan()))

    @cached_property
    def commits(self) -> DataFrame:
        return session_stage.commits(self.facts, self._base[2])

    @cached_property
    def handoffs(self) -> DataFrame:
        sessions, turns, calls = self._base
        rows = project_stage.handoffs(turns, sessions, calls, self.rules)
        return self._staged("handoffs", lambda: meta.without_handoffs(rows, self._retracted_attempts) if self.stats.meta else rows)

    @cached_property
    def _units(self) -> tuple[DataFrame, DataFrame]:
        sessions, turns, calls = self._base
        _ = self._first_attempts
        self._together("handoffs", "signals")
        members = self._staged("members", lambda: project_stage.unit_members(turns, sessions, calls, self.handoffs, self.rules))
        return project_stage.work_units(members, turns, self.attempts, calls, self.signals, self.commits, self.now, self.rules), members

    @property
    def work_units(self) -> DataFrame:
        return self._units[0]

    @property
    def members(self) -> DataFrame:
        return self._units[1]

    @cached_property
    def decisions(self) -> DataFrame:
        return project_stage.decisions(self.facts, self._staged("all_attempts", lambda: self.attempts), self._base[2], self.members)

    @cached_property
    def conflicts(self) -> DataFrame:
        return project_stage.conflicts(self.work_units, self.members, self._base[2], self.commits, self.rules)

    @cached_property
    def edges(self) -> DataFrame:
        _, turns, calls = self._base
        members = self.members
        return project_stage.edges(turns, calls, self.attempts, self._staged("links", lambda: self.supersessions), self.handoffs, members, self.signals)

    @cached_property
    def attention(self) -> DataFrame:
        return project_stage.attention(self._base[0], self.signals, self.work_units, self.attempts, self.members, self.conflicts)

    @cached_property
    def corrections(self) -> DataFrame:
        return meta.corrections(self.meta_events, self._first_attempts, self.turns)

    @cached_property
    def retractions(self) -> DataFrame:
        return meta.retractions(self.all_events)

    @cached_property
    def hidden(self) -> "Projection":
        """The retracted sessions, projected on their own and judged at the same time."""
        sessions = meta.retracted_sessions(self.meta_events)
        rows = self.all_events.where(~F.col("kind").isin(*META)).join(sessions, "session_id", "left_semi")
        return Projection(rows, self._as_of or self.stats.last, self.rules)

    def flagged(self, name: str) -> DataFrame:
        """A table with ``retracted`` where rows can be: live rows, and those of retracted sessions and attempts."""
        rows = self.table(name)
        if name not in ("sessions", "turns", "tool_calls", "attempts"):
            return rows
        live = rows.withColumn("retracted", F.lit(False))
        if not self.stats.meta:
            return live
        gone = self.hidden.table(name)
        out = live.unionByName(gone.withColumn("retracted", F.lit(True)), allowMissingColumns=True)
        if name == "attempts":
            named = self._first_attempts.join(self._retracted_attempts.select("attempt_id"), "attempt_id", "left_semi")
            out = out.unionByName(named.withColumn("retracted", F.lit(True)), allowMissingColumns=True)
        if name == "tool_calls":
            calls = self._raw_calls.join(self._retracted_attempts.select(F.explode("tool_call_ids").alias("tool_call_id")).distinct(), "tool_call_id", "left_semi")
            out = out.unionByName(calls.withColumn("retracted", F.lit(True)), allowMissingColumns=True)
        return out

    TABLES = ("events", "sessions", "turns", "tool_calls", "attempts", "handoffs", "edges", "signals", "work_units", "commits", "decisions", "corrections", "retractions", "conflicts")

    def table(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise KeyError(name)
        return getattr(self, name)
