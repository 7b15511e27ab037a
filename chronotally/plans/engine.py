"""One object over a projection: plain read-only SQL and statements, guarded and bounded."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ids
from ..functions.times import parse_time
from ..operators import graph, temporal
from ..operators.meta import masked
from .guard import GuardError, ReadOnly, check_size
from .projection import Projection
from .statements import Statement, StatementError, is_statement, parse

# fixed values
ALIASES = {"claude": "claude_code", "claude-code": "claude_code", "codex-cli": "codex", "gemini": "gemini_cli", "gemini-cli": "gemini_cli"}
TIME_COLUMN = {"attempts": "started_at", "sessions": "started_at", "turns": "started_at", "tool_calls": "at", "handoffs": "handoff_at", "work_units": "started_at", "decisions": "decided_at", "commits": "committed_at", "signals": "raised_at", "corrections": "corrected_at", "retractions": "retracted_at", "events": "observed_at", "conflicts": "started_at"}
OUTCOME = {"attempts": "outcome", "sessions": "state", "turns": "status", "tool_calls": "outcome_status", "work_units": "status", "corrections": "outcome"}
STATUS = OUTCOME | {"corrections": "status"}
DEFAULT_ORDER = {table: (column, False) for table, column in TIME_COLUMN.items()} | {"edges": ("edge_kind", True)}
#: Kinds of subjects: the prefix of their ids, their table and its key, in the order in which a bare id is looked up.
SUBJECTS = {"attempt": ("att_", "attempts", "attempt_id"), "session": ("ses_", "sessions", "session_id"), "turn": ("trn_", "turns", "turn_id"), "tool_call": ("spn_", "tool_calls", "tool_call_id"), "work_unit": ("wu_", "work_units", "work_unit_id"), "event": ("ev_", "events", "event_id")}
RECENT_S = 15 * 60
PHASES = ("explore", "plan", "implement", "debug", "verify", "review", "deliver", "blocked")
@dataclass
class Result:
    df: DataFrame
    kind: str = "rows"
    notes: list[str] = field(default_factory=list)
    truncated: bool = False


def glob(pattern: str) -> str:
    """A path pattern as a regular expression: * and % stand for any run of characters, anchored."""
    return "^" + "".join(".*" if c in "*%" else re.escape(c) for c in pattern) + "$"


class Engine:
    def __init__(self, spark: SparkSession, projection: Projection, max_rows: int = 10_000):
        self.spark, self.projection, self.max_rows = spark, projection, max_rows

    @property
    def now(self) -> datetime:
        at = self.spark.range(1).select(F.unix_micros(self.projection.now)).first()[0]
        return datetime.fromtimestamp(at / 1e6, timezone.utc)

    def tables(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in Projection.TABLES], "table_name string")

    def columns(self, table: str) -> DataFrame:
        df = self.table(table)
        return self.spark.createDataFrame([(table, k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema.fields)], "table_name string, ordinal int, column_name string, data_type string")

    def table(self, name: str, show_retracted: bool = True) -> DataFrame:
        df = self.projection.flagged(name)
        if "retracted" in df.columns:
            df = masked(df, name, F.col("retracted"))
            if not show_retracted:
                df = df.where("not retracted")
        return df

    def register(self, prefix: str = "") -> None:
        """Temp views of all tables, text of retracted rows masked."""
        for name in Projection.TABLES:
            self.table(name).createOrReplaceTempView(prefix + name)

    def query(self, text: str) -> Result:
        check_size(text)
        if is_statement(text):
            return self.run(parse(text))
        about = re.fullmatch(r"\s*(?:show\s+columns\s+(?:from|in)|describe(?:\s+table)?|desc)\s+`?(\w+)`?\s*;?\s*", text, re.I)
        if about or re.fullmatch(r"\s*show\s+tables\s*;?\s*", text, re.I):
            if about and about[1].lower() not in Projection.TABLES:
                raise StatementError(f"unknown table {about[1]}")
            return Result(self.columns(about[1].lower()) if about else self.tables())
        plan = re.match(r"\s*explain(?:\s+extended)?\s+", text, re.I)
        if plan:
            return self._explained(self.query(text[plan.end() :]), text[plan.end() :])
        for name in ReadOnly(self.spark, Projection.TABLES).statement(text):
            self.table(name).createOrReplaceTempView(name)
        return self._bounded(self.spark.sql(text.strip().rstrip(";")))

    def _bounded(self, df: DataFrame) -> Result:
        return Result(df.limit(self.max_rows + 1))

    def fetch(self, text: str, timeout_s: float = 20.0, max_bytes: int = 256 * 1024) -> tuple[list, Result]:
        """The rows of a statement within its row, byte and time budget; ``truncated`` and a note say what was cut. A late statement is cancelled."""
        result = self.query(text)
        context, tag, late = self.spark.sparkContext, f"fetch-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout_s, stop)
        context.addJobTag(tag)
        timer.start()
        rows, size = [], 0
        try:
            for row in result.df.toLocalIterator():
                size += len(str(row))
                if len(rows) == self.max_rows or size > max_bytes:
                    result.truncated = True
                    result.notes.append(f"cut at {len(rows)} rows, {self.max_rows} or {max_bytes} bytes are the most")
                    break
                rows.append(row)
        except Exception as error:
            if late.is_set():
                raise GuardError(f"the statement took longer than {timeout_s:g} s") from error
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        return rows, result

    def _explained(self, inner: Result, text: str) -> Result:
        plan = inner.df._jdf.queryExecution().toString()
        return Result(self.spark.createDataFrame([("logical and physical", plan)], "plan_type string, plan string"), "explanation", [f"explained: {text}"])

    def resolve(self, kind: str, name: str) -> str:
        """The full id of a subject, given whole or by its first characters, with or without its prefix."""
        prefix, table, key = SUBJECTS[kind]
        rows = self.projection.table(table)
        for text in dict.fromkeys((name, name.removeprefix(prefix))):
            try:
                return ids.resolve(rows, key, text)
            except LookupError as error:
                if "ambiguous" in str(error):
                    raise StatementError(str(error)) from error
            except ValueError as error:
                raise StatementError(str(error)) from error
        raise StatementError(f"unknown {kind.replace('_', ' ')} {name!r}")

    def endpoint(self, name: str) -> str:
        """The node of the causal graph that an id names: by its prefix, or the first kind that knows it."""
        for kind, (prefix, _, _) in SUBJECTS.items():
            if name.startswith(prefix):
                return self.resolve(kind, name)
        for kind in SUBJECTS:
            try:
                return self.resolve(kind, name)
            except StatementError as error:
                if "ambiguous" in str(error):
                    raise
        raise StatementError(f"{name!r} is no attempt, session, turn, tool call, work unit or event")

    def projects(self, name: str) -> list[str]:
        names = self.projection.sessions.select("project_id", "project_name").distinct()
        found = [r[0] for r in names.where((F.col("project_id") == name) | (F.lower("project_name") == name.lower())).limit(100).collect()]
        if not found:
            known = [r[0] for r in names.select("project_name").where("project_name is not null").distinct().orderBy("project_name").limit(10).collect()]
            raise StatementError(f"unknown project {name!r}; known ones: {', '.join(known)}")
        return found

    def _scope(self, s: Statement) -> dict:
        """What a subject keeps: sessions of projects, one session, or one work unit."""
        kind, name = s.subject if s.subject else (None, None)
        if kind is None:
            return {}
        if kind == "project":
            return {"projects": self.projects(name)}
        if kind in ("session", "work_unit"):
            return {kind: self.resolve(kind, name)}
        raise StatementError(f"{s.verb.replace('_', ' ').upper()} needs a project, session or work unit, not {kind.replace('_', ' ')}")

    def run(self, s: Statement) -> Result:
        p = self.projection
        if s.verb == "explain":
            return self._explained(self.query(s.inner), s.inner)
        if s.verb == "show":
            return self._show(s)
        if s.verb == "trace":
            found, truncated = graph.trace(p.edges, self.endpoint(s.subject[1]), s.depth, s.direction)
            return Result(found.orderBy("depth", "edge_kind", "from_id", "to_id"), "explanation", ["more lies beyond the depth"] if truncated else [], truncated)
        if s.verb == "why" and s.kind == "failed":
            if s.subject[0] != "attempt":
                raise StatementError(f"WHY … FAILED needs an attempt, not {s.subject[0].replace('_', ' ')}")
            return Result(temporal.why_failed(p, self.resolve("attempt", s.subject[1])), "explanation")
        scope = self._scope(s)
        if s.verb == "why":
            if "work_unit" in scope:
                return self._why_unit(scope["work_unit"])
            return Result(temporal.why_blocked(p, self.now, **scope), "explanation", ["blocked: a request that nobody answered, or the last two attempts failed alike"])
        newest = [F.desc("last_activity_at"), F.col("subject_id")]
        if s.verb == "state":
            return Result(temporal.snapshot(p, parse_time(s.times[0], self.now), **scope).orderBy(*newest))
        if s.verb == "diff":
            a, b = (parse_time(t, self.now) for t in s.times)
            if a >= b:
                raise StatementError("the first time must be before the second")
            return Result(temporal.diff_snapshots(temporal.snapshot(p, a, **scope), temporal.snapshot(p, b, **scope)).orderBy("subject", "field"))
        rows = temporal.snapshot(p, self.now, **scope)
        since = F.lit(self.now).cast("timestamp") - F.expr(f"interval {RECENT_S} seconds")
        active = [r[0] for r in rows.where((F.col("subject_type") == "session") & F.col("is_open") & (F.col("last_activity_at") >= since)).select("subject_id").orderBy("subject_id").limit(20).collect()]
        return Result(rows.orderBy(*newest), notes=[f"active in the last {RECENT_S // 60} minutes: {', '.join(active) if active else 'none'}"])

    def _why_unit(self, unit: str) -> Result:
        rows = temporal.why_unit_blocked(self.projection, unit)
        if not rows.isEmpty():
            return Result(rows, "explanation")
        own = self.projection.work_units.where(F.col("work_unit_id") == unit).select("phase", "status", "phase_reason", "status_reason").first()
        return Result(rows, "explanation", [f"work unit {unit} is not blocked: phase {own.phase}, status {own.status}", f"phase: {own.phase_reason}; status: {own.status_reason}"])

    def _show(self, s: Statement) -> Result:
        if s.target == "evidence":
            return self._evidence(s.subject[1])
        df, notes = self.table(s.target), []
        if s.kind == "failed":
            df = df.where(F.col("outcome").isin("failed", "superseded"))
        elif s.kind == "superseded":
            df = df.where("superseded_by is not null")
        if s.between:
            a, b = (ALIASES.get(x, x) for x in s.between)
            df = df.where(((F.col("from_provider") == a) & (F.col("to_provider") == b)) | ((F.col("from_provider") == b) & (F.col("to_provider") == a)))
        for key, value in s.filters:
            df = df.where(self._filter(s.target, key, value, df.columns))
        if s.where:
            df = df.where(self._expression(s.where))
        if "retracted" in df.columns and not s.retracted:
            if self.projection.stats.meta:
                hidden = df.where("retracted").count()
                notes += [f"{hidden} retracted rows are hidden"] if hidden else []
            df = df.where("not retracted")
        column, up = s.order or DEFAULT_ORDER[s.target]
        if column not in df.columns:
            raise StatementError(f"{s.target} has no column {column}")
        tie = next((c for c in df.columns if c.endswith("_id")), df.columns[0])
        own = F.col(column)
        df = df.orderBy(own.asc_nulls_last() if up else own.desc_nulls_last(), tie)
        return Result(df, notes=notes) if s.limit is None else Result(df.limit(s.limit), notes=[*notes, f"first {s.limit} rows"])

    def _evidence(self, name: str) -> Result:
        subject = name
        for table, key in (("handoffs", "to_turn"), ("decisions", "decision_id"), ("conflicts", "conflict_id"), ("commits", "commit_id"), ("signals", "event_id")):
            if not self.projection.table(table).where(F.col(key) == name).isEmpty():
                break
        else:
            subject = self.endpoint(name)
        cited = temporal.cited(self.projection, subject)
        found = temporal.evidence(self.projection, cited)
        missing = [r[0] for r in cited.join(self.projection.events.select("event_id"), "event_id", "left_anti").orderBy("event_id").limit(10).collect()]
        return Result(found, notes=[f"events that are not loaded: {', '.join(missing)}"] if missing else [])

    def _expression(self, text: str) -> Column:
        """Exactly one expression; text that closes a bracket or adds a clause doesn't parse."""
        ReadOnly(self.spark, Projection.TABLES).expression(text)
        return F.expr(text)

    def _filter(self, table: str, key: str, value: str, columns: list[str]) -> Column:
        def need(name: str | None) -> Column:
            if name is None or name not in columns:
                raise StatementError(f"{table} can't be filtered by {key}")
            return F.col(name)

        if key == "project":
            return need("project_id").isin(*self.projects(value))
        if key in ("since", "until"):
            at = F.lit(parse_time(value, self.now))
            own = need(TIME_COLUMN.get(table))
            return own >= at if key == "since" else own <= at
        if key in ("session", "turn"):
            if table == "handoffs":
                return (F.col(f"from_{key}") == value) | (F.col(f"to_{key}") == value)
            if table == "edges":
                return (F.col("from_id") == value) | (F.col("to_id") == value)
            if table == "work_units":
                return F.array_contains(f"{key}s", value)
            if table == "retractions":
                raise StatementError(f"{table} can't be filtered by {key}")
            return need(f"{key}_id") == value
        if key in ("provider", "agent"):
            if value.startswith("agt_") or (key == "agent" and table in ("sessions", "tool_calls") and value not in ALIASES and value not in ALIASES.values()):
                return F.array_contains(need("agents"), value) if table == "sessions" else need("agent_id") == value
            name = ALIASES.get(value.lower(), value.lower().replace("-", "_"))
            if table == "handoffs":
                return (F.col("from_provider") == name) | (F.col("to_provider") == name)
            if table == "work_units":
                return F.array_contains("actors", name)
            return need("provider") == name
        if key == "path":
            rx = glob(value)
            return F.exists(need("shared_paths" if table == "handoffs" else "paths"), lambda p: p.rlike(rx))
        if key in ("outcome", "status"):
            return need((OUTCOME if key == "outcome" else STATUS).get(table)) == value.lower()
        if key == "phase":
            if value.lower() not in PHASES:
                raise StatementError(f"unknown phase {value!r}")
            return need("phase") == value.lower()
        return F.lower(need("tool_name")) == value.lower()
