"""Queries over the event stream derived from the ``events`` table, with DuckDB texts that derive the same from the raw table.

Times are microseconds since the epoch; lists are joined text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import events as E, graph, project_stage, temporal
from ..operators.events import scan
from ..operators.project_stage import Rules
from ..sources import store
from ..sources.driver import driver_events
from ..sources.records import conversations
from ..streaming import refresh
from .engine import Engine
from .projection import Projection

#: The derived stream is sparse, so links between turns reach further than in a live one, and every turn is a span of hand-offs, as in their SQL:
#: also one whose session holds a stop alone.
RULES = Rules(turn_link_s=24 * 3600, path_link_s=48 * 3600, handoff_shared_s=12 * 3600, handoff_quick_s=3600, handoff_active_only=False)
AT, BEFORE = datetime(2024, 1, 20, tzinfo=timezone.utc), datetime(2024, 1, 15, tzinfo=timezone.utc)


def us(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def projection(spark: SparkSession, sf_dir: str) -> Projection:
    return Projection(driver_events(spark, sf_dir), rules=RULES)


PRELUDE = """
WITH RECURSIVE raw AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events),
cut AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS c FROM raw),
typed AS (SELECT *, event_type = 'purchase' OR (event_type = 'error' AND k % 2 = 0) AS is_edit, event_type = 'click' OR (event_type = 'error' AND k % 2 = 1) AS is_shell, event_type = 'view' AND k % 4 <> 0 AS is_read, event_type = 'click' AND k % 10 = 7 AS is_commit, 1 + sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM cut),
ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS t, ['claude_code','codex','cursor','gemini_cli'][CAST(user_id % 4 + 1 AS INTEGER)] AS provider, 'p' || CAST(user_id // 4 AS BIGINT) AS project_id, 'u' || user_id || '-' || CAST(n AS BIGINT) AS session_id, 'd' || CAST(user_id % 3 AS BIGINT) AS device_id,
  CASE WHEN event_type = 'signup' THEN 'prompt_submitted' WHEN event_type = 'error' THEN 'tool_call_failed' WHEN event_type = 'view' AND NOT is_read THEN 'turn_stopped' ELSE 'tool_call_finished' END AS kind,
  CASE WHEN is_edit THEN 'Edit' WHEN is_shell THEN 'Bash' WHEN is_read THEN 'Read' END AS tool_name, CASE WHEN is_edit THEN 'file_edit' WHEN is_shell THEN 'shell' WHEN is_read THEN 'file_read' END AS tool_category,
  CASE WHEN is_edit THEN 'src/f' || CAST(k % 20 AS VARCHAR) || '.rs' END AS path, CASE WHEN event_type = 'error' THEN 'failure' WHEN is_edit OR is_shell OR is_read THEN 'success' END AS outcome_status, CASE WHEN is_shell AND NOT is_commit AND k % 3 = 0 THEN 'test' END AS command_category,
  CASE WHEN is_commit THEN 'commit' END AS git_subcommand, CASE WHEN is_edit OR is_shell OR is_read THEN CAST(floor(value) AS BIGINT) END AS duration_ms, CASE WHEN event_type = 'signup' THEN 'do ' || CAST(k AS VARCHAR) END AS prompt, CASE WHEN event_type = 'purchase' THEN CAST(k AS BIGINT) END AS lines_added FROM typed),
facts AS (SELECT *, CASE WHEN works > 0 THEN CAST(prompts AS BIGINT) END AS turn_index FROM (SELECT *, row_number() OVER s AS seq, sum(CASE WHEN kind = 'prompt_submitted' THEN 1 ELSE 0 END) OVER s AS prompts, count(*) OVER s AS works FROM ev WINDOW s AS (PARTITION BY session_id ORDER BY t, event_id))),
as_of AS (SELECT max(t) AS now FROM ev),
sess AS (SELECT session_id, any_value(provider) AS provider, any_value(project_id) AS project_id, min(t) AS started_at, max(t) AS last_event_at, count(*) AS event_count, count(DISTINCT turn_index) AS turn_count, sum(CASE WHEN kind = 'prompt_submitted' THEN 1 ELSE 0 END) AS prompt_count, sum(CASE WHEN kind LIKE 'tool%' THEN 1 ELSE 0 END) AS tool_call_count, sum(CASE WHEN kind = 'tool_call_failed' THEN 1 ELSE 0 END) AS failure_count, arg_min(event_id, seq) AS first_event_id, arg_max(event_id, seq) AS last_event_id, arg_max(kind, seq) AS last_kind FROM facts GROUP BY session_id),
sessions AS (SELECT s.*, CASE WHEN (now - last_event_at) / 1e6 > CASE WHEN last_kind = 'turn_stopped' THEN 43200 ELSE 1800 END THEN 'stale' ELSE 'open' END AS state, CASE WHEN prompt_count > 0 OR tool_call_count > 0 THEN 'minimal' ELSE 'unknown' END AS coverage FROM sess s, as_of),
turn0 AS (SELECT session_id, turn_index, any_value(provider) AS provider, any_value(project_id) AS project_id, min(t) AS started_at, max(t) AS last_event_at, max(CASE WHEN kind = 'turn_stopped' THEN t END) AS stopped_at, arg_max(CASE WHEN kind = 'turn_stopped' THEN event_id END, CASE WHEN kind = 'turn_stopped' THEN seq END) AS stop_event_id, min(CASE WHEN kind = 'prompt_submitted' THEN event_id END) AS prompt_event_id, min(CASE WHEN kind = 'prompt_submitted' THEN prompt END) AS objective, sum(CASE WHEN kind LIKE 'tool%' THEN 1 ELSE 0 END) AS tool_call_count, arg_min(event_id, seq) AS first_event_id, arg_max(event_id, seq) AS last_event_id FROM facts WHERE turn_index IS NOT NULL GROUP BY session_id, turn_index),
turns AS (SELECT *, CASE WHEN stopped_at IS NOT NULL THEN 'completed' WHEN next_at IS NOT NULL THEN 'unknown' ELSE 'in_progress' END AS status, coalesce(stopped_at, next_at) AS ended_at FROM (SELECT *, lead(started_at) OVER (PARTITION BY session_id ORDER BY turn_index) AS next_at FROM turn0)),
calls AS (SELECT *, t AS at, coalesce(tool_category = 'file_edit', false) AS is_edit, (tool_category = 'file_edit' AND outcome_status = 'failure') OR (tool_category = 'shell' AND coalesce(command_category, '') = 'test' AND outcome_status = 'failure') AS hard, tool_category = 'shell' AND outcome_status = 'failure' AS soft, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY seq) AS n FROM facts WHERE kind LIKE 'tool%' AND turn_index IS NOT NULL),
walk AS (SELECT session_id, turn_index, n, event_id, 0 AS g, is_edit AS had, hard AS failed FROM calls WHERE n = 1
  UNION ALL SELECT c.session_id, c.turn_index, c.n, c.event_id, w.g + CASE WHEN w.failed THEN 1 ELSE 0 END, c.is_edit OR (NOT w.failed AND w.had), c.hard OR (c.soft AND NOT w.failed AND w.had) FROM walk w JOIN calls c ON c.session_id = w.session_id AND c.turn_index = w.turn_index AND c.n = w.n + 1),
grouped AS (SELECT c.session_id, c.turn_index, w.g, min(c.t) AS first_at, max(c.t) AS last_at, bool_or(w.failed) AS failing, max(CASE WHEN w.failed THEN c.event_id END) AS fail_event_id, max(CASE WHEN w.failed THEN c.command_category END) AS failed_check, arg_max(CASE WHEN command_category = 'test' THEN CASE WHEN outcome_status = 'failure' THEN 'failed' ELSE 'passed' END END, CASE WHEN command_category = 'test' THEN seq END) AS verification, bool_or(coalesce(command_category = 'test' AND outcome_status = 'success', false)) AS passed_test, count(*) AS tool_call_count, list_sort(list_distinct(list(c.path) FILTER (WHERE c.path IS NOT NULL))) AS edited, max(w.g) AS top, arg_min(c.event_id, c.seq) AS first_call_event FROM calls c JOIN walk w USING (session_id, turn_index, n) GROUP BY c.session_id, c.turn_index, w.g),
att0 AS (SELECT t.session_id, t.turn_index, t.provider, t.project_id, coalesce(g.g, 0) AS attempt_index, CASE WHEN coalesce(g.g, 0) = 0 THEN t.started_at ELSE g.first_at END AS started_at, CASE WHEN coalesce(g.failing, false) THEN g.last_at WHEN t.status <> 'in_progress' THEN t.ended_at END AS ended_at, coalesce(g.failing, false) AS failing, g.fail_event_id, g.failed_check, g.verification, coalesce(g.passed_test, false) AS passed_test, coalesce(g.tool_call_count, 0) AS tool_call_count, coalesce(g.edited, []) AS edited, t.status, t.stop_event_id, coalesce(g.g, 0) = max(coalesce(g.g, 0)) OVER (PARTITION BY t.session_id, t.turn_index) AS is_last, g.first_call_event FROM turns t LEFT JOIN grouped g ON g.session_id = t.session_id AND g.turn_index = t.turn_index),
att1 AS (SELECT *, CASE WHEN failing OR NOT is_last THEN 'failed' WHEN status = 'completed' THEN CASE WHEN tool_call_count > 0 THEN 'succeeded' ELSE 'unknown' END WHEN status = 'unknown' THEN 'abandoned' ELSE 'in_progress' END AS outcome0, CASE WHEN failing THEN 'failure' END AS failure_class, 0.4 AS confidence FROM att0),
links AS (SELECT * FROM (SELECT a.session_id, a.turn_index AS t1, a.attempt_index AS i1, b.turn_index AS t2, b.attempt_index AS i2, CASE WHEN len(list_intersect(a.edited, b.edited)) > 0 THEN 'same_edit' ELSE 'passed_check' END AS reason, row_number() OVER (PARTITION BY a.session_id, a.turn_index, a.attempt_index ORDER BY b.turn_index, b.attempt_index) AS rn FROM att1 a JOIN att1 b ON a.session_id = b.session_id AND ((b.turn_index = a.turn_index AND b.attempt_index > a.attempt_index) OR b.turn_index = a.turn_index + 1) WHERE a.outcome0 = 'failed' AND (len(list_intersect(a.edited, b.edited)) > 0 OR (a.failed_check = 'test' AND b.passed_test))) x WHERE rn = 1),
attempts AS (SELECT a.*, CASE WHEN l.t2 IS NOT NULL THEN 'superseded' ELSE outcome0 END AS outcome, l.t2, l.i2 FROM att1 a LEFT JOIN links l ON l.session_id = a.session_id AND l.t1 = a.turn_index AND l.i1 = a.attempt_index),
spans AS (SELECT t.project_id, t.session_id, t.provider, t.turn_index, t.ended_at, t.started_at AS begins, greatest(t.started_at, t.last_event_at) AS ends FROM turns t),
quiet AS (SELECT *, max(ends) OVER (PARTITION BY project_id ORDER BY begins, session_id, turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM spans),
givers AS (SELECT q.*, g.session_id AS g_session, g.provider AS g_provider, g.turn_index AS g_turn, g.ends AS g_ends, g.ended_at AS g_ended, row_number() OVER (PARTITION BY q.session_id, q.turn_index ORDER BY g.ends DESC, g.session_id DESC, g.turn_index DESC) AS rn FROM quiet q JOIN spans g ON g.project_id = q.project_id AND g.ends <= q.begins AND NOT (g.session_id = q.session_id AND g.turn_index = q.turn_index) AND (busy IS NULL OR busy <= q.begins)),
given AS (SELECT *, greatest((CAST(floor(begins / 1000) AS BIGINT) - CAST(floor((CASE WHEN g_ended <= begins AND g_ended > g_ends THEN g_ended ELSE g_ends END) / 1000) AS BIGINT)), 0) AS gap_ms FROM givers WHERE rn = 1 AND g_session <> session_id AND g_provider <> provider),
shared AS (SELECT g.session_id, g.turn_index, list_sort(list_distinct(list(a.path))) AS paths FROM given g JOIN calls a ON a.session_id = g.g_session AND a.is_edit AND a.t <= g.begins JOIN calls b ON b.session_id = g.session_id AND b.path = a.path AND b.t >= g.begins GROUP BY g.session_id, g.turn_index),
handoffs AS (SELECT g.*, coalesce(array_to_string(s.paths, ','), '') AS shared_paths, CASE WHEN s.paths IS NOT NULL AND gap_ms <= 43200000 THEN least(6 + CASE WHEN g_ended <= begins THEN 2 ELSE 0 END + CASE WHEN len(s.paths) >= 3 THEN 1 ELSE 0 END, 9) / 10 WHEN gap_ms <= 3600000 THEN 0.5 END AS confidence FROM given g LEFT JOIN shared s ON s.session_id = g.session_id AND s.turn_index = g.turn_index),
said AS (SELECT session_id, turn_index, g, concat_ws(' · ', CASE WHEN len(p) > 0 THEN 'edit ' || array_to_string(p[1:4], ', ') || CASE WHEN len(p) > 4 THEN ' +' || (len(p) - 4) || ' more' ELSE '' END END, CASE WHEN n_shell = 1 THEN 'shell' WHEN n_shell > 1 THEN 'shell ×' || n_shell END, CASE WHEN n_read = 1 THEN 'read' WHEN n_read > 1 THEN 'read ×' || n_read END) AS approach
  FROM (SELECT c.session_id, c.turn_index, w.g, coalesce(any_value(p.p), []) AS p, sum(CASE WHEN tool_category = 'shell' THEN 1 ELSE 0 END) AS n_shell, sum(CASE WHEN tool_category = 'file_read' THEN 1 ELSE 0 END) AS n_read FROM calls c JOIN walk w USING (session_id, turn_index, n) LEFT JOIN (SELECT session_id, turn_index, g, list(path ORDER BY first_n) AS p FROM (SELECT c.session_id, c.turn_index, w.g, c.path, min(c.n) AS first_n FROM calls c JOIN walk w USING (session_id, turn_index, n) WHERE c.path IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) p ON p.session_id = c.session_id AND p.turn_index = c.turn_index AND p.g = w.g GROUP BY 1, 2, 3)),
named AS (SELECT a.*, 'trn_' || a.session_id || '/' || a.turn_index AS turn_id, coalesce(d.approach, 'no tool calls') AS approach, 'att_' || a.session_id || '/' || CASE WHEN a.failing THEN 'fail/' || a.fail_event_id WHEN a.first_call_event IS NOT NULL THEN 'act/' || a.first_call_event ELSE 'turn/' || coalesce(t.prompt_event_id, t.first_event_id) END AS attempt_id
  FROM attempts a JOIN turns t ON t.session_id = a.session_id AND t.turn_index = a.turn_index LEFT JOIN said d ON d.session_id = a.session_id AND d.turn_index = a.turn_index AND d.g = a.attempt_index)
"""

#: Work units: components of turns, their members, and the units; after PRELUDE.
UNITS = """, edited AS (SELECT c.project_id, c.path, c.session_id, c.turn_index, min(c.t) AS first_at, max(c.t) AS last_at FROM calls c WHERE c.is_edit AND NOT EXISTS (SELECT 1 FROM (SELECT project_id, path, count(DISTINCT session_id) AS s FROM calls WHERE is_edit GROUP BY 1, 2) h JOIN (SELECT project_id, count(*) AS ps FROM sessions GROUP BY 1) q USING (project_id) WHERE h.project_id = c.project_id AND h.path = c.path AND s >= 5 AND s >= 0.25 * ps) GROUP BY 1, 2, 3, 4),
placed AS (SELECT e.*, t.started_at AS b, greatest(t.started_at, t.last_event_at) AS e, row_number() OVER (PARTITION BY e.project_id, e.path ORDER BY first_at, e.session_id, e.turn_index) AS rn FROM edited e JOIN turns t ON t.session_id = e.session_id AND t.turn_index = e.turn_index),
best AS (SELECT * FROM (SELECT y.session_id AS s2, y.turn_index AS t2, x.session_id AS s1, x.turn_index AS t1, row_number() OVER (PARTITION BY y.project_id, y.path, y.session_id, y.turn_index ORDER BY (x.session_id = y.session_id) DESC, x.last_at DESC, 'trn_' || x.session_id || '/' || x.turn_index DESC) AS r FROM placed y JOIN placed x ON x.project_id = y.project_id AND x.path = y.path AND x.rn < y.rn AND x.rn >= y.rn - 32 WHERE (x.session_id = y.session_id OR x.e < y.b OR x.b > y.e) AND y.first_at - x.last_at <= 172800000000) WHERE r = 1),
pairs AS (SELECT 'trn_' || s1 || '/' || t1 AS a, 'trn_' || s2 || '/' || t2 AS b FROM best UNION SELECT 'trn_' || session_id || '/' || p, 'trn_' || session_id || '/' || turn_index FROM (SELECT session_id, turn_index, started_at, lag(turn_index) OVER w AS p, lag(ended_at) OVER w AS pe FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)) WHERE pe IS NOT NULL AND started_at - pe <= 86400000000 UNION SELECT 'trn_' || g_session || '/' || g_turn, 'trn_' || session_id || '/' || turn_index FROM handoffs WHERE confidence IS NOT NULL),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT 'trn_' || session_id || '/' || turn_index AS v, 'trn_' || session_id || '/' || turn_index AS r FROM turns UNION SELECT w.b, reach.r FROM reach JOIN both_ways w ON w.a = reach.v AND reach.r < w.b),
roots AS (SELECT v, min(r) AS root FROM reach GROUP BY v),
members AS (SELECT t.*, 'trn_' || t.session_id || '/' || t.turn_index AS turn_id, 'wu_' || first_value('trn_' || t.session_id || '/' || t.turn_index) OVER (PARTITION BY r.root ORDER BY t.started_at, t.turn_index, 'trn_' || t.session_id || '/' || t.turn_index) AS unit FROM turns t JOIN roots r ON r.v = 'trn_' || t.session_id || '/' || t.turn_index),
u_turns AS (SELECT unit, any_value(project_id) AS project_id, min(started_at) AS started_at, max(greatest(started_at, last_event_at)) AS updated_at, count(DISTINCT session_id) AS session_count, count(*) AS turn_count FROM members GROUP BY unit),
u_actors AS (SELECT unit, string_agg(provider, ',' ORDER BY a, b, c) AS actors FROM (SELECT unit, provider, min((started_at, turn_index, turn_id))[1] AS a, min((started_at, turn_index, turn_id))[2] AS b, min((started_at, turn_index, turn_id))[3] AS c FROM members GROUP BY 1, 2) GROUP BY unit),
u_attempts AS (SELECT m.unit, count(*) AS attempt_count, sum(CASE WHEN n.outcome IN ('failed', 'superseded') THEN 1 ELSE 0 END) AS failed_attempt_count, arg_max(n.outcome, (n.started_at, n.turn_index, n.attempt_index, n.attempt_id)) AS last_outcome, arg_max(n.attempt_id, (n.started_at, n.turn_index, n.attempt_index, n.attempt_id)) AS last_attempt FROM named n JOIN members m ON m.turn_id = n.turn_id GROUP BY m.unit),
u_paths AS (SELECT unit, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT DISTINCT m.unit, c.path FROM calls c JOIN members m ON m.session_id = c.session_id AND m.turn_index = c.turn_index WHERE c.is_edit AND c.path IS NOT NULL) GROUP BY unit),
u_commits AS (SELECT m.unit, count(*) AS commits FROM calls c JOIN members m ON m.session_id = c.session_id AND m.turn_index = c.turn_index WHERE c.git_subcommand = 'commit' AND c.outcome_status = 'success' GROUP BY m.unit),
u_phase AS (SELECT unit, arg_min(decides, rk) FILTER (WHERE decides IS NOT NULL) AS phase FROM (SELECT m.unit, row_number() OVER (PARTITION BY m.unit ORDER BY c.t DESC, 'spn_' || c.session_id || '/' || c.seq DESC) AS rk, CASE WHEN c.command_category = 'test' AND c.outcome_status = 'failure' THEN 'debug' WHEN c.git_subcommand = 'commit' THEN 'deliver' WHEN c.command_category = 'test' THEN 'verify' WHEN c.is_edit THEN 'implement' END AS decides FROM calls c JOIN members m ON m.session_id = c.session_id AND m.turn_index = c.turn_index) WHERE rk <= 5 GROUP BY unit),
units AS (SELECT t.unit AS work_unit_id, t.project_id, coalesce(f.phase, 'explore') AS phase, CASE WHEN a.last_outcome = 'succeeded' AND (coalesce(k.commits, 0) > 0 OR (now - t.updated_at) / 1e6 >= 1800) THEN 'completed' WHEN a.last_outcome = 'abandoned' OR (now - t.updated_at) / 1e6 >= 7200 THEN 'abandoned' ELSE 'open' END AS status, t.started_at, t.updated_at, t.session_count, t.turn_count, a.attempt_count, a.failed_attempt_count, coalesce(p.paths, '') AS paths, o.actors, 0.4 AS confidence, a.last_attempt, a.last_outcome
  FROM u_turns t CROSS JOIN as_of JOIN u_attempts a USING (unit) JOIN u_actors o USING (unit) LEFT JOIN u_paths p USING (unit) LEFT JOIN u_commits k USING (unit) LEFT JOIN u_phase f USING (unit))
"""

#: The same with each turn held against all earlier editors of its paths, not the 32 before it.
UNITS_OF_ALL = UNITS.replace(" AND x.rn >= y.rn - 32", "")

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, prelude: bool = True):
    def add(function):
        Q[name] = (function, (PRELUDE + sql if prelude else sql) if sql else None)
        return function

    return add


@query("show_failed_attempts", "SELECT session_id, provider, project_id, turn_index, attempt_index, started_at, outcome, failure_class, verification, tool_call_count, array_to_string(edited, ',') AS edited, t2 AS later_turn, i2 AS later_attempt FROM attempts WHERE outcome IN ('failed', 'superseded') ORDER BY started_at DESC, session_id, turn_index, attempt_index LIMIT 50")
def show_failed_attempts(spark, sf_dir):
    """The flagship: failed and superseded attempts, newest first, with what superseded them."""
    rows = projection(spark, sf_dir).attempts
    later = rows.select(F.col("attempt_id").alias("superseded_by"), F.col("turn_index").alias("later_turn"), F.col("attempt_index").alias("later_attempt"))
    failed = rows.where(F.col("outcome").isin("failed", "superseded")).join(later, "superseded_by", "left")
    return failed.orderBy(F.desc("started_at"), "session_id", "turn_index", "attempt_index").limit(50).select("session_id", "provider", "project_id", "turn_index", "attempt_index", us("started_at"), "outcome", "failure_class", "verification", "tool_call_count", joined("edited"), "later_turn", "later_attempt")


@query("events_canonical", "SELECT event_id, t AS observed_at, provider, project_id, session_id, device_id, kind, tool_name, tool_category, coalesce(path, '') AS path, outcome_status, command_category, git_subcommand, duration_ms, prompt FROM ev")
def events_canonical(spark, sf_dir):
    return driver_events(spark, sf_dir).select("event_id", us("observed_at"), "provider", "project_id", "session_id", "device_id", "kind", "tool_name", "tool_category", F.array_join("paths", ",").alias("path"), "outcome_status", "command_category", "git_subcommand", "duration_ms", "prompt")


@query("scan_filter", "SELECT event_id, t AS observed_at, kind FROM (SELECT * FROM ev WHERE provider IN ('codex', 'cursor') AND kind IN ('tool_call_failed', 'prompt_submitted') AND t >= epoch_us(TIMESTAMP '2024-01-05') AND t <= epoch_us(TIMESTAMP '2024-01-25') ORDER BY t DESC, event_id DESC LIMIT 200)")
def scan_filter(spark, sf_dir):
    rows = scan(driver_events(spark, sf_dir), providers=("codex", "cursor"), kinds=("tool_call_failed", "prompt_submitted"), since=datetime(2024, 1, 5, tzinfo=timezone.utc), until=datetime(2024, 1, 25, tzinfo=timezone.utc), newest=200)
    return rows.select("event_id", us("observed_at"), "kind")


@query("events_by_provider_kind", "SELECT provider, kind, count(*) AS n FROM ev GROUP BY 1, 2")
def events_by_provider_kind(spark, sf_dir):
    return driver_events(spark, sf_dir).groupBy("provider", "kind").agg(F.count("*").alias("n"))


@query("stream_facts", "SELECT scope, key, count(*) AS events, min(t) AS first_at, max(t) AS last_at, sum(CASE WHEN kind = 'tool_call_failed' THEN 1 ELSE 0 END) AS failures FROM (SELECT 'project' AS scope, project_id AS key, t, kind FROM ev UNION ALL SELECT 'provider', provider, t, kind FROM ev UNION ALL SELECT 'session', session_id, t, kind FROM ev UNION ALL SELECT 'device', device_id, t, kind FROM ev) GROUP BY scope, key")
def stream_facts(spark, sf_dir):
    return store.stream_facts(driver_events(spark, sf_dir)).select("scope", "key", "events", us("first_at"), us("last_at"), "failures")


@query("sessions", "SELECT session_id, provider, project_id, state, started_at, last_event_at, event_count, turn_count, prompt_count, tool_call_count, failure_count, coverage, first_event_id, last_event_id, CASE WHEN coverage = 'minimal' THEN 0.6 ELSE 0.4 END AS confidence FROM sessions")
def sessions(spark, sf_dir):
    return projection(spark, sf_dir).sessions.select("session_id", "provider", "project_id", "state", us("started_at"), us("last_event_at"), "event_count", "turn_count", "prompt_count", "tool_call_count", "failure_count", "coverage", "first_event_id", "last_event_id", "confidence")


@query("turns", "SELECT session_id, turn_index, provider, project_id, started_at, ended_at, status, prompt_event_id, stop_event_id, tool_call_count, objective, first_event_id, last_event_id, CASE WHEN stop_event_id IS NOT NULL THEN 1.0 ELSE 0.7 END AS confidence FROM turns")
def turns(spark, sf_dir):
    return projection(spark, sf_dir).turns.select("session_id", "turn_index", "provider", "project_id", us("started_at"), us("ended_at"), "status", "prompt_event_id", "stop_event_id", "tool_call_count", "objective", "first_event_id", "last_event_id", "confidence")


@query("tool_calls", "SELECT session_id, turn_index, event_id AS end_event_id, tool_name, tool_category, t AS finished_at, duration_ms, outcome_status, coalesce(path, '') AS paths, command_category, git_subcommand, 'end_only' AS pairing FROM calls")
def tool_calls(spark, sf_dir):
    return projection(spark, sf_dir).tool_calls.select("session_id", "turn_index", "end_event_id", "tool_name", "tool_category", us("finished_at"), "duration_ms", "outcome_status", joined("paths"), "command_category", "git_subcommand", "pairing")


@query("attempts", "SELECT session_id, turn_index, attempt_index, started_at, ended_at, outcome, failure_class, verification, tool_call_count, array_to_string(edited, ',') AS edited, confidence FROM attempts")
def attempts(spark, sf_dir):
    return projection(spark, sf_dir).attempts.select("session_id", "turn_index", "attempt_index", us("started_at"), us("ended_at"), "outcome", "failure_class", "verification", "tool_call_count", joined("edited"), "confidence")


@query("supersession", "SELECT session_id, t1, i1, t2, i2, reason FROM links")
def supersession(spark, sf_dir):
    p = projection(spark, sf_dir)
    place = p._first_attempts.select("attempt_id", "turn_index", "attempt_index")
    a, b = place.toDF("failed_id", "t1", "i1"), place.toDF("later_id", "t2", "i2")
    return p.supersessions.join(a, "failed_id").join(b, "later_id").select("session_id", "t1", "i1", "t2", "i2", "reason")


@query("handoffs", "SELECT g_session AS from_session, session_id AS to_session, g_provider AS from_provider, provider AS to_provider, project_id, begins AS handoff_at, gap_ms, shared_paths, confidence FROM handoffs WHERE confidence IS NOT NULL")
def handoffs(spark, sf_dir):
    return projection(spark, sf_dir).handoffs.select("from_session", "to_session", "from_provider", "to_provider", "project_id", us("handoff_at"), "gap_ms", joined("shared_paths"), "confidence")


@query("hot_paths", "SELECT * FROM (SELECT project_id, path, count(DISTINCT session_id) AS sessions FROM calls WHERE is_edit GROUP BY 1, 2) JOIN (SELECT project_id, count(*) AS project_sessions FROM sessions GROUP BY 1) USING (project_id) WHERE sessions >= 5 AND sessions >= 0.25 * project_sessions")
def hot_paths(spark, sf_dir):
    p = projection(spark, sf_dir)
    return project_stage.hot_paths(p.tool_calls, p.sessions, RULES)


@query("commits", "SELECT session_id, turn_index, event_id, t AS committed_at, 'unresolved' AS linkage, 0.4 AS confidence FROM calls WHERE git_subcommand = 'commit'")
def commits(spark, sf_dir):
    p = projection(spark, sf_dir)
    return p.commits.join(p.tool_calls.select("tool_call_id", "turn_index", F.col("end_event_id").alias("event_id")), "tool_call_id").select("session_id", "turn_index", "event_id", us("committed_at"), "linkage", "confidence")


@query("evidence_edges", "SELECT session_id, turn_index, attempt_index, count(*) AS n FROM (SELECT a.session_id, a.turn_index, a.attempt_index, c.event_id FROM attempts a JOIN walk w ON w.session_id = a.session_id AND w.turn_index = a.turn_index AND w.g = a.attempt_index JOIN calls c ON c.session_id = w.session_id AND c.turn_index = w.turn_index AND c.n = w.n UNION SELECT a.session_id, a.turn_index, a.attempt_index, t.prompt_event_id FROM attempts a JOIN turns t ON t.session_id = a.session_id AND t.turn_index = a.turn_index WHERE t.prompt_event_id IS NOT NULL UNION SELECT a.session_id, a.turn_index, a.attempt_index, a.stop_event_id FROM attempts a WHERE a.is_last AND a.stop_event_id IS NOT NULL) GROUP BY 1, 2, 3")
def evidence_edges(spark, sf_dir):
    p = projection(spark, sf_dir)
    return p.attempts.select("session_id", "turn_index", "attempt_index", F.explode("evidence").alias("e")).groupBy("session_id", "turn_index", "attempt_index").agg(F.count("*").alias("n"))


_STATE = """SELECT s.session_id, s.project_id, CASE WHEN ({at} - l.last_at) / 1e6 > CASE WHEN l.last_kind = 'turn_stopped' THEN 43200 ELSE 1800 END THEN 'stale' ELSE 'open' END AS session_state, l.last_at AS last_activity_at, tt.turn_index AS current_turn, CASE WHEN tt.ended_at <= {at} THEN tt.status ELSE 'in_progress' END AS turn_status, a.outcome_then AS last_attempt_outcome, a.attempt_count, a.failed_attempt_count
FROM sessions s JOIN (SELECT session_id, max(t) AS last_at, arg_max(kind, seq) AS last_kind FROM facts WHERE t <= {at} GROUP BY 1) l USING (session_id)
LEFT JOIN (SELECT session_id, max(turn_index) AS turn_index FROM turns WHERE started_at <= {at} GROUP BY 1) m USING (session_id) LEFT JOIN turns tt ON tt.session_id = m.session_id AND tt.turn_index = m.turn_index
LEFT JOIN (SELECT session_id, arg_max(outcome_then, turn_index * 100000 + attempt_index) AS outcome_then, count(*) AS attempt_count, sum(CASE WHEN outcome_then IN ('failed', 'superseded') THEN 1 ELSE 0 END) AS failed_attempt_count FROM (SELECT a.*, CASE WHEN a.ended_at IS NULL OR a.ended_at > {at} THEN 'in_progress' WHEN a.outcome = 'superseded' AND b.started_at > {at} THEN 'failed' ELSE a.outcome END AS outcome_then FROM attempts a LEFT JOIN attempts b ON b.session_id = a.session_id AND b.turn_index = a.t2 AND b.attempt_index = a.i2 WHERE a.started_at <= {at}) GROUP BY 1) a USING (session_id)
WHERE s.started_at <= {at}"""


@query("state_at", _STATE.format(at="epoch_us(TIMESTAMP '2024-01-20')"))
def state_at(spark, sf_dir):
    p = projection(spark, sf_dir)
    rows = temporal.state_at(p, AT)
    turn = p.turns.select(F.col("turn_id").alias("current_turn"), "turn_index")
    return rows.join(turn, "current_turn", "left").select("session_id", "project_id", "session_state", us("last_activity_at"), F.col("turn_index").alias("current_turn"), "turn_status", "last_attempt_outcome", "attempt_count", "failed_attempt_count")


@query("diff_state", "SELECT coalesce(x.session_id, y.session_id) AS subject, CASE WHEN x.session_id IS NULL THEN 'added' ELSE 'changed' END AS change, CASE WHEN x.session_id IS NULL THEN NULL ELSE f.field END AS field, CASE WHEN x.session_id IS NULL THEN NULL WHEN f.field = 'session_state' THEN x.session_state WHEN f.field = 'turn_status' THEN x.turn_status ELSE x.last_attempt_outcome END AS before, CASE WHEN x.session_id IS NULL THEN NULL WHEN f.field = 'session_state' THEN y.session_state WHEN f.field = 'turn_status' THEN y.turn_status ELSE y.last_attempt_outcome END AS after FROM (" + _STATE.format(at="epoch_us(TIMESTAMP '2024-01-15')") + ") x RIGHT JOIN (" + _STATE.format(at="epoch_us(TIMESTAMP '2024-01-20')") + ") y ON x.session_id = y.session_id CROSS JOIN (VALUES ('session_state'), ('turn_status'), ('last_attempt_outcome')) f(field) WHERE (x.session_id IS NULL AND f.field = 'session_state') OR (x.session_id IS NOT NULL AND CASE f.field WHEN 'session_state' THEN x.session_state IS DISTINCT FROM y.session_state WHEN 'turn_status' THEN x.turn_status IS DISTINCT FROM y.turn_status ELSE x.last_attempt_outcome IS DISTINCT FROM y.last_attempt_outcome END)")
def diff_state(spark, sf_dir):
    p = projection(spark, sf_dir)
    rows = temporal.diff(temporal.state_at(p, BEFORE), temporal.state_at(p, AT), fields=("session_state", "turn_status", "last_attempt_outcome"))
    return rows.select("subject", "change", "field", "before", "after")


@query("timeline", "SELECT s.session_id, s.started_at, t.turns, a.attempts FROM sessions s JOIN (SELECT session_id, string_agg(turn_index || ':' || status, ',' ORDER BY turn_index) AS turns FROM turns GROUP BY 1) t USING (session_id) JOIN (SELECT session_id, string_agg(turn_index || '.' || attempt_index || ':' || outcome, ',' ORDER BY turn_index, attempt_index) AS attempts FROM attempts GROUP BY 1) a USING (session_id)")
def timeline(spark, sf_dir):
    p = projection(spark, sf_dir)
    text = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]), ",")
    t = p.turns.groupBy("session_id").agg(text(["turn_index"], F.concat_ws(":", "turn_index", "status")).alias("turns"))
    a = p.attempts.groupBy("session_id").agg(text(["turn_index", "attempt_index"], F.concat("turn_index", F.lit("."), "attempt_index", F.lit(":"), "outcome")).alias("attempts"))
    return p.sessions.select("session_id", us("started_at")).join(t, "session_id").join(a, "session_id")


@query("last_test_run", "SELECT session_id, arg_max(event_id, seq) AS event_id, arg_max(outcome_status, seq) AS outcome_status FROM calls WHERE command_category = 'test' GROUP BY 1")
def last_test_run(spark, sf_dir):
    return projection(spark, sf_dir).tool_calls.where("command_category = 'test' and turn_index is not null").groupBy("session_id").agg(F.max_by("end_event_id", "seq").alias("event_id"), F.max_by("outcome_status", "seq").alias("outcome_status"))


@query("overview", "SELECT state, count(*) AS sessions, sum(failure_count) AS failures, sum(tool_call_count) AS calls FROM sessions GROUP BY state")
def overview(spark, sf_dir):
    return projection(spark, sf_dir).sessions.groupBy("state").agg(F.count("*").alias("sessions"), F.sum("failure_count").alias("failures"), F.sum("tool_call_count").alias("calls"))


@query("keyset_page", "SELECT session_id, started_at FROM sessions WHERE started_at < epoch_us(TIMESTAMP '2024-01-16') OR (started_at = epoch_us(TIMESTAMP '2024-01-16') AND session_id > '') ORDER BY started_at DESC, session_id LIMIT 26")
def keyset_page(spark, sf_dir):
    at = F.lit(datetime(2024, 1, 16, tzinfo=timezone.utc))
    return projection(spark, sf_dir).sessions.where((F.col("started_at") < at) | ((F.col("started_at") == at) & (F.col("session_id") > ""))).orderBy(F.desc("started_at"), "session_id").limit(26).select("session_id", us("started_at"))


@query("approach", "SELECT session_id, turn_index, attempt_index, approach FROM named WHERE tool_call_count > 0")
def approach(spark, sf_dir):
    return projection(spark, sf_dir).attempts.where("tool_call_count > 0").select("session_id", "turn_index", "attempt_index", "approach")


@query("live_windows", "SELECT session_id, min(t) AS active_from, max(t) + 1800000000 AS active_until, count(*) AS events FROM (SELECT session_id, t, sum(c) OVER (PARTITION BY session_id ORDER BY t, event_id) AS g FROM (SELECT session_id, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) < 1800000000 THEN 0 ELSE 1 END AS c FROM ev)) GROUP BY session_id, g")
def live_windows(spark, sf_dir):
    return refresh.live(driver_events(spark, sf_dir)).select("session_id", us("active_from"), us("active_until"), "events")


@query("tumbling_windows", "SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2", prelude=False)
def tumbling_windows(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return raw.groupBy(F.window("at", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.unix_micros("w.start").alias("window_start"), "event_type", "n", "total")


@query("audit", "SELECT * FROM (VALUES ('no event id', 0), ('no time', 0), ('no provider', 0), ('no session', 0), ('negative duration', 0), ('captured before observed', 0), ('call without tool', 0), ('repeated event id', 0)) AS t(rule, violations)", prelude=False)
def audit(spark, sf_dir):
    return store.audit(driver_events(spark, sf_dir))


@query("incremental_refresh", "SELECT session_id, turn_index, attempt_index, outcome0 AS outcome FROM attempts")
def incremental_refresh(spark, sf_dir):
    """Half of the stream first, then the rest: only the sessions that the rest touches are derived anew."""
    rows = driver_events(spark, sf_dir)
    now = F.lit(rows.agg(F.max("observed_at")).first()[0])
    first, rest = rows.where(F.col("observed_at") <= F.lit(AT)), rows.where(F.col("observed_at") > F.lit(AT))
    old = refresh.session_tables(first, now)["attempts"]
    new = refresh.session_tables(refresh.touched(rest, rows), now)["attempts"]
    return refresh.merged(old, new).select("session_id", "turn_index", "attempt_index", "outcome")


@query("redaction", "SELECT doc_id, regexp_replace(text, '((?i:token|secret|password|passwd|api_key|apikey)[ \\t\\n\\r\\f]*[=:][ \\t\\n\\r\\f]*[\"'']?)[A-Za-z0-9_/+.-]{8,}', '\\1[REDACTED:assignment]', 'g') AS text FROM documents", prelude=False)
def redaction(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.redact(F.col("text")).alias("text"))


@query("conversation_turns", "SELECT 'c' || conv_id AS session_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS prompts, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS stops, count(*) AS events FROM conversations GROUP BY conv_id", prelude=False)
def conversation_turns(spark, sf_dir):
    return conversations(spark, sf_dir).groupBy("session_id").agg(F.count_if(E.is_human_prompt()).alias("prompts"), F.count_if(F.col("kind") == "turn_stopped").alias("stops"), F.count("*").alias("events"))


@query("work_units", UNITS + "SELECT work_unit_id, project_id, phase, status, started_at, updated_at, session_count, turn_count, attempt_count, failed_attempt_count, paths, actors, confidence FROM units")
def work_units(spark, sf_dir):
    return projection(spark, sf_dir).work_units.select("work_unit_id", "project_id", "phase", "status", us("started_at"), us("updated_at"), "session_count", "turn_count", "attempt_count", "failed_attempt_count", joined("paths"), joined("actors"), "confidence")


@query("unit_components", UNITS_OF_ALL + "SELECT root, count(*) AS turn_count FROM roots GROUP BY root")
def unit_components(spark, sf_dir):
    p = projection(spark, sf_dir)
    links = project_stage.unit_links(p.turns, p.sessions, p.tool_calls, p.handoffs, replace(RULES, fan_out=None))
    return graph.connected(p.turns.select(F.col("turn_id").alias("vertex")), links).groupBy("root").agg(F.count("*").alias("turn_count"))


@query("signals")
def signals(spark, sf_dir):
    return projection(spark, sf_dir).signals


@query("decisions", """SELECT 'dec_approach_change/' || a.attempt_id AS decision_id, 'approach_change' AS kind, a.session_id, b.attempt_id AS selected, a.attempt_id AS alternatives, b.started_at AS decided_at, 0.4 AS confidence,
  'abandoned approach after ' || coalesce(a.failure_class, 'a failure') || ' on ' || CASE WHEN len(shared) = 0 THEN 'no shared path' ELSE array_to_string(shared[1:3], ', ') || CASE WHEN len(shared) > 3 THEN ' +' || (len(shared) - 3) || ' more' ELSE '' END END || '; retried with ' || CASE WHEN a.approach = b.approach THEN 'the same kind of change (' ELSE 'a different edit (' END || b.approach || ')' AS rationale
FROM (SELECT x.*, list_sort(list_intersect(x.edited, y.edited)) AS shared FROM named x JOIN named y ON y.session_id = x.session_id AND y.turn_index = x.t2 AND y.attempt_index = x.i2) a JOIN named b ON b.session_id = a.session_id AND b.turn_index = a.t2 AND b.attempt_index = a.i2""")
def decisions(spark, sf_dir):
    return projection(spark, sf_dir).decisions.select("decision_id", "kind", "session_id", "selected", joined("alternatives"), us("decided_at"), "confidence", "rationale")


@query("conflicts")
def conflicts(spark, sf_dir):
    return projection(spark, sf_dir).conflicts.drop("evidence", "paths")


@query("attention")
def attention(spark, sf_dir):
    return projection(spark, sf_dir).attention


_EDGES = UNITS + """, steps AS (SELECT 'parent_of' AS edge_kind, 'session' AS from_type, session_id AS from_id, 'turn' AS to_type, turn_id AS to_id FROM members
  UNION ALL SELECT 'triggered', 'event', prompt_event_id, 'turn', turn_id FROM members WHERE prompt_event_id IS NOT NULL
  UNION ALL SELECT 'parent_of', 'turn', 'trn_' || session_id || '/' || turn_index, 'tool_call', 'spn_' || session_id || '/' || seq FROM calls
  UNION ALL SELECT 'superseded', 'attempt', a.attempt_id, 'attempt', b.attempt_id FROM named a JOIN named b ON b.session_id = a.session_id AND b.turn_index = a.t2 AND b.attempt_index = a.i2
  UNION ALL SELECT 'caused', 'event', a.fail_event_id, 'event', b.first_call_event FROM named a JOIN named b ON b.session_id = a.session_id AND b.turn_index = a.t2 AND b.attempt_index = a.i2 WHERE a.fail_event_id IS NOT NULL AND b.first_call_event IS NOT NULL
  UNION ALL SELECT 'handed_off', 'session', g_session, 'session', session_id FROM handoffs WHERE confidence IS NOT NULL
  UNION ALL SELECT 'parent_of', 'work_unit', unit, 'turn', turn_id FROM members
  UNION ALL SELECT 'triggered', 'event', m.prompt_event_id, 'attempt', a.attempt_id FROM named a JOIN members m ON m.turn_id = a.turn_id WHERE m.prompt_event_id IS NOT NULL
  UNION ALL SELECT 'caused', 'event', fail_event_id, 'attempt', attempt_id FROM named WHERE fail_event_id IS NOT NULL)
"""


@query("edges", _EDGES + "SELECT edge_kind, from_type, from_id, to_type, to_id, count(*) AS n FROM steps GROUP BY ALL")
def edges(spark, sf_dir):
    rows = projection(spark, sf_dir).edges.where("edge_kind <> 'evidence_for'")
    return rows.groupBy("edge_kind", "from_type", "from_id", "to_type", "to_id").agg(F.count("*").alias("n"))


_EVIDENCE = "SELECT a.attempt_id, c.event_id FROM named a JOIN walk w ON w.session_id = a.session_id AND w.turn_index = a.turn_index AND w.g = a.attempt_index JOIN calls c ON c.session_id = w.session_id AND c.turn_index = w.turn_index AND c.n = w.n UNION SELECT a.attempt_id, t.prompt_event_id FROM named a JOIN turns t ON t.session_id = a.session_id AND t.turn_index = a.turn_index WHERE t.prompt_event_id IS NOT NULL UNION SELECT attempt_id, stop_event_id FROM named WHERE is_last AND stop_event_id IS NOT NULL"


@query("edge_counts", _EDGES + f"SELECT edge_kind, from_type, to_type, count(*) AS n FROM (SELECT edge_kind, from_type, to_type FROM steps UNION ALL SELECT 'evidence_for', 'event', 'attempt' FROM ({_EVIDENCE})) GROUP BY ALL")
def edge_counts(spark, sf_dir):
    return projection(spark, sf_dir).edges.groupBy("edge_kind", "from_type", "to_type").agg(F.count("*").alias("n"))


@query("trace_causes", _EDGES + """, links_of AS (SELECT from_id AS a, to_id AS b FROM steps UNION SELECT to_id, from_id FROM steps),
walked AS (SELECT (SELECT min(attempt_id) FROM named WHERE t2 IS NOT NULL) AS node, 0 AS d UNION SELECT l.b, w.d + 1 FROM walked w JOIN links_of l ON l.a = w.node WHERE w.d < 9),
met AS (SELECT node, min(d) AS d FROM walked GROUP BY node)
SELECT DISTINCT s.edge_kind, s.from_type, s.from_id, s.to_type, s.to_id, CAST(1 + least(coalesce(x.d, 99), coalesce(y.d, 99)) AS INTEGER) AS depth FROM steps s LEFT JOIN met x ON x.node = s.from_id LEFT JOIN met y ON y.node = s.to_id WHERE x.d IS NOT NULL OR y.d IS NOT NULL""")
def trace_causes(spark, sf_dir):
    p = projection(spark, sf_dir)
    start = p.supersessions.agg(F.min("failed_id")).first()[0]
    return graph.trace(p.edges, start or "", 10, "both")[0].select("edge_kind", "from_type", "from_id", "to_type", "to_id", "depth")


_THEN = """, then_ AS (SELECT a.*, CASE WHEN a.ended_at IS NULL OR a.ended_at > {at} THEN 'in_progress' WHEN a.outcome = 'superseded' AND b.started_at > {at} THEN 'failed' ELSE a.outcome END AS outcome_then, row_number() OVER (PARTITION BY a.session_id ORDER BY a.started_at DESC, a.turn_index DESC, a.attempt_index DESC) AS rk FROM named a LEFT JOIN named b ON b.session_id = a.session_id AND b.turn_index = a.t2 AND b.attempt_index = a.i2 WHERE a.started_at <= {at}),
stuck AS (SELECT session_id, arg_min(attempt_id, rk) AS last_attempt FROM then_ WHERE rk <= 2 GROUP BY session_id HAVING sum(CASE WHEN outcome_then = 'failed' THEN 1 ELSE 0 END) = 2 AND count(DISTINCT failure_class) = 1)
SELECT s.session_id, 'the last two attempts failed alike: failure' AS claim, k.last_attempt AS because, CASE WHEN s.coverage = 'minimal' THEN 0.5 ELSE 0.3 END AS confidence FROM stuck k JOIN sessions s USING (session_id) WHERE s.started_at <= {at}"""


@query("why_blocked", _THEN.format(at="epoch_us(TIMESTAMP '2024-01-20')"))
def why_blocked(spark, sf_dir):
    return temporal.why_blocked(projection(spark, sf_dir), AT)


def statement(name: str, text: str, columns: Callable[[], list], sql: str):
    """A query that asks the engine one statement."""

    def run(spark, sf_dir):
        return Engine(spark, projection(spark, sf_dir)).query(text).df.select(*columns())

    query(name, sql)(run)


_ALL = "LIMIT ALL"
_TRIED = lambda: ["attempt_id", "session_id", "turn_index", "attempt_index", us("started_at"), "outcome", "approach"]
_TRIED_SQL = "SELECT attempt_id, session_id, turn_index, attempt_index, started_at, outcome, approach FROM named WHERE "
statement("statement_show", "SHOW TOOL CALLS FOR tool=Edit AND path='src/f1*' WHERE duration_ms > 10 ORDER BY at DESC LIMIT 100", lambda: ["session_id", "end_event_id", joined("paths"), "duration_ms"], "SELECT session_id, event_id AS end_event_id, path AS paths, duration_ms FROM calls WHERE tool_name = 'Edit' AND path LIKE 'src/f1%' AND duration_ms > 10 ORDER BY t DESC, 'spn_' || session_id || '/' || seq LIMIT 100")
statement("statement_attempts", f"SHOW ATTEMPTS {_ALL}", _TRIED, _TRIED_SQL + "true")
statement("statement_failed", f"SHOW FAILED ATTEMPTS FOR project=p1 {_ALL}", _TRIED, _TRIED_SQL + "project_id = 'p1' AND outcome IN ('failed', 'superseded')")
statement("statement_superseded", f"SHOW SUPERSEDED ATTEMPTS FOR outcome=superseded SINCE 2024-01-10 UNTIL 2024-01-25 {_ALL}", _TRIED, _TRIED_SQL + "outcome = 'superseded' AND started_at >= epoch_us(TIMESTAMP '2024-01-10') AND started_at <= epoch_us(TIMESTAMP '2024-01-25')")
statement("statement_newest", "SHOW ATTEMPTS LIMIT 30", _TRIED, _TRIED_SQL + "true ORDER BY started_at DESC, attempt_id LIMIT 30")
statement("statement_sessions", f"SHOW SESSIONS FOR provider=claude WHERE failure_count > 1 ORDER BY failure_count DESC {_ALL}", lambda: ["session_id", "project_id", "state", us("started_at"), "failure_count", "retracted"], "SELECT session_id, project_id, state, started_at, failure_count, false AS retracted FROM sessions WHERE provider = 'claude_code' AND failure_count > 1")
statement("statement_turns", f"SHOW TURNS FOR status=completed AND agent=codex {_ALL}", lambda: ["session_id", "turn_index", us("started_at"), us("ended_at"), "status"], "SELECT session_id, turn_index, started_at, ended_at, status FROM turns WHERE status = 'completed' AND provider = 'codex'")
statement("statement_handoffs", f"SHOW HANDOFFS BETWEEN agent=codex AND agent=cursor {_ALL}", lambda: ["from_session", "to_session", "gap_ms"], "SELECT g_session AS from_session, session_id AS to_session, gap_ms FROM handoffs WHERE confidence IS NOT NULL AND ((g_provider = 'codex' AND provider = 'cursor') OR (g_provider = 'cursor' AND provider = 'codex'))")
statement("statement_units", f"SHOW WORK UNITS FOR phase=implement AND path='src/f1*' {_ALL}", lambda: ["work_unit_id", "status", "attempt_count"], UNITS + "SELECT work_unit_id, status, attempt_count FROM units WHERE phase = 'implement' AND work_unit_id IN (SELECT m.unit FROM calls c JOIN members m ON m.session_id = c.session_id AND m.turn_index = c.turn_index WHERE c.is_edit AND c.path LIKE 'src/f1%')")
statement("statement_commits", f"SHOW COMMITS FOR project=p2 {_ALL}", lambda: ["session_id", us("committed_at"), "linkage"], "SELECT session_id, t AS committed_at, 'unresolved' AS linkage FROM calls WHERE git_subcommand = 'commit' AND project_id = 'p2'")
statement("statement_why_blocked", "WHY project p1 STATUS BLOCKED", lambda: ["session_id", "claim", "because"], _THEN.format(at="(SELECT now FROM as_of)").replace("SELECT s.session_id, 'the last", "SELECT s.session_id AS session_id, 'the last").replace(", CASE WHEN s.coverage = 'minimal' THEN 0.5 ELSE 0.3 END AS confidence", "") + " AND s.project_id = 'p1'")
statement("statement_state", "STATE project p1 AT 2024-01-20", lambda: ["subject_type", "subject_id", us("last_activity_at"), "turn_status", "last_attempt_outcome"], None)
statement("statement_sql", "SELECT s.provider, t.status, count(*) AS n, sum(a.tool_call_count) AS calls FROM sessions s JOIN turns t ON t.session_id = s.session_id JOIN attempts a ON a.turn_id = t.turn_id WHERE NOT a.retracted GROUP BY s.provider, t.status", lambda: ["provider", "status", "n", "calls"], "SELECT s.provider, t.status, count(*) AS n, sum(a.tool_call_count) AS calls FROM sessions s JOIN turns t ON t.session_id = s.session_id JOIN named a ON a.session_id = t.session_id AND a.turn_index = t.turn_index GROUP BY s.provider, t.status")


@query("statement_what_is", "SELECT 'session' AS subject_type, x.session_id AS subject_id, x.session_state, x.turn_status, x.last_attempt_outcome FROM (" + _STATE.format(at="(SELECT now FROM as_of)") + ") x WHERE x.project_id = 'p1'")
def statement_what_is(spark, sf_dir):
    rows = Engine(spark, projection(spark, sf_dir)).query("WHAT IS project p1 DOING NOW").df
    return rows.where("subject_type = 'session'").select("subject_type", "subject_id", "session_state", "turn_status", "last_attempt_outcome")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
