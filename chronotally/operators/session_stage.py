"""What one session's events say on their own: sessions, turns, tool calls, attempts, supersession, signals, commits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from .events import BLOCKING, MUTATING, TOOL_ENDS, TOOL_KINDS, TURN_STOPS, is_human_prompt, ordered_distinct

STALE_S, WAITING_STALE_S = 30 * 60, 12 * 3600
ALGORITHM = "spark-tier1-v1"


def with_turns(events: DataFrame) -> DataFrame:
    """turn_index of each event: prompts count from 1; 0 is work before any prompt; null: before any work."""
    session = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("is_prompt", is_human_prompt())
    opens = F.col("kind").isin(*TOOL_KINDS, *TURN_STOPS)
    marked = marked.withColumn("prompts", F.sum(F.col("is_prompt").cast("int")).over(session)).withColumn("works", F.sum(opens.cast("int")).over(session))
    return marked.withColumn("turn_index", F.when((F.col("prompts") > 0) | (F.col("works") > 0), F.col("prompts")).cast("long")).drop("prompts", "works")


def _seconds(c: Column) -> Column:
    return F.unix_micros(c) / F.lit(1e6)


def sessions(events: DataFrame, as_of: Column) -> DataFrame:
    """One row for each session. events: with_turns."""
    kind = F.col("kind")
    resumes = kind.isin("session_started", "tool_call_started", "permission_requested") | F.col("is_prompt")
    at = lambda cond, value: F.min_by(F.when(cond, F.col(value)), F.when(cond, F.col("seq")))
    last = lambda cond, value: F.max_by(F.when(cond, F.col(value)), F.when(cond, F.col("seq")))
    is_start, is_end, is_tool = kind == "session_started", kind == "session_ended", kind.isin(*TOOL_KINDS)
    rows = events.groupBy("session_id").agg(
        F.first("provider").alias("provider"), F.first("provider_session_id").alias("provider_session_id"), F.min_by("project_id", "seq").alias("project_id"), F.min_by("project_name", "seq").alias("project_name"),
        F.coalesce(at(is_start, "observed_at"), F.min_by("observed_at", "seq")).alias("started_at"), last(is_end, "observed_at").alias("last_end_at"), F.max(F.when(is_end, F.col("seq"))).alias("end_seq"), F.max(F.when(resumes, F.col("seq"))).alias("resume_seq"),
        last(is_end, "note").alias("last_end_reason"), at(is_start, "note").alias("start_source"), F.count("*").alias("event_count"), F.countDistinct("turn_index").alias("turn_count"), F.count_if(F.col("is_prompt")).alias("prompt_count"),
        F.count_if(kind.isin(*TOOL_ENDS, "permission_denied")).alias("tool_call_count"),
        F.count_if((kind == "tool_call_failed") | (kind == "permission_denied") | (kind == "turn_failed") | (kind.isin(*TOOL_ENDS) & F.col("outcome_status").isin("failure", "denied") & (kind != "tool_call_failed"))).alias("failure_count"),
        ordered_distinct(F.when(F.col("agent_id") != "", F.col("agent_id")), F.col("seq")).alias("agents"), F.max(is_start).alias("has_start"), F.max(is_end).alias("has_end"), F.max(F.col("is_prompt")).alias("has_prompt"), F.max(is_tool).alias("has_tool"),
        F.min_by("event_id", "seq").alias("first_event_id"), F.max_by("event_id", "seq").alias("last_event_id"), F.max_by("observed_at", "seq").alias("last_event_at"), at(is_start, "event_id").alias("start_event_id"), last(is_end, "event_id").alias("end_event_id"),
        F.max(F.when(~is_end, F.col("observed_at"))).alias("last_activity_at"), F.max_by(kind, F.when(~is_end, F.col("seq"))).alias("last_kind"),
    )
    ended = F.col("has_end") & (F.coalesce("resume_seq", F.lit(0)) < F.col("end_seq"))
    idle = _seconds(as_of) - _seconds(F.coalesce("last_activity_at", "last_event_at"))
    limit = F.when(F.col("last_kind").isin("permission_requested", "turn_stopped", "notification"), WAITING_STALE_S).otherwise(STALE_S)
    state = F.when(ended, "closed").when(idle > limit, "stale").otherwise("open")
    some = F.col("has_prompt") | F.col("has_tool")
    coverage = F.when(F.col("has_start") & F.col("has_end") & F.col("has_prompt") & F.col("has_tool"), "full").when((F.col("has_start") | F.col("has_end")) & some, "partial").when(some, "minimal").otherwise("unknown")
    confidence = F.when(F.col("coverage") == "full", 1.0).when(F.col("coverage") == "partial", 0.8).when(F.col("coverage") == "minimal", 0.6).otherwise(0.4)
    rows = rows.withColumns({"state": state, "coverage": coverage, "ended_at": F.when(ended, F.col("last_end_at")), "end_reason": F.when(ended, F.col("last_end_reason"))})
    rows = rows.withColumn("confidence", F.when(F.col("state") == "stale", F.least(confidence, F.lit(0.7))).otherwise(confidence))
    rows = rows.withColumn("evidence", F.array_distinct(F.array_compact(F.array("start_event_id", "first_event_id", "last_event_id", "end_event_id"))))
    return rows.select("session_id", "provider", "provider_session_id", "project_id", "project_name", "state", "started_at", "ended_at", "end_reason", "start_source", "event_count", "turn_count", "prompt_count", "tool_call_count", "failure_count", "agents", "coverage", "first_event_id", "last_event_id", "last_event_at", "last_activity_at", "start_event_id", "end_event_id", "evidence", "confidence", F.lit(ALGORITHM).alias("algorithm_version"))


def turn_id(session: str = "session_id", index: str = "turn_index") -> Column:
    return F.concat(F.lit("trn_"), F.col(session), F.lit("/"), F.col(index))


def turns(events: DataFrame, session_rows: DataFrame) -> DataFrame:
    """One row for each turn: from its prompt (or first work) to its last stop, the next prompt or the session's end."""
    kind, at = F.col("kind"), F.col("observed_at")
    stop = kind.isin(*TURN_STOPS)
    last = lambda value: F.max_by(F.when(stop, value), F.when(stop, F.col("seq")))
    rows = events.where("turn_index is not null").groupBy("session_id", "turn_index").agg(
        F.first("provider").alias("provider"), F.first("project_id").alias("project_id"), F.first("project_name").alias("project_name"), F.min_by("observed_at", "seq").alias("started_at"), last(at).alias("stopped_at"), last(kind).alias("stop_kind"),
        last(F.col("event_id")).alias("stop_event_id"), last(F.coalesce("outcome_class", "note")).alias("stop_class"), F.min_by(F.when(F.col("is_prompt"), F.col("event_id")), F.when(F.col("is_prompt"), F.col("seq"))).alias("prompt_event_id"),
        F.min_by(F.when(F.col("is_prompt"), F.col("prompt")), F.when(F.col("is_prompt"), F.col("seq"))).alias("objective"), F.count_if(kind.isin(*TOOL_ENDS, "permission_denied")).alias("tool_call_count"),
        F.min_by("event_id", "seq").alias("first_event_id"), F.max_by("event_id", F.when(~kind.isin("session_started", "session_ended"), F.col("seq"))).alias("last_event_id"), F.max(F.when(~kind.isin("session_started", "session_ended"), at)).alias("last_event_at"),
    )
    following = F.lead("started_at").over(Window.partitionBy("session_id").orderBy("turn_index"))
    rows = rows.withColumn("next_at", following).join(session_rows.select("session_id", F.col("ended_at").alias("session_end")), "session_id")
    status = F.when(F.col("stop_kind") == "turn_stopped", "completed").when(F.col("stop_kind") == "turn_failed", "failed").when(F.col("next_at").isNotNull() | F.col("session_end").isNotNull(), "unknown").otherwise("in_progress")
    ended = F.coalesce("stopped_at", "next_at", "session_end")
    evidence = F.array_distinct(F.array_compact(F.array("prompt_event_id", "first_event_id", "last_event_id", "stop_event_id")))
    return rows.withColumns({"turn_id": turn_id(), "status": status, "ended_at": ended, "evidence": evidence, "confidence": F.when(F.col("stop_event_id").isNotNull(), 1.0).otherwise(0.7), "prompt_chars": F.length("objective").cast("long"), "algorithm_version": F.lit(ALGORITHM)}).drop("next_at", "session_end", "stopped_at")


CALL = ("seq", "turn_index", "agent_id", "tool_name", "tool_category", "tool_call_id", "kind", "observed_at", "duration_ms", "outcome_status", "outcome_class", "exit_code", "paths", "command_category", "git_subcommand", "lines_added", "lines_removed", "tests_failed", "event_id", "head", "branch", "provider", "project_id", "project_name")


def _by_call_id(tools: DataFrame) -> DataFrame:
    """mate: of the k-th start and the k-th end of a call id, the other's place, if the start comes first."""
    nth = Window.partitionBy("session_id", "tool_call_id", "is_start").orderBy("seq")
    tools = tools.withColumn("nth", F.when(F.col("tool_call_id").isNotNull(), F.row_number().over(nth)))
    pair = Window.partitionBy("session_id", "tool_call_id", "nth").orderBy("seq")
    mate = F.when(F.col("is_start"), F.lead("seq").over(pair)).otherwise(F.lag("seq").over(pair))
    return tools.withColumn("mate", F.when(F.col("nth").isNotNull(), mate)).drop("nth")


def _by_order(tools: DataFrame) -> DataFrame:
    """mate and fifo of the rest: in a queue of one agent and tool an end takes the earliest open start.

    With s the starts less the ends so far, an end finds an open start unless s falls below its least value so far; the k-th end
    that does takes the k-th start. An end with an id takes only a start without one, so queues of both kinds are walked.
    """
    rest = F.col("mate").isNull()
    keys = ["session_id", "agent_id", "tool_name", "rest"]
    queue = Window.partitionBy(*keys).orderBy("seq")
    before, so_far = queue.rowsBetween(Window.unboundedPreceding, -1), queue.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    tools = tools.withColumn("rest", rest).withColumn("has_id", F.col("tool_call_id").isNotNull())
    tools = tools.withColumn("ids", F.when(~F.min("has_id").over(whole), F.when(F.max("has_id").over(whole), "some").otherwise("none")).otherwise("all"))
    tools = tools.withColumn("s", F.sum(F.when(F.col("is_start"), 1).otherwise(-1)).over(so_far))
    open_end = ~F.col("is_start") & (F.col("s") >= F.least(F.lit(0), F.coalesce(F.min("s").over(before), F.lit(0))))
    tools = tools.withColumn("takes", F.col("rest") & (F.col("ids") == "none") & (F.col("is_start") | open_end))
    tools = tools.withColumn("k", F.when(F.col("takes"), F.sum(F.col("takes").cast("int")).over(Window.partitionBy(*keys, "is_start").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    pair = Window.partitionBy(*keys, "k").orderBy("seq")
    mate = F.when(F.col("is_start"), F.lead("seq").over(pair)).otherwise(F.lag("seq").over(pair))
    tools = tools.withColumn("fifo", F.when(F.col("k").isNotNull(), mate))
    mixed = tools.where("rest and ids = 'some'")
    ordered = mixed.select("session_id", "agent_id", "tool_name", "seq", "is_start", "has_id").repartition("session_id", "agent_id", "tool_name").sortWithinPartitions("session_id", "agent_id", "tool_name", "seq")
    found = ordered.mapInArrow(_walk_queues, "session_id string, seq int, walked int")
    tools = tools.join(found, ["session_id", "seq"], "left")
    return tools.withColumn("fifo", F.coalesce("fifo", "walked")).drop("rest", "has_id", "ids", "s", "takes", "k", "walked")


def _walk_queues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by queue and place: both rows of each pair. Only a queue's open starts are held."""
    queue, named, plain = None, deque(), deque()
    for batch in batches:
        out: list[tuple[str, int, int]] = []
        for session, agent, tool, seq, is_start, has_id in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (session, agent, tool) != queue:
                queue, named, plain = (session, agent, tool), deque(), deque()
            if is_start:
                (named if has_id else plain).append(seq)
                continue
            # an end with an id takes a start without one, an end without an id the earliest of all
            source = plain if has_id or not named or (plain and plain[0] < named[0]) else named
            if source:
                start = source.popleft()
                out += [(session, start, seq), (session, seq, start)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["session_id", "seq", "walked"])


def tool_calls(events: DataFrame, starts: bool = True) -> DataFrame:
    """Starts and ends paired: by call id, else first in first out for the same agent and tool; the rest stand alone.

    ``starts``: whether the stream has starts at all; without any, every end stands alone and nothing is matched.
    """
    tools = events.where(F.col("kind").isin(*TOOL_KINDS)).withColumn("is_start", F.col("kind") == "tool_call_started")
    row = F.struct(*CALL)
    if starts:
        tools = _by_order(_by_call_id(tools))
        mate = F.coalesce("mate", "fifo")
        begun = F.when(F.col("is_start"), F.col("seq")).otherwise(F.coalesce(mate, "seq"))
        side = lambda cond: F.max(F.when(cond, row))
        both = tools.withColumn("begun", begun).groupBy("session_id", "begun").agg(side(F.col("is_start")).alias("b"), side(~F.col("is_start")).alias("f"), F.max(F.col("mate").isNotNull()).alias("by_id"))
        pairing = F.when(F.col("f").isNotNull() & F.col("b").isNotNull(), F.when(F.col("by_id"), "call_id").otherwise("fifo")).when(F.col("f").isNotNull(), "end_only").otherwise("in_flight")
    else:
        both = tools.select("session_id", F.lit(None).cast(tools.select(row).schema[0].dataType).alias("b"), row.alias("f"))
        pairing = F.lit("end_only")
    pick = lambda c: F.coalesce(f"f.{c}", f"b.{c}").alias(c)
    first = lambda c: F.coalesce(f"b.{c}", f"f.{c}").alias(c)
    closed = F.col("f").isNotNull()
    status = F.when(closed, F.coalesce("f.outcome_status", F.when(F.col("f.kind") == "tool_call_failed", "failure").when(F.col("f.kind") == "permission_denied", "denied").otherwise("success")))
    spent = F.coalesce("f.duration_ms", F.greatest((F.unix_millis("f.observed_at") - F.unix_millis("b.observed_at")), F.lit(0)))
    none = F.array().cast("array<string>")
    return both.withColumn("pairing", pairing).select(
        F.concat(F.lit("spn_"), "session_id", F.lit("/"), F.coalesce("b.tool_call_id", "f.tool_call_id", F.coalesce("b.seq", "f.seq").cast("string"))).alias("tool_call_id"), "session_id", first("provider"), first("project_id"), first("project_name"), first("turn_index"), first("agent_id"), first("tool_name"), first("tool_category"),
        F.coalesce("b.tool_call_id", "f.tool_call_id").alias("provider_call_id"), F.col("b.observed_at").alias("started_at"), F.col("f.observed_at").alias("finished_at"), F.when(closed, spent).alias("duration_ms"), status.alias("outcome_status"), F.col("f.outcome_class").alias("outcome_class"), F.col("f.exit_code").alias("exit_code"),
        F.array_distinct(F.concat(F.coalesce("b.paths", none), F.coalesce("f.paths", none))).alias("paths"), pick("command_category"), pick("git_subcommand"), pick("lines_added"), pick("lines_removed"), F.col("f.tests_failed").alias("tests_failed"), "pairing",
        F.col("b.event_id").alias("start_event_id"), F.col("f.event_id").alias("end_event_id"), F.array_compact(F.array("b.event_id", "f.event_id")).alias("evidence"), F.when(F.col("pairing") == "fifo", 0.9).when(F.col("pairing") == "in_flight", 0.7).otherwise(1.0).alias("confidence"), F.col("f.head").alias("head"), pick("branch"),
        F.coalesce("b.observed_at", "f.observed_at").alias("at"), F.coalesce("b.seq", "f.seq").alias("seq"), F.lit(ALGORITHM).alias("algorithm_version"),
    )


def _walk_attempts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by agent and place: the number of each call's attempt, and whether the call ends it as a failure.

    An attempt fails at its first hard failure, or a soft one after an edit; the next begins with the first call after that was over.
    """
    key, g, had, edge = None, 0, False, None
    for batch in batches:
        numbers, fails = [], []
        for *own, at, over, is_edit, hard, soft in zip(*(batch[c].to_pylist() for c in ("session_id", "turn_index", "agent_id", "at", "over", "is_edit", "hard", "soft")), strict=True):
            if own != key:
                key, g, had, edge = own, 0, False, None
            elif edge is not None and at > edge:
                g, had, edge = g + 1, False, None
            failing = edge is None and (hard or (soft and had))
            if failing:
                edge = over
            had = had or is_edit
            numbers.append(g)
            fails.append(failing)
        yield pa.RecordBatch.from_arrays([batch["session_id"], batch["turn_index"], batch["agent_id"], pa.array(numbers, pa.int32()), pa.array(fails, pa.bool_()), batch["call"]], names=["session_id", "turn_index", "agent_id", "g", "fails", "call"])


# fixed values: categories with their words in an approach, those that list paths first
LISTED = (("file_edit", "edit"), ("file_write", "write"), ("notebook", "notebook"))
COUNTED = (("shell", "shell"), ("file_read", "read"), ("search", "search"), ("web", "web"), ("mcp", "mcp"), ("subagent", "subagent"), ("plan", "plan"), ("other", "other"))
MOST_PATHS = 4


def approach(calls: Column) -> Column:
    """What an array of calls did: paths of the changes, numbers of the rest. Calls: tool_category, paths, in order."""
    counted = lambda word, n: F.when(n == 1, word).when(n > 1, F.concat(F.lit(f"{word} ×"), n))
    own = lambda category: F.filter(calls, lambda c: F.coalesce(c["tool_category"], F.lit("other")) == category)
    parts = []
    for category, word in LISTED:
        paths = F.array_distinct(F.flatten(F.transform(own(category), lambda c: c["paths"])))
        more = F.when(F.size(paths) > MOST_PATHS, F.concat(F.lit(" +"), F.size(paths) - MOST_PATHS, F.lit(" more"))).otherwise("")
        parts.append(F.when(F.size(paths) > 0, F.concat(F.lit(f"{word} "), F.array_join(F.slice(paths, 1, MOST_PATHS), ", "), more)).otherwise(counted(word, F.size(own(category)))))
    parts += [counted(word, F.size(own(category))) for category, word in COUNTED]
    text = F.concat_ws(" · ", *parts)
    return F.when(text == "", "no tool calls").otherwise(text)


def attempts(call_rows: DataFrame, turn_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Turns cut where an agent's call fails: edits always, tests and builds always, other commands after an edit of the attempt.

    An agent's calls of a turn are walked once in order, as each cut depends on the one before; the walk holds only its state.
    """
    is_edit = F.coalesce(F.col("tool_category").isin(*MUTATING), F.lit(False))
    bad = F.col("outcome_status").isin("failure", "denied")
    check = F.coalesce(F.col("command_category").isin("test", "build"), F.lit(False))
    broken = F.coalesce(bad | (F.coalesce("exit_code", F.lit(0)) != 0) | (F.coalesce("tests_failed", F.lit(0)) > 0), F.lit(False))
    shell = F.col("tool_category") == "shell"
    call = F.struct(
        "seq", "at", F.coalesce("finished_at", "at").alias("over"), is_edit.alias("is_edit"), check.alias("check"), broken.alias("broken"), "command_category", "outcome_class", "outcome_status", (F.coalesce("tests_failed", F.lit(0)) > 0).alias("tests"), "tool_call_id",
        F.coalesce("tool_category", F.lit("other")).alias("tool_category"), "paths", "pairing", "evidence", F.coalesce("end_event_id", "start_event_id").alias("last_event"), F.coalesce("start_event_id", "end_event_id").alias("first_event"),
    )
    hard = F.coalesce((is_edit & bad) | (shell & ((F.col("outcome_status") == "denied") | (check & broken))), F.lit(False))
    calls = call_rows.where("turn_index is not null").select("session_id", "turn_index", "agent_id", "seq", F.unix_micros("at").alias("at"), F.unix_micros(F.coalesce("finished_at", "at")).alias("over"), is_edit.alias("is_edit"), hard.alias("hard"), F.coalesce(shell & bad, F.lit(False)).alias("soft"), call.alias("call"))
    ordered = calls.repartition("session_id", "turn_index", "agent_id").sortWithinPartitions("session_id", "turn_index", "agent_id", "seq")
    whole = StructType([*(ordered.schema[c] for c in ("session_id", "turn_index", "agent_id")), StructField("g", IntegerType()), StructField("fails", BooleanType()), ordered.schema["call"]])
    walked = ordered.mapInArrow(_walk_attempts, whole)
    groups = walked.groupBy("session_id", "turn_index", "agent_id", "g").agg(F.array_sort(F.collect_list("call")).alias("c"), F.max(F.when(F.col("fails"), F.col("call"))).alias("failed"))
    agent = Window.partitionBy("session_id", "turn_index", "agent_id")
    groups = groups.withColumn("is_last_cut", F.max("g").over(agent) == F.col("g")).withColumn("agent_seq", F.min(F.element_at("c", 1)["seq"]).over(agent))
    checks = F.filter("c", lambda x: x["check"])
    grouped = groups.select(
        "session_id", "turn_index", "agent_id", "agent_seq", "g", "is_last_cut", F.element_at("c", 1)["at"].alias("first_at"), F.array_max(F.transform("c", lambda x: x["over"])).alias("last_at"), F.col("failed").isNotNull().alias("failing"), F.coalesce("failed.outcome_class", "failed.outcome_status").alias("fail_class"),
        F.col("failed.tests").alias("tests"), F.col("failed.last_event").alias("fail_event_id"), F.col("failed.command_category").alias("failed_check"),
        F.when(F.size(checks) > 0, F.when(F.try_element_at(checks, F.lit(-1))["broken"], "failed").otherwise("passed")).alias("verification"), F.array_distinct(F.transform(F.filter(checks, lambda x: ~x["broken"]), lambda x: x["command_category"])).alias("passed_checks"),
        F.transform("c", lambda x: x["tool_call_id"]).alias("tool_call_ids"), F.size("c").cast("long").alias("tool_call_count"), F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda x: x["paths"])))).alias("paths"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("c", lambda x: x["is_edit"]), lambda x: x["paths"])))).alias("edited"),
        F.forall("c", lambda x: x["pairing"].isin("call_id", "end_only")).alias("by_id"), F.array_distinct(F.flatten(F.transform("c", lambda x: x["evidence"]))).alias("call_evidence"), F.element_at("c", 1)["first_event"].alias("first_call_event"), approach(F.col("c")).alias("approach"),
    )
    turn = turn_rows.select("session_id", "turn_index", "turn_id", "provider", "project_id", "project_name", "objective", "prompt_event_id", "stop_event_id", "stop_class", F.col("status").alias("turn_status"), F.col("started_at").alias("turn_start"), F.col("ended_at").alias("turn_end"), F.col("first_event_id").alias("turn_first"))
    rows = turn.join(grouped, ["session_id", "turn_index"], "left").join(session_rows.select("session_id", "coverage"), "session_id")
    by_agent = Window.partitionBy("session_id", "turn_index").orderBy(F.col("agent_seq").asc_nulls_first(), "g")
    rows = rows.withColumn("is_last", F.coalesce("is_last_cut", F.lit(True))).withColumn("is_first", F.row_number().over(by_agent) == 1)
    rows = rows.withColumn("started_at", F.when(F.col("is_first"), F.col("turn_start")).otherwise(F.col("first_at")))
    order = Window.partitionBy("session_id", "turn_index").orderBy("started_at", F.col("agent_seq").asc_nulls_first(), F.col("g").asc_nulls_first())
    rows = rows.withColumn("attempt_index", (F.row_number().over(order) - 1).cast("long"))
    failing = F.coalesce("failing", F.lit(False))
    outcome = F.when(failing, "failed").when(~F.col("is_last"), "failed").when(F.col("turn_status") == "completed", F.when(F.coalesce("tool_call_count", F.lit(0)) > 0, "succeeded").otherwise("unknown")).when(F.col("turn_status") == "failed", "failed").when(F.col("turn_status") == "unknown", "abandoned").otherwise("in_progress")
    failure = F.when(failing, F.when(F.coalesce("tests", F.lit(False)) & F.col("fail_class").isin("success"), "tests_failed").otherwise(F.coalesce("fail_class", F.lit("failure")))).when(F.col("turn_status") == "failed", F.when(F.col("is_last"), F.coalesce("stop_class", F.lit("turn_failed"))))
    confidence = F.when(F.col("coverage").isin("minimal", "unknown"), 0.4).when(F.col("stop_event_id").isNull() | ~F.coalesce("by_id", F.lit(True)), 0.6).otherwise(0.9)
    anchor = F.when(failing, F.concat(F.lit("fail/"), "fail_event_id")).when(F.col("first_call_event").isNotNull(), F.concat(F.lit("act/"), "first_call_event")).otherwise(F.concat(F.lit("turn/"), F.coalesce("prompt_event_id", "turn_first")))
    rows = rows.withColumns({"outcome": outcome, "failure_class": failure, "confidence": confidence, "attempt_id": F.concat(F.lit("att_"), "session_id", F.lit("/"), anchor)})
    none = F.array().cast("array<string>")
    return rows.select(
        "attempt_id", "session_id", "provider", "project_id", "project_name", "turn_id", "turn_index", "attempt_index", F.coalesce("agent_id", F.lit("")).alias("agent_id"), "objective", F.coalesce("approach", F.lit("no tool calls")).alias("approach"), "started_at",
        F.when(failing, F.col("last_at")).otherwise(F.when(F.col("turn_status") != "in_progress", F.col("turn_end"))).alias("ended_at"), "outcome", "failure_class", "verification", F.coalesce("tool_call_ids", none).alias("tool_call_ids"), F.coalesce("tool_call_count", F.lit(0)).alias("tool_call_count"),
        F.coalesce("paths", none).alias("paths"), F.coalesce("edited", none).alias("edited"), "failed_check", F.coalesce("passed_checks", none).alias("passed_checks"), "fail_event_id", "first_call_event",
        F.array_distinct(F.array_compact(F.concat(F.array("prompt_event_id"), F.coalesce("call_evidence", none), F.when(F.col("is_last"), F.array("stop_event_id")).otherwise(none)))).alias("evidence"), "confidence", F.lit(ALGORITHM).alias("algorithm_version"),
    )


def supersession(attempt_rows: DataFrame) -> DataFrame:
    """For each failed attempt the first later one, of this turn or the next and the same agent, that edits the same path or passes the failed check.

    Paths and checks are keys; the next attempt with a key is the last one met when an agent's attempts are read backwards.
    """
    named = lambda sign, values: F.transform(values, lambda x: F.concat(F.lit(sign), x))
    failed = (F.col("outcome") == "failed") & ((F.size("edited") > 0) | F.col("failed_check").isNotNull())
    own = F.array_distinct(F.concat(named("p", "edited"), named("c", "passed_checks")))
    base = attempt_rows.select("session_id", "agent_id", "attempt_id", "turn_index", "attempt_index", "confidence", failed.alias("failed"), own.alias("own"), F.concat(F.lit("c"), "failed_check").alias("asked"))
    met = F.transform("own", lambda k: F.struct(k.alias("key"), F.lit(True).alias("has"), (F.col("failed") & k.startswith("p")).alias("asks")))
    asked = F.when(F.col("failed") & F.col("asked").isNotNull(), F.array(F.struct(F.col("asked").alias("key"), F.lit(False).alias("has"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<key:string,has:boolean,asks:boolean>>"))
    rows = base.select("session_id", "agent_id", "attempt_id", "turn_index", "attempt_index", "confidence", F.inline(F.concat(met, asked)))
    # an attempt's own question comes before its own answer when read backwards
    later = Window.partitionBy("session_id", "agent_id", "key").orderBy(F.desc("turn_index"), F.desc("attempt_index"), "has").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(F.when(F.col("has"), F.struct("turn_index", "attempt_index", "attempt_id")), ignorenulls=True).over(later))
    found = rows.where(F.col("asks") & (F.col("next.turn_index") <= F.col("turn_index") + 1))
    # of the keys' next attempts the first; of equal ones an edit gives the reason
    best = found.groupBy("session_id", "attempt_id").agg(F.min(F.struct("next", F.when(F.col("key").startswith("p"), 0).otherwise(1).alias("order"))).alias("best"), F.first("confidence").alias("confidence"))
    same = F.col("best.order") == 0
    return best.select("session_id", F.col("attempt_id").alias("failed_id"), F.col("best.next.attempt_id").alias("later_id"), F.when(same, "same_edit").otherwise("passed_check").alias("reason"), F.when(same, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.6))).alias("confidence"))


def superseded(attempt_rows: DataFrame, links: DataFrame) -> DataFrame:
    first = links.groupBy(F.col("later_id").alias("attempt_id")).agg(F.min("failed_id").alias("supersedes"))
    out = attempt_rows.join(links.select(F.col("failed_id").alias("attempt_id"), F.col("later_id").alias("superseded_by")), "attempt_id", "left").join(first, "attempt_id", "left")
    return out.withColumn("outcome", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("outcome")))


def signals(events: DataFrame) -> DataFrame:
    """Requests to a human, and the first later event that clears each: of the same agent, or the human's own, or the session's end."""
    kind = F.col("kind")
    blocking_note = (kind == "notification") & F.col("note").isin(*BLOCKING)
    stopped = F.max(F.when(kind.isin(*TURN_STOPS), F.col("seq"))).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    prompted = F.max(F.when(F.col("is_prompt"), F.col("seq"))).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("idle_after", (F.col("note") == "idle_prompt") & F.coalesce(stopped > F.coalesce(prompted, F.lit(0)), F.lit(False)))
    progress = kind.isin("tool_call_started", *TOOL_ENDS, "permission_requested", "permission_denied", *TURN_STOPS, "session_ended") | F.col("is_prompt") | ((kind == "notification") & (F.col("note").isin(*BLOCKING, "elicitation_result")) & ~F.coalesce("idle_after", F.lit(False)))
    # read backwards, the last value so far is the next one: one pass for each kind of clearing event
    step = F.struct("seq", F.col("observed_at").alias("at"), F.col("event_id").alias("by"))
    ahead = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    following = lambda cond, *keys: F.last(F.when(F.coalesce(progress & cond, F.lit(False)), step), ignorenulls=True).over(ahead(*keys))
    wide, nobody = F.col("is_prompt") | (kind == "session_ended"), F.col("agent_id") == ""
    marked = marked.withColumns({"any": following(F.lit(True), "session_id"), "free": following(wide | nobody, "session_id"), "own": following(F.lit(True), "session_id", "agent_id")})
    earlier = F.when(F.col("own").isNull() | (F.col("free.seq") < F.col("own.seq")), F.col("free")).otherwise(F.col("own"))
    clear = F.when(nobody, F.col("any")).otherwise(earlier)
    raised = marked.where((kind == "permission_requested") | blocking_note).withColumn("clear", clear)
    rows = raised.select("session_id", "event_id", F.col("observed_at").alias("raised_at"), "agent_id", "kind", F.col("note").alias("signal_type"), (~F.coalesce("idle_after", F.lit(False))).alias("blocking"), F.col("clear.at").alias("cleared_at"), F.col("clear.by").alias("cleared_by"))
    pending = F.col("cleared_by").isNull()
    return rows.withColumns({"pending": pending, "evidence": F.array_compact(F.array("event_id", "cleared_by")), "confidence": F.when(F.col("kind") == "permission_requested", F.when(pending, 0.85).otherwise(0.9)).otherwise(0.65), "algorithm_version": F.lit(ALGORITHM)})


def commits(events: DataFrame, call_rows: DataFrame) -> DataFrame:
    """Commits by git calls, linked to the HEAD move of their own end event, a later move, or none."""
    own = Window.partitionBy("session_id").orderBy("seq")
    heads = events.where("head is not null").select("session_id", "seq", "head", "event_id").withColumn("before", F.lag("head").over(own))
    moves = heads.where("before is not null and head <> before").select("session_id", F.col("seq").alias("move_seq"), F.col("head").alias("to_head"), F.col("before").alias("from_head"), F.col("event_id").alias("move_event"))
    done = call_rows.where((F.col("git_subcommand") == "commit") & (F.coalesce("outcome_status", F.lit("success")) == "success"))
    done = done.join(moves.select("session_id", F.col("move_event").alias("end_event_id"), F.col("to_head").alias("own_head"), F.col("from_head").alias("own_before")), ["session_id", "end_event_id"], "left")
    # the k-th commit that waits takes the k-th later move that no commit made itself
    waiting = done.where("own_head is null").select("session_id", "tool_call_id", "seq")
    free = moves.join(done.where("own_head is not null").select("session_id", F.col("end_event_id").alias("move_event")), ["session_id", "move_event"], "left_anti")
    steps = waiting.select("session_id", "seq", F.lit(1).alias("wait"), "tool_call_id", F.lit(None).cast("string").alias("to_head"), F.lit(None).cast("string").alias("from_head")).unionByName(free.select("session_id", F.col("move_seq").alias("seq"), F.lit(0).alias("wait"), F.lit(None).cast("string").alias("tool_call_id"), "to_head", "from_head"))
    # read backwards, the last value so far is the next one
    later = Window.partitionBy("session_id").orderBy(F.desc("seq"), F.desc("wait")).rowsBetween(Window.unboundedPreceding, -1)
    found = steps.withColumns({"next_head": F.last("to_head", ignorenulls=True).over(later), "next_before": F.last("from_head", ignorenulls=True).over(later), "next_at": F.last(F.when(F.col("wait") == 0, F.col("seq")), ignorenulls=True).over(later)})
    taken = Window.partitionBy("session_id", "next_at").orderBy("seq")
    found = found.where("wait = 1").withColumn("turn_of", F.row_number().over(taken)).select("session_id", "tool_call_id", F.when(F.col("turn_of") == 1, F.col("next_head")).alias("next_head"), F.when(F.col("turn_of") == 1, F.col("next_before")).alias("next_before"))
    out = done.join(found, ["session_id", "tool_call_id"], "left")
    linkage = F.when(F.col("own_head").isNotNull(), "end_event").when(F.col("next_head").isNotNull(), "next_head").otherwise("unresolved")
    return out.select(F.concat(F.lit("cmt_"), "tool_call_id").alias("commit_id"), "session_id", "provider", "project_id", "project_name", F.when(F.col("turn_index").isNotNull(), turn_id()).alias("turn_id"), "tool_call_id", F.coalesce("own_head", "next_head").alias("sha"), F.coalesce("own_before", "next_before").alias("previous_sha"), "branch", F.col("finished_at").alias("committed_at"), linkage.alias("linkage"), "evidence", F.when(linkage == "end_event", 0.9).when(linkage == "next_head", 0.7).otherwise(0.4).alias("confidence"), F.lit(ALGORITHM).alias("algorithm_version"))
