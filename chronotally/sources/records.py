"""Raw records of coding agents as canonical events: hooks, transcripts, envelopes, export rows, telemetry.

Every reader takes a DataFrame of JSON text (column ``value``) and works by column expressions. A row that is no JSON object, or lacks what makes an
event, comes out as kind ``unknown`` or is left out, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import classify_command, classify_failure, classify_tool, git_subcommand, line_delta
from ..operators.events import conform

# fixed values: hook names and the kinds they mean
KINDS = {
    "claude_code": {"SessionStart": "session_started", "SessionEnd": "session_ended", "UserPromptSubmit": "prompt_submitted", "PreToolUse": "tool_call_started", "PostToolUse": "tool_call_finished", "PostToolUseFailure": "tool_call_failed", "PermissionRequest": "permission_requested", "PermissionDenied": "permission_denied", "Notification": "notification", "Stop": "turn_stopped", "StopFailure": "turn_failed", "SubagentStart": "subagent_started", "SubagentStop": "subagent_stopped", "TaskCreated": "task_created", "TaskCompleted": "task_completed", "PreCompact": "compaction_started", "PostCompact": "compaction_finished", "ConfigChange": "config_changed", "CwdChanged": "cwd_changed", "FileChanged": "file_changed", "WorktreeCreate": "worktree_created", "WorktreeRemove": "worktree_removed", "Elicitation": "notification", "ElicitationResult": "notification"},
    "cursor": {"sessionStart": "session_started", "sessionEnd": "session_ended", "beforeSubmitPrompt": "prompt_submitted", "afterAgentResponse": "agent_message", "stop": "turn_stopped", "afterFileEdit": "tool_call_finished", "afterShellExecution": "tool_call_finished", "postToolUseFailure": "tool_call_failed", "preToolUse": "tool_call_started", "postToolUse": "tool_call_finished", "subagentStart": "subagent_started", "subagentStop": "subagent_stopped", "preCompact": "compaction_started"},
    "gemini_cli": {"SessionStart": "session_started", "SessionEnd": "session_ended", "BeforeAgent": "prompt_submitted", "AfterAgent": "turn_stopped", "BeforeTool": "tool_call_started", "AfterTool": "tool_call_finished", "Notification": "notification", "PreCompress": "compaction_started"},
}
KINDS["codex"] = KINDS["claude_code"]
EXPORT_KINDS = {"session_start": "session_started", "session_end": "session_ended", "prompt": "prompt_submitted", "activity": "tool_call_finished", "stop": "turn_stopped", "notification": "notification"}
DROPPED_METRICS = ("process.", "runtime.", "nodejs.", "v8js.", "http.server.", "system.")


def _get(path: str, column: str = "value") -> Column:
    return F.get_json_object(column, f"$.{path}")


def _first(*paths: str) -> Column:
    return F.coalesce(*[_get(p) for p in paths])


def _kind(name: Column, provider: str) -> Column:
    table = KINDS[provider]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), name), F.lit("unknown"))


def _named(df: DataFrame, *parts: Column) -> Column:
    """An id that depends on what the record says, so that a second delivery has the same."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def hooks(raw: DataFrame, provider: str, observed_at: Column | None = None) -> DataFrame:
    """Hook payloads of one provider."""
    name = _get("hook_event_name")
    session = _first("session_id", "conversation_id")
    command = F.coalesce(_get("command"), F.when(_get("tool_input.command").startswith("["), F.element_at(F.from_json(_get("tool_input.command"), "array<string>"), -1)).otherwise(_get("tool_input.command")))
    tool = F.coalesce(_get("tool_name"), F.when(name == "afterShellExecution", "Shell").when(name == "afterFileEdit", "Edit"))
    path = _first("tool_input.file_path", "tool_input.path", "tool_input.notebook_path", "file_path")
    root = F.coalesce(_get("cwd"), _get("workspace_roots[0]"))
    exit_code = F.coalesce(_first("exit_code", "tool_response.exit_code", "tool_response.exitCode").try_cast("int"))
    error = _first("error", "error_message", "tool_response.error", "tool_response.stderr")
    base = _kind(name, provider)
    kind = F.when((base == "tool_call_finished") & ((F.coalesce(exit_code, F.lit(0)) != 0) | _get("tool_response.error").isNotNull()), "tool_call_failed").when((name == "stop") & _get("status").isin("error", "aborted"), "turn_failed").otherwise(base)
    delta = line_delta(_get("tool_input.old_string"), F.coalesce(_get("tool_input.new_string"), _get("tool_input.content")))
    at = observed_at if observed_at is not None else F.coalesce(F.try_to_timestamp(_get("timestamp")), F.to_timestamp(F.lit("1970-01-01")))
    in_root = F.when(path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)
    category = classify_tool(tool)
    failed = kind == "tool_call_failed"
    return conform(raw.where(F.col("value").isNotNull()).select(
        _named(raw, F.lit(provider), session, name, _first("tool_use_id", "turn_id", "generation_id"), at.cast("string"), F.col("value")).alias("event_id"), at.alias("observed_at"), F.lit(provider).alias("provider"), session.alias("provider_session_id"),
        F.coalesce(root, F.lit("unknown")).alias("project_id"), F.element_at(F.split(F.coalesce(root, F.lit("unknown")), "/"), -1).alias("project_name"), _first("agent_id", "subagent_id").alias("agent_id"), kind.alias("kind"), tool.alias("tool_name"), category.alias("tool_category"), _first("tool_use_id", "call_id").alias("tool_call_id"),
        F.when(path.isNotNull(), F.array(in_root)).otherwise(F.array().cast("array<string>")).alias("paths"), F.when(failed, "failure").when(kind == "tool_call_finished", "success").when(kind == "permission_denied", "denied").alias("outcome_status"),
        F.when(failed, F.when(_get("failure_type").isNotNull(), _get("failure_type")).otherwise(classify_failure(F.coalesce(error, F.when(exit_code != 0, F.lit("nonzero")))))).when(kind == "turn_failed", _first("error", "status")).alias("outcome_class"), exit_code.alias("exit_code"),
        _first("duration_ms", "duration", "tool_response.duration_ms", "tool_response.durationMs").try_cast("long").alias("duration_ms"), F.when(category == "shell", classify_command(command)).alias("command_category"), F.when(category == "shell", git_subcommand(command)).alias("git_subcommand"),
        F.when(category.isin("file_edit", "file_write"), delta["added"]).alias("lines_added"), F.when(category.isin("file_edit", "file_write"), delta["removed"]).alias("lines_removed"), F.when(kind == "prompt_submitted", _get("prompt")).alias("prompt"), F.when(kind == "session_started", _get("source")).when(kind == "session_ended", _get("reason")).when(kind == "notification", _first("notification_type", "type", "matcher")).alias("note"),
        F.create_map(F.lit("hook_event_name"), name).alias("attrs"),
    ))


def claude_transcript(raw: DataFrame) -> DataFrame:
    """Transcript lines: prompts, tool uses and their results, answers. Summaries and side records are left out."""
    rows = raw.where(_get("type").isin("user", "assistant") & _get("timestamp").isNotNull()).select("value", _get("type").alias("type"), F.try_to_timestamp(_get("timestamp")).alias("at"), _get("uuid").alias("uuid"), _get("sessionId").alias("session"), _get("cwd").alias("cwd"), F.coalesce(_get("isSidechain"), F.lit("false")).alias("side"), _get("message.content").alias("content"))
    parts = F.when(F.col("content").startswith("["), F.from_json("content", "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>")).otherwise(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id")], F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("content"))))
    each = rows.select("*", F.posexplode(parts).alias("n", "p"))
    kind = F.when(F.col("p.type") == "tool_use", "tool_call_started").when((F.col("p.type") == "tool_result") & F.coalesce("p.is_error", F.lit(False)), "tool_call_failed").when(F.col("p.type") == "tool_result", "tool_call_finished").when((F.col("type") == "user") & (F.col("p.type") == "text"), "prompt_submitted").when(F.col("p.type") == "text", "agent_message")
    given = each.withColumn("kind", kind).where("kind is not null")
    called = given.where("kind = 'tool_call_started'").select("session", F.col("p.id").alias("call"), F.col("p.name").alias("called_name"))
    joined = given.withColumn("call", F.coalesce("p.id", "p.tool_use_id")).join(called, ["session", "call"], "left")
    tool = F.coalesce("p.name", "called_name")
    command, path = F.get_json_object("p.input", "$.command"), F.get_json_object("p.input", "$.file_path")
    return conform(joined.select(
        _named(joined, F.lit("claude_code"), F.col("session"), F.col("kind"), F.coalesce("call", "uuid")).alias("event_id"), F.col("at").alias("observed_at"), F.lit("claude_code").alias("provider"), F.col("session").alias("provider_session_id"), F.coalesce("cwd", F.lit("unknown")).alias("project_id"), F.element_at(F.split(F.coalesce("cwd", F.lit("unknown")), "/"), -1).alias("project_name"),
        F.when(F.col("side") == "true", "side").otherwise("").alias("agent_id"), "kind", tool.alias("tool_name"), classify_tool(tool).alias("tool_category"), F.col("call").alias("tool_call_id"), F.when(path.isNotNull(), F.array(path)).otherwise(F.array().cast("array<string>")).alias("paths"), F.when(F.col("kind") == "tool_call_failed", "failure").when(F.col("kind") == "tool_call_finished", "success").alias("outcome_status"),
        F.when(F.col("kind") == "tool_call_failed", classify_failure(F.col("p.content"))).alias("outcome_class"), classify_command(command).alias("command_category"), git_subcommand(command).alias("git_subcommand"), F.when(F.col("kind") == "prompt_submitted", F.col("p.text")).alias("prompt"), F.create_map(F.lit("source"), F.lit("transcript")).alias("attrs"),
    ))


def codex_transcript(raw: DataFrame) -> DataFrame:
    """Rollout lines: session_meta, prompts, function calls and their outputs, turn ends."""
    rows = raw.select("value", _get("type").alias("type"), F.try_to_timestamp(_get("timestamp")).alias("at"), _get("payload.type").alias("sub"), F.coalesce(_get("ordinal").try_cast("long"), F.lit(0)).alias("ordinal"), F.coalesce(_first("payload.thread_id", "payload.session_id", "payload.id"), F.lit("unknown")).alias("session"))
    call = F.col("type") == "response_item"
    kind = F.when(F.col("type") == "session_meta", "session_started").when((F.col("type") == "event_msg") & (F.col("sub") == "user_message"), "prompt_submitted").when(call & F.col("sub").isin("function_call", "local_shell_call", "custom_tool_call"), "tool_call_started").when(call & F.col("sub").isin("function_call_output", "custom_tool_call_output"), "tool_call_finished").when((F.col("type") == "event_msg") & F.col("sub").isin("task_complete", "turn_complete"), "turn_stopped").when((F.col("type") == "event_msg") & F.col("sub").isin("turn_aborted"), "turn_failed").when((F.col("type") == "event_msg") & (F.col("sub") == "agent_message"), "agent_message")
    given = rows.withColumn("kind", kind).where("kind is not null and at is not null")
    tool = _first("payload.name", "payload.tool_name")
    return conform(given.select(
        _named(given, F.lit("codex"), F.col("session"), F.col("kind"), F.col("ordinal").cast("string"), F.coalesce(_get("payload.call_id"), F.col("at").cast("string"))).alias("event_id"), F.col("at").alias("observed_at"), F.col("ordinal").alias("source_seq"), F.lit("codex").alias("provider"), F.col("session").alias("provider_session_id"), F.coalesce(_get("payload.cwd"), F.lit("unknown")).alias("project_id"), "kind", tool.alias("tool_name"), classify_tool(tool).alias("tool_category"), _get("payload.call_id").alias("tool_call_id"),
        F.when(F.col("kind") == "tool_call_finished", "success").alias("outcome_status"), F.when(F.col("kind") == "prompt_submitted", _get("payload.message")).alias("prompt"), F.create_map(F.lit("source"), F.lit("transcript")).alias("attrs"),
    ))


def envelopes(raw: DataFrame) -> DataFrame:
    """Envelope-v2 records of other tools."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EXPORT_KINDS.items() for x in pair]), _get("event")), F.lit("unknown"))
    tool, path = _get("payload.tool_name"), _get("payload.tool_input.file_path")
    good = raw.where(_get("v") == "2")
    return conform(good.select(_named(good, _get("agent"), _get("session_id"), _get("event"), _get("timestamp"), F.col("value")).alias("event_id"), F.try_to_timestamp(_get("timestamp")).alias("observed_at"), _get("agent").alias("provider"), _get("session_id").alias("provider_session_id"), _get("project_root").alias("project_id"), _get("project_root").alias("project_name"), kind.alias("kind"), tool.alias("tool_name"), classify_tool(tool).alias("tool_category"), F.when(path.isNotNull(), F.array(path)).alias("paths"), F.when(kind == "tool_call_finished", "success").alias("outcome_status"), _get("payload.duration_ms").try_cast("long").alias("duration_ms"), F.get_json_object("value", "$.signals['lines.added']").try_cast("long").alias("lines_added"), F.get_json_object("value", "$.signals['lines.removed']").try_cast("long").alias("lines_removed")))


def export_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of export lines (NDJSON, any order), and the lines that are no objects."""
    marked = raw.withColumn("ok", _get("id").isNotNull() & _get("created_at").isNotNull())
    good, bad = marked.where("ok"), marked.where("not ok").select("value")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EXPORT_KINDS.items() for x in pair]), _get("event_type")), F.lit("unknown"))
    path = _get("file_path")
    events = good.select(_get("id").alias("event_id"), F.try_to_timestamp(_get("created_at")).alias("observed_at"), _get("agent").alias("provider"), _get("session_id").alias("provider_session_id"), F.coalesce(_get("payload.project_root"), F.lit("unknown")).alias("project_id"), kind.alias("kind"), _get("tool").alias("tool_name"), classify_tool(_get("tool")).alias("tool_category"), F.when(path.isNotNull(), F.array(path)).alias("paths"), _get("lines_added").try_cast("long").alias("lines_added"), _get("lines_removed").try_cast("long").alias("lines_removed"))
    return conform(events), bad


def export_array(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from JSON arrays, one a row."""
    return export_rows(raw.select(F.explode(F.from_json("value", "array<string>")).alias("value")))


def otlp_logs(raw: DataFrame) -> DataFrame:
    """OTLP log records, flattened from resource and scope; unattributed and process records are dropped."""
    any_value = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
    attrs = f"array<struct<key:string,value:{any_value}>>"
    shape = f"struct<resourceLogs:array<struct<resource:struct<attributes:{attrs}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,eventName:string,body:{any_value},attributes:{attrs}>>>>>>>"
    as_map = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(attrs)), lambda a: F.struct(a["key"].alias("k"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("v"))))
    resources = raw.select(F.explode(F.from_json("value", shape)["resourceLogs"]).alias("r")).select(as_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("l"))
    rows = resources.select("resource", as_map(F.col("l.attributes")).alias("own"), F.col("l.timeUnixNano").cast("long").alias("nano"), F.coalesce("l.eventName", "l.body.stringValue").alias("name"))
    session = F.coalesce(F.try_element_at("own", F.lit("session.id")), F.try_element_at("resource", F.lit("session.id")))
    dropped = F.lit(False)
    for prefix in DROPPED_METRICS:
        dropped = dropped | F.coalesce(F.col("name").startswith(prefix), F.lit(False))
    kept = rows.withColumn("session", session).where(F.col("session").isNotNull() & ~dropped)
    return conform(kept.select(_named(kept, F.lit("otel"), F.col("session"), F.col("name"), F.col("nano").cast("string")).alias("event_id"), F.timestamp_micros((F.col("nano") / 1000).cast("long")).alias("observed_at"), F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("otel")).alias("provider"), F.col("session").alias("provider_session_id"), F.lit("unknown").alias("project_id"), F.lit("unknown").alias("kind"), F.map_concat(F.create_map(F.lit("source"), F.lit("otel"), F.lit("name"), F.col("name")), F.map_filter("own", lambda k, v: ~k.isin("source", "name"))).alias("attrs")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as sessions: user turns are prompts, assistant turns messages that stop the turn."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return conform(raw.select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("event_id"), at.alias("observed_at"), F.lit("claude_code").alias("provider"), F.concat(F.lit("c"), "conv_id").alias("provider_session_id"), F.concat(F.lit("c"), "conv_id").alias("session_id"), F.concat(F.lit("q"), F.col("conv_id") % 7).alias("project_id"), F.when(F.col("role") == "user", "prompt_submitted").when(F.col("role") == "assistant", "turn_stopped").otherwise("session_started").alias("kind"), F.when(F.col("role") == "user", F.col("text")).alias("prompt")))
