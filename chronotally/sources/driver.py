"""Canonical events from the star schema's ``events`` table.

Providers follow user_id mod 4, projects user_id div 4; a user's session ends after 24 hours without an event. ``signup`` is a prompt,
``click`` a shell call, ``purchase`` a file edit, ``error`` a failed call, ``view`` a turn's stop (k mod 4 = 0) or a file read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.events import conform

PROVIDERS = ("claude_code", "codex", "cursor", "gemini_cli")
SESSION_GAP_S = 24 * 3600


def driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = raw.select("event_id", at.alias("observed_at"), "user_id", "event_type", "value", k.alias("k"), "ts")
    gap = F.col("observed_at").cast("double") - F.lag(F.col("observed_at")).over(own).cast("double")
    rows = rows.withColumn("cut", F.when(gap > SESSION_GAP_S, 1).otherwise(0))
    rows = rows.withColumn("n", 1 + F.sum("cut").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.col("event_type")
    is_edit = (kind == "purchase") | ((kind == "error") & (F.col("k") % 2 == 0))
    is_shell = (kind == "click") | ((kind == "error") & (F.col("k") % 2 == 1))
    is_read = (kind == "view") & (F.col("k") % 4 != 0)
    commit = (kind == "click") & (F.col("k") % 10 == 7)
    return conform(rows.select(
        F.col("event_id").cast("string").alias("event_id"), "observed_at",
        F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("user_id") % 4 + 1).cast("int")).alias("provider"),
        F.concat(F.lit("p"), F.floor(F.col("user_id") / 4)).alias("project_id"),
        F.concat(F.lit("p"), F.floor(F.col("user_id") / 4)).alias("project_name"),
        F.concat(F.lit("u"), "user_id", F.lit("-"), "n").alias("provider_session_id"),
        F.concat(F.lit("u"), "user_id", F.lit("-"), "n").alias("session_id"),
        F.concat(F.lit("d"), F.col("user_id") % 3).alias("device_id"),
        F.concat(F.lit("a"), "user_id").alias("agent_id"),
        F.when(kind == "signup", "prompt_submitted").when(kind == "error", "tool_call_failed").when((kind == "view") & ~is_read, "turn_stopped").otherwise("tool_call_finished").alias("kind"),
        F.when(is_edit, "Edit").when(is_shell, "Bash").when(is_read, "Read").alias("tool_name"),
        F.when(is_edit, "file_edit").when(is_shell, "shell").when(is_read, "file_read").alias("tool_category"),
        F.when(is_edit, F.array(F.concat(F.lit("src/f"), F.col("k") % 20, F.lit(".rs")))).otherwise(F.array().cast("array<string>")).alias("paths"),
        F.when(kind == "error", "failure").when(is_edit | is_shell | is_read, "success").alias("outcome_status"),
        F.when(is_shell & ~commit & (F.col("k") % 3 == 0), "test").alias("command_category"),
        F.when(commit, "commit").alias("git_subcommand"),
        F.when(is_edit | is_shell | is_read, F.floor("value").cast("long")).alias("duration_ms"),
        F.when(is_edit & (kind == "purchase"), F.col("k").cast("long")).alias("lines_added"),
        F.when(kind == "signup", F.concat(F.lit("do "), "k")).alias("prompt"),
    ))
