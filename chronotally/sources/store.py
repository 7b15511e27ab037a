"""The event table: append with deduplication, rewrite, export, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.events import EVENT, conform, once


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def ingest(events: DataFrame, path: str, capture_mode: str = "local_semantic") -> int:
    """Append events whose ids the table lacks, each once; they get the next sequence numbers. Returns how many."""
    spark = events.sparkSession
    new, first = once(conform(events)), 0
    if capture_mode == "metadata_only":
        new = new.withColumns({"prompt": F.lit(None).cast("string"), "content": F.lit(None).cast("map<string,string>")})
    if exists(spark, path):
        known = read(spark, path)
        first = known.agg(F.max("source_seq")).first()[0] or 0
        new = new.join(known.select("event_id"), "event_id", "left_anti")
    # numbers run through one project after another, so that no single task orders all events; only the projects' counts are summed in order
    counts = new.groupBy("project_id").agg(F.count("*").alias("n"))
    bases = counts.select("project_id", F.coalesce(F.sum("n").over(Window.orderBy("project_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = new.withColumn("nth", F.row_number().over(Window.partitionBy("project_id").orderBy("observed_at", "event_id"))).alias("e").join(bases.alias("b"), F.col("e.project_id").eqNullSafe(F.col("b.project_id")))
    new = numbered.select("e.*", "b.base").withColumn("source_seq", F.lit(first) + F.col("base") + F.col("nth")).select(*[f.name for f in EVENT.fields])
    before = read(spark, path).count() if exists(spark, path) else 0
    new.write.mode("append").parquet(path)
    return read(spark, path).count() - before


def rewrite(spark: SparkSession, path: str, to: str, keep: Column | None = None, files: int | None = None) -> None:
    """Purge (rows that ``keep`` refuses) and compaction (into ``files`` files), into a new folder."""
    rows = read(spark, path)
    if keep is not None:
        rows = rows.where(keep)
    (rows.coalesce(files) if files else rows).write.mode("errorifexists").parquet(to)


def sanitized(events: DataFrame) -> DataFrame:
    """For export: no content, paths by their last part, session ids hashed."""
    return events.withColumns({"prompt": F.lit(None).cast("string"), "content": F.lit(None).cast("map<string,string>"), "paths": F.transform("paths", lambda p: F.substring_index(p, "/", -1)), "provider_session_id": F.sha2("provider_session_id", 256), "session_id": F.sha2("session_id", 256), "project_name": F.substring_index("project_name", "/", -1)})


def audit(events: DataFrame) -> DataFrame:
    """Violations of the envelope's rules, by rule."""
    rules = {"no event id": F.col("event_id").isNull(), "no time": F.col("observed_at").isNull(), "no provider": F.coalesce(F.col("provider"), F.lit("")) == "", "no session": F.coalesce(F.col("session_id"), F.lit("")) == "", "negative duration": F.col("duration_ms") < 0, "captured before observed": F.col("captured_at") < F.col("observed_at"), "call without tool": F.col("kind").startswith("tool_call") & F.col("tool_name").isNull()}
    counts = events.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()], F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))
    broken = [F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules]
    twice = F.struct(F.lit("repeated event id").alias("rule"), (F.col("events") - F.col("ids")).alias("violations"))
    return counts.select(F.explode(F.array(*broken, twice)).alias("r")).select("r.*")


def stream_facts(events: DataFrame) -> DataFrame:
    """Mergeable counts by project, provider, session and device."""
    parts = None
    for scope, key in (("project", "project_id"), ("provider", "provider"), ("session", "session_id"), ("device", "device_id")):
        part = events.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("events"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count_if(F.col("kind") == "tool_call_failed").alias("failures")).select(F.lit(scope).alias("scope"), "key", "events", "first_at", "last_at", "failures")
        parts = part if parts is None else parts.unionByName(part)
    return parts
