"""Smaller operators over derived tables: paging, budgets, reconciliation, merging, live state, briefs, rendering."""

from __future__ import annotations

import io
import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# fixed values, in seconds
RECONCILE_S, RETENTION_S, ACTIVE_S = 10, 24 * 3600, 15 * 60
CELL, TABLE_CELL = 8192, 80


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def after_sequence(events: DataFrame, after: int, size: int) -> DataFrame:
    return events.where(F.col("source_seq") > after).orderBy("source_seq", "event_id").limit(size)


def keyset(df: DataFrame, at: str, key: str, size: int, cursor: tuple[datetime, str] | None = None) -> tuple[list, tuple | None]:
    """Rows strictly after ``cursor`` by (at descending, key ascending), and the next cursor if there are more."""
    if cursor is not None:
        df = df.where((F.col(at) < F.lit(cursor[0])) | ((F.col(at) == F.lit(cursor[0])) & (F.col(key) > cursor[1])))
    rows = df.orderBy(F.desc(at), key).limit(size + 1).collect()  # bounded by the page
    more = len(rows) > size
    rows = rows[:size]
    return rows, (rows[-1][at], rows[-1][key]) if more else None


def overlapping(df: DataFrame, start: str, end: str, since: datetime, until: datetime) -> DataFrame:
    return df.where((F.col(start) <= F.lit(until)) & (F.coalesce(F.col(end), F.lit(until)) >= F.lit(since)))


def within_budget(df: DataFrame, key: str, at: str, item: str, size: str, budget: int, since: datetime | None = None) -> DataFrame:
    """Newest items of each key whose sizes fit the budget one by one; an item that doesn't fit is passed over."""
    if since is not None:
        df = df.where(F.col(at) >= F.lit(since))
    rows = df.groupBy(key).agg(F.expr(f"""
        aggregate(sort_array(collect_list(struct({at} as at, {item} as item, cast({size} as bigint) as size)), false),
          named_struct('left', cast({int(budget)} as bigint), 'kept', cast(array() as array<struct<at:timestamp,item:string,size:bigint>>)),
          (a, x) -> if(x.size <= a.left, named_struct('left', a.left - x.size, 'kept', concat(a.kept, array(named_struct('at', x.at, 'item', cast(x.item as string), 'size', x.size)))), a), a -> a.kept)""").alias("kept"))  # fmt: skip
    return rows.select(key, F.explode("kept").alias("k")).select(key, F.col("k.at").alias(at), F.col("k.item").alias(item), F.col("k.size").alias(size))


def reconcile(hooked: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported events that a captured one already tells: same session and kind, within ten seconds, each captured event once.

    A session's start matches at any distance. Imported events are taken in time order, each with the nearest captured one left.
    """

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["observed_at", "event_id"]), right.sort_values(["observed_at", "event_id"])
        free, out = list(zip(left["observed_at"], left["event_id"], strict=True)), []
        for at, event, kind in zip(right["observed_at"], right["event_id"], right["kind"], strict=True):
            if not free:
                break
            k = min(range(len(free)), key=lambda k: (abs(free[k][0] - at), free[k]))
            if kind == "session_started" or abs((free[k][0] - at).total_seconds()) <= RECONCILE_S:
                out.append((event, free.pop(k)[1]))
        return pd.DataFrame(out, columns=["imported_id", "hook_id"])

    keys = ["session_id", "kind"]
    own = lambda df: df.select("session_id", "kind", "event_id", "observed_at").groupBy(*keys)
    return own(hooked).cogroup(own(imported)).applyInPandas(match, "imported_id string, hook_id string")


def merged_items(device: DataFrame, server: DataFrame) -> DataFrame:
    """One item for each (kind, id): the device's if its algorithm is of the server's family and not older."""
    family, version = lambda c: F.regexp_replace(c, r"-v[0-9]+$", ""), lambda c: F.coalesce(F.regexp_extract(c, r"-v([0-9]+)$", 1).try_cast("int"), F.lit(0))
    a, b = device.alias("a"), server.alias("b")
    both = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.id") == F.col("b.id")), "full_outer")
    newer = (family(F.col("a.algorithm_version")) == family(F.col("b.algorithm_version"))) & (version(F.col("a.algorithm_version")) >= version(F.col("b.algorithm_version")))
    mine = F.col("b.id").isNull() | F.coalesce(newer, F.lit(False))
    return both.select(*[F.when(mine, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in device.columns], F.when(mine, "device").otherwise("server").alias("origin"))


def live_state(events: DataFrame, now: Column) -> DataFrame:
    """The newest event of each session of the last day, and whether the session is active."""
    age = (F.unix_micros(now) - F.unix_micros("observed_at")) / F.lit(1e6)
    rows = events.where(age <= RETENTION_S).groupBy("session_id").agg(F.max_by(F.struct("event_id", "kind", "observed_at", "project_id"), F.struct("observed_at", "event_id")).alias("last"))
    rows = rows.select("session_id", "last.*")
    return rows.withColumn("active", (F.unix_micros(now) - F.unix_micros("observed_at")) / F.lit(1e6) <= ACTIVE_S)


def brief(projection, session: str, turns: int = 5) -> DataFrame:
    """What someone who takes a session over needs: its last turns, failures, files, open calls and pending requests."""
    own = F.col("session_id") == session
    last = projection.turns.where(own).orderBy(F.desc("turn_index")).limit(turns).select(F.lit("turn").alias("part"), F.col("turn_id").alias("id"), F.concat_ws(": ", "status", "objective").alias("what"), F.col("started_at").alias("at"))
    failed = projection.attempts.where(own & F.col("outcome").isin("failed", "superseded")).select(F.lit("failure").alias("part"), F.col("attempt_id").alias("id"), F.concat_ws(": ", "outcome", "failure_class").alias("what"), F.col("started_at").alias("at"))
    files = projection.tool_calls.where(own).select(F.explode("paths").alias("path"), "at").groupBy("path").agg(F.max("at").alias("at")).select(F.lit("file").alias("part"), F.col("path").alias("id"), F.lit(None).cast("string").alias("what"), "at")
    calls = projection.tool_calls.where(own & (F.col("pairing") == "in_flight")).select(F.lit("open call").alias("part"), F.col("tool_call_id").alias("id"), F.col("tool_name").alias("what"), "at")
    waits = projection.signals.where(own & F.col("pending")).select(F.lit("pending").alias("part"), F.col("event_id").alias("id"), F.coalesce("signal_type", "kind").alias("what"), F.col("raised_at").alias("at"))
    return last.unionByName(failed).unionByName(files).unionByName(calls).unionByName(waits).orderBy("part", F.desc("at"), "id")


def nested_timeline(projection) -> DataFrame:
    """Sessions with their turns, and the turns with their attempts, as nested lists."""
    attempts = projection.attempts.groupBy("session_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("attempt_index", "attempt_id", "outcome"))).alias("attempts"))
    turns = projection.turns.join(attempts, ["session_id", "turn_index"], "left").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "status", "attempts"))).alias("turns"), F.count("*").alias("total_turns"))
    return projection.sessions.select("session_id", "provider", "project_id", "started_at", "state").join(turns, "session_id", "left")


def render(df: DataFrame, form: str, most: int = 1000) -> str | bytes:
    """At most ``most`` rows as json, csv, a table, or arrow bytes; long cells are cut."""
    cut = lambda limit: df.select(*[F.when(F.length(F.col(n).cast("string")) > limit, F.concat(F.substring(F.col(n).cast("string"), 1, limit - 1), F.lit("…"))).otherwise(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]).limit(most)
    if form == "json":
        return "[" + ",".join(r[0] for r in cut(CELL).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()) + "]"
    if form == "csv":
        return cut(CELL).toPandas().to_csv(index=False)
    if form == "table":
        rows = [[("" if v is None else str(v)) for v in r] for r in cut(TABLE_CELL).collect()]
        widths = [max([len(n), *(len(r[k]) for r in rows)]) for k, n in enumerate(df.columns)]
        return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *rows])
    if form == "arrow":
        import pyarrow as pa

        table, out = cut(CELL).toArrow(), io.BytesIO()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return out.getvalue()
    raise ValueError(f"unknown form {json.dumps(form)}")
