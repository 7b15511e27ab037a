"""Smaller operators, and every example question of the catalog."""

from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from chronotally.operators import views
from chronotally.plans.catalog import QUESTIONS, TABLES
from chronotally.plans.engine import Engine
from chronotally.plans.projection import Projection
from chronotally.sources.driver import driver_events

AT = datetime(2026, 1, 1)


def test_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("k", AT + timedelta(hours=h), f"i{h}", s) for h, s in enumerate([5, 4, 90, 30, 2])], "key string, at timestamp, item string, size long")
    assert sorted(r.item for r in views.within_budget(df, "key", "at", "item", "size", 40).collect()) == ["i1", "i3", "i4"]
    assert [r.item for r in views.within_budget(df, "key", "at", "item", "size", 40, since=AT + timedelta(hours=4)).collect()] == ["i4"]


def test_reconcile_uses_each_event_once(spark):
    shape = "session_id string, kind string, event_id string, observed_at timestamp"
    hooked = spark.createDataFrame([("s", "prompt", "h1", AT), ("s", "prompt", "h2", AT + timedelta(seconds=6)), ("s", "session_started", "h3", AT)], shape)
    imported = spark.createDataFrame([("s", "prompt", "i1", AT + timedelta(seconds=4)), ("s", "prompt", "i2", AT + timedelta(seconds=5)), ("s", "prompt", "i3", AT + timedelta(seconds=6)), ("s", "session_started", "i4", AT + timedelta(days=1)), ("t", "prompt", "i5", AT)], shape)
    assert {tuple(r) for r in views.reconcile(hooked, imported).collect()} == {("i1", "h2"), ("i2", "h1"), ("i4", "h3")}


def test_merge_prefers_the_newer_of_one_family(spark):
    shape = "kind string, id string, value string, algorithm_version string"
    device = spark.createDataFrame([("a", "1", "d", "x-v3"), ("a", "2", "d", "x-v1"), ("a", "3", "d", "y-v9"), ("a", "4", "d", "x-v1")], shape)
    server = spark.createDataFrame([("a", "1", "s", "x-v2"), ("a", "2", "s", "x-v2"), ("a", "3", "s", "x-v2"), ("a", "5", "s", "x-v2")], shape)
    assert {r.id: r.value for r in views.merged_items(device, server).collect()} == {"1": "d", "2": "s", "3": "s", "4": "d", "5": "s"}


def test_pages(spark):
    df = spark.createDataFrame([(AT + timedelta(hours=h // 2), f"k{h}") for h in range(7)], "at timestamp, key string")
    seen, cursor = [], None
    while True:
        rows, cursor = views.keyset(df, "at", "key", 3, cursor)
        seen += [r.key for r in rows]
        if cursor is None:
            break
    assert seen == ["k6", "k4", "k5", "k2", "k3", "k0", "k1"]
    assert [r.key for r in views.page(df, [F.col("key")], 2, 3).collect()] == ["k3", "k4", "k5"]


def test_render(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, None)], "n long, t string")
    assert views.render(df, "json").startswith('[{"n":1,"t":"xxx') and '"t":null' in views.render(df, "json")
    assert max(map(len, views.render(df, "table").split("\n"))) <= 4 + 80 and views.render(df, "csv").startswith("n,t\n1,")
    assert pa.ipc.open_stream(views.render(df, "arrow")).read_all().num_rows == 2


def test_catalog_questions_and_views(spark):
    p = Projection(driver_events(spark, "/root/testdata/sf0.001"))
    engine = Engine(spark, p)
    assert set(TABLES) == set(Projection.TABLES)
    for question, statement in QUESTIONS.items():
        assert engine.query(statement).df.count() >= 0, question
    first = p.sessions.orderBy(F.desc("failure_count"), "session_id").first()
    parts = {r.part for r in views.brief(p, first.session_id).collect()}
    assert {"turn", "failure"} <= parts
    assert views.nested_timeline(p).count() == p.sessions.count()
    assert views.live_state(p.facts, p.now).where("active").count() >= 1
