"""All registered queries of the library (without ``llm``), and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import event_queries, sql_surface


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    surface = {name: (lambda spark, sf_dir, name=name: sql_surface.run(name, spark, sf_dir)) for name in sql_surface.FAMILIES}
    return event_queries.queries() | surface


def oracle_sql() -> dict[str, str]:
    return event_queries.oracle_sql() | {name: sql_surface.oracle(name) for name in sql_surface.FAMILIES}
