"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it
back through Spark, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where it is unset, a folder of our own in the warehouse, which is shared too."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as read back from the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``stage`` wrote of these tables, when nothing will read them again."""
    for table in tables:
        discard(table.sparkSession, table.staged_path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later read needs."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
