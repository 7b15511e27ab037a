"""Derived tables kept in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the checkpoint folder and read back, so that a loop's lineage stays short and survives lost executors."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        # unset, as in a plain session: the warehouse is shared too
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote of these tables, when nothing will read them again."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
