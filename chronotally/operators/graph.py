"""Operators on edge tables: connected components and bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .tables import drop, written


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertex, root for each of ``vertices`` (vertex: string); edges a, b. The root is the smallest vertex of the component.

    Each round takes the least label around a vertex and then the label of that label, so long chains shorten by doubling.
    """
    both = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    both = written(both, "edges")
    # the first round starts from the vertices themselves
    least = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("least"))
    labels = written(vertices.join(least, "vertex", "left").select("vertex", F.least("vertex", F.coalesce("least", "vertex")).alias("root")), "labels")
    while True:
        seen = Observation()
        around = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("root").alias("least"))
        near = labels.join(around, "vertex", "left").select("vertex", F.col("root").alias("old"), F.least("root", F.coalesce("least", "root")).alias("root"))
        jump = labels.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
        moved = near.join(jump, "root", "left").select("vertex", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = written(moved.observe(seen, F.count_if(F.col("old") != F.col("root")).alias("moved")).select("vertex", "root"), "labels")
        drop(labels)
        if not seen.get["moved"]:
            return new
        labels = new


def trace(edges: DataFrame, start: str, depth: int = 10, direction: str = "both") -> tuple[DataFrame, bool]:
    """Edges met from ``start``, each once with its first depth, without evidence links; and whether more lay beyond ``depth``.

    down follows an edge from its source, up from its target.
    """
    spark = edges.sparkSession
    identity = [c for c in ("edge_kind", "from_type", "from_id", "to_type", "to_id", "edge_source") if c in edges.columns]
    steps = written(edges.where("edge_kind <> 'evidence_for'").dropDuplicates(identity), "steps")
    # while few nodes are reached they are a short list, whose size is checked, and each level is one pass over the steps
    seen, frontier, found, truncated = {start}, {start}, [], False
    keys: set[tuple] = set()
    for level in range(1, depth + 2):
        nodes = F.array(*[F.lit(x) for x in sorted(frontier)])
        down, up = F.array_contains(nodes, F.col("from_id")), F.array_contains(nodes, F.col("to_id"))
        met = steps.where(down if direction == "down" else up if direction == "up" else down | up).limit(FEW + 1).collect()
        if len(met) > FEW:
            return _trace_wide(steps, start, depth, direction, identity)
        new = [r for r in met if tuple(r[c] for c in identity) not in keys]
        if not new:
            break
        if level > depth:
            truncated = True
            break
        reached = {n for r in met for n, way, end in ((r["to_id"], "down", r["from_id"]), (r["from_id"], "up", r["to_id"])) if direction in ("both", way) and end in frontier}
        keys |= {tuple(r[c] for c in identity) for r in new}
        found += [(*r, level) for r in new]
        frontier = reached - seen
        seen |= reached
        if len(seen) > FEW:
            return _trace_wide(steps, start, depth, direction, identity)
        if not frontier:
            break
    return spark.createDataFrame(found, StructType([*steps.schema.fields, StructField("depth", IntegerType())])), truncated


#: Edges or nodes that a trace holds on the driver; a wider one goes on in tables.
FEW = 2_000


def _trace_wide(steps: DataFrame, start: str, depth: int, direction: str, identity: list[str]) -> tuple[DataFrame, bool]:
    spark = steps.sparkSession
    frontier = seen = spark.createDataFrame([(start,)], "node string")
    found = None
    for level in range(1, depth + 2):
        parts = []
        if direction in ("down", "both"):
            parts.append(steps.join(frontier, steps["from_id"] == frontier["node"], "left_semi").withColumn("reached", F.col("to_id")))
        if direction in ("up", "both"):
            parts.append(steps.join(frontier, steps["to_id"] == frontier["node"], "left_semi").withColumn("reached", F.col("from_id")))
        met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if found is not None:
            met = met.join(found.select(*identity), identity, "left_anti")
        met = written(met.withColumn("depth", F.lit(level)), "trace")
        if level > depth or met.isEmpty():
            return found, not met.isEmpty()
        edges_met = met.drop("reached").dropDuplicates(identity)
        found = edges_met if found is None else found.unionByName(edges_met)
        frontier = written(met.select(F.col("reached").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return found, False
