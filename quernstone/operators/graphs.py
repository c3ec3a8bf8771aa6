"""Graphs as edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.scratch import materialize


def reach(edges: DataFrame, src: str, dst: str, depth: int) -> DataFrame:
    """(src, dst, depth): shortest number of edges from each node to each node it reaches in 1 to `depth` steps.

    One join a step over the pairs that are new in it; cycles end by themselves, as known pairs aren't followed again. Null ends are no edges.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    known = materialize(e.withColumn("depth", F.lit(1)), "reach")
    frontier = known
    for k in range(2, depth + 1):
        step = frontier.alias("f").join(e.alias("e"), F.col("f.b") == F.col("e.a")).select(F.col("f.a").alias("a"), F.col("e.b").alias("b")).distinct()
        frontier = materialize(step.join(known, ["a", "b"], "left_anti").withColumn("depth", F.lit(k)), "reach")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.select(F.col("a").alias(src), F.col("b").alias(dst), "depth")
