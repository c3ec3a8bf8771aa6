"""Connected components of an edge table, by alternating star steps.

Each step replaces edges by edges to smaller ends (large star: a node's larger neighbours to its least neighbour; small star: its
smaller ones), until all that is left are edges from nodes to the least node of their component. A step is an aggregate, partial before its shuffle, and an
equi-join in which a node's edges are dealt to SALTS tasks, so a hub's neighbours aren't in one task; rounds grow with the logarithm of the longest path.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.skew import salted_join
from quernstone.sources.scratch import materialize

SALTS = 8


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node of its component. Null ends and loops are no edges."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = materialize(salted_join(both, least, "u", "k", SALTS).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = salted_join(large, least, "u", "k", SALTS)
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct()
        e = materialize(e, "small-star")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return e.toDF("node", "root")
        seen = mark
