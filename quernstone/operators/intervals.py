"""Joins of overlapping intervals as equi-joins on time buckets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: int, on: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs whose half-open intervals [start, end) overlap.

    Both sides are copied to each bucket they touch; a pair is kept in the bucket where the later of the two starts lies, so it
    comes once. Null ends and empty intervals overlap nothing. Buckets are `width` wide, or as wide as intervals are on average if that is more (one
    aggregate over both sides): so there are at most three copies an interval on average, however long some are. Column names of both sides must differ.
    """
    lengths = left.where(F.col(a[0]) < F.col(a[1])).select((F.col(a[1]) - F.col(a[0])).cast("double").alias("n"))
    lengths = lengths.union(right.where(F.col(b[0]) < F.col(b[1])).select((F.col(b[1]) - F.col(b[0])).cast("double")))
    width = max(width, int(lengths.agg(F.avg("n").alias("m")).first().m or 0) + 1)

    def spread(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        buckets = F.sequence(F.floor(F.col(s) / width).cast("long"), F.floor((F.col(e) - 1) / width).cast("long"))
        return df.where(F.col(s) < F.col(e)).withColumn(name, F.explode(buckets))

    x, y = spread(left, *a, "_ba"), spread(right, *b, "_bb")
    cond = (F.col("_ba") == F.col("_bb")) & (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("_ba") == F.floor(F.greatest(a[0], b[0]) / width))
    for p, q in on or []:
        cond = cond & (F.col(p) == F.col(q))
    return x.join(y, cond).drop("_ba", "_bb")
