"""As-of joins: the latest right row at or before each left row."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, at: str, by: str | None = None, tie: str | None = None, tolerance=None, allow_equal: bool = True) -> DataFrame:
    """`left` with the columns of the latest row of `right` whose `at` is not after its own, within the same `by`.

    One union and one window: left and right rows are sorted together by `at`, and the last right row is carried forward,
    so no pair is built. Left rows without a match, with a null `at` or null `by` stay, with nulls. Of right rows with the same `at`,
    that with the greatest `tie` wins. `tolerance` bounds `left.at - right.at`. With allow_equal=False the right row must be earlier.
    Column names of both sides must differ except for `at` and `by`. Without `by`, rows are sorted in one partition: give a key on large tables.
    """
    keys = [by] if by else []
    carried = [c for c in right.columns if c not in (at, *keys)]
    kept = [c for c in left.columns if c not in (at, *keys)]
    order = 0 if allow_equal else 2
    r = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(order).alias("_side"), F.struct(F.col(at).alias("_from"), *carried).alias("_r"), F.lit(None).alias("_l"), *([F.col(tie).alias("_tie")] if tie else [F.lit(None).alias("_tie")]))
    lft = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_r"), F.struct(F.lit(True).alias("_is"), *kept).alias("_l"), F.lit(None).alias("_tie"))
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.asc_nulls_first("_at"), "_side", F.asc_nulls_first("_tie")).rowsBetween(W.unboundedPreceding, 0)
    both = r.unionByName(lft).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    fits = F.col("_at").isNotNull()
    for k in keys:
        fits = fits & F.col(k).isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("_at") - F.col("_m._from") <= tolerance)
    out = both.withColumn("_m", F.when(fits, F.col("_m")))
    return out.select(*keys, F.col("_at").alias(at), *[F.col(f"_l.{c}").alias(c) for c in kept], *[F.col(f"_m.{c}").alias(c) for c in carried])
