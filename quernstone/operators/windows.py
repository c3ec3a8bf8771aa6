"""Window shapes that Spark lacks, from those it has."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def groups_frame_sum(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, name: str) -> DataFrame:
    """A sum over a GROUPS frame: peer groups from `before` groups back to `after` groups ahead. Nulls of `order` are one group, first."""
    w = W.partitionBy(*by).orderBy(F.asc_nulls_first(order))
    ranked = df.withColumn("_g", F.dense_rank().over(w))
    frame = W.partitionBy(*by).orderBy("_g").rangeBetween(-before, after)
    return ranked.withColumn(name, F.sum(value).over(frame)).drop("_g")


def global_place(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Each row's place (from 1) in a total order of the whole table.

    Rows are range-partitioned and ranked inside their partition, and the sizes of earlier partitions are added: no task holds the table,
    as a window without keys would. Rows that are equal in `order` get different places in no fixed order; give a total order for a fixed result.
    """
    from quernstone.sources.scratch import materialize

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    parted = materialize(parted, "ranges")  # the partition numbers must stay as they are
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = parted.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return ranked.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_r")).drop("_p", "_s", "_r")


def before_max(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The greatest `value` among a group's earlier rows in a total order, null if there is none.

    As `global_place`: rows are range-partitioned by group and order, maxima of earlier partitions are carried on, so a group of any size is spread over tasks.
    """
    from quernstone.sources.scratch import materialize

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = materialize(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    tops = parted.groupBy(*by, "_p").agg(F.max(value).alias("_m"))  # at most a row a group and partition
    before = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.max("_m").over(before).alias("_carried"))
    own = F.max(value).over(W.partitionBy(*by, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    on = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return parted.withColumn("_own", own).join(carried, on, "left").select(*df.columns, F.greatest("_own", "_carried").alias(name))


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column a share): exact interpolated quantiles of `value` in each group; nulls don't count.

    Values are counted, the counts range-partitioned by group and value, and the two ranks that a quantile lies between are looked up from the partitions' sizes,
    so the values of a group are never in one task. Groups without a value are left out; null keys are a group.
    """
    from quernstone.sources.scratch import materialize

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parted = materialize(counts.repartitionByRange(n, "_g", "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy("_g", "_p").agg(F.sum("_n").alias("_s"))
    starts = sizes.select(
        F.col("_g").alias("_h"), F.col("_p").alias("_q"), F.coalesce(F.sum("_s").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_s").over(W.partitionBy("_g")).alias("_all")
    )
    upto = F.sum("_n").over(W.partitionBy("_g", "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranked = parted.withColumn("_upto", upto).join(starts, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q")))
    first, last = F.col("_start") + F.col("_upto") - F.col("_n"), F.col("_start") + F.col("_upto") - 1
    at = {k: (F.col("_all") - 1) * q for k, q in shares.items()}
    holds = lambda r: (first <= r) & (r <= last)
    parts = []
    for k, r in at.items():
        lo, hi = F.floor(r), F.ceil(r)
        parts += [F.max(F.when(holds(lo), F.col("_v"))).alias(f"_lo_{k}"), F.max(F.when(holds(hi), F.col("_v"))).alias(f"_hi_{k}"), F.max(r - lo).alias(f"_f_{k}")]
    near = ranked.groupBy("_g").agg(*parts)
    return near.select(F.col("_g").alias(by), *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_f_{k}")).alias(k) for k in at])
