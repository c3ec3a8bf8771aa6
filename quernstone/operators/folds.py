"""Ordered folds: states that depend on the order of a group's events.

A clamped running sum isn't a window sum, as what a bound cuts off depends on the order. But clamped steps compose: x -> min(hi, max(lo, x + d))
has the form x -> min(b, max(a, x + s)), and so has any chain of them. `clamped_fold` uses that: the events of a group
are folded in chunks by rank, and the chunks' three numbers are folded again by partition and then by group, so a group of any size is spread over tasks.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Events in one chunk, about.
CHUNK = 10_000


def _then(f: Column, d: Column, lo: Column, hi: Column) -> Column:
    """The map x -> min(b, max(a, x + s)), f, followed by one more of the same form; null bounds don't bind. (least and greatest pass over nulls.)"""
    low = F.when(f["a"].isNotNull(), F.least(hi, F.greatest(lo, f["a"] + d))).otherwise(F.when(lo.isNotNull(), F.least(hi, lo)))
    high = F.when(f["b"].isNotNull(), F.least(hi, F.greatest(lo, f["b"] + d))).otherwise(hi)
    return F.struct((f["s"] + d).alias("s"), low.alias("a"), high.alias("b"))


def clamped_fold(df: DataFrame, by: list[str], order: list[str], delta: str, lo, hi, start: int, name: str, chunk: int = CHUNK) -> DataFrame:
    """(by, name): each group's state after all its steps in order, kept within [lo, hi] after each. Null steps count as 0.

    lo and hi are numbers, or Columns for bounds that differ by row: "keep the better of" is a step of 0 with lo = value and no upper bound,
    "replace" one with lo = hi = value. Null bounds don't bind. `order` must be total within a group for a fixed result. Rows are range-partitioned by
    group and order, and each partition's part of a group is folded in chunks of `chunk` rows, whatever their times: no task holds more than
    a partition and no array more than a chunk. An empty table gives an empty result.
    """
    bound = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + [F.col(c) for c in order]
    steps = df.select(*by, *order, F.coalesce(F.col(delta), F.lit(0)).cast("long").alias("_d"), bound(lo).alias("_from"), bound(hi).alias("_to"))
    parted = steps.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id())
    part = [*by, "_p"]
    placed = parted.withColumn("_c", F.floor((F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1) / chunk))
    none = F.lit(None).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("s"), none.alias("a"), none.alias("b"))
    step = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "_d", "_from", "_to")
    chunks = placed.groupBy(*part, "_c").agg(F.sort_array(F.collect_list(step)).alias("_e"))
    chunks = chunks.select(*part, "_c", F.aggregate("_e", zero, lambda f, e: _then(f, e["_d"], e["_from"], e["_to"])).alias("_f"))

    def chained(maps: DataFrame, keys_: list[str], at: str) -> DataFrame:
        lists = maps.groupBy(*keys_).agg(F.sort_array(F.collect_list(F.struct(at, "_f"))).alias("_fs"))
        return lists.select(*keys_, F.aggregate("_fs", zero, lambda f, g: _then(f, g["_f"]["s"], g["_f"]["a"], g["_f"]["b"])).alias("_f"))

    whole = chained(chained(chunks, part, "_c"), by, "_p")
    return whole.select(*by, F.least("_f.b", F.greatest("_f.a", F.lit(start).cast("long") + F.col("_f.s"))).alias(name))


def spaced(df: DataFrame, by: list[str], at: str, gap: int, name: str = "accepted") -> DataFrame:
    """(by, at, name): of a group's events in order of `at`, those at least `gap` after the last accepted one.

    `at` is a number; rows with a null one are left out. A later event is judged by accepted events only, so this is a fold; sorted partitions are
    read as streams, with one group's last accepted event in memory. Null keys are groups too.
    """
    kind = T.StructType([df.schema[c] for c in [*by, at]] + [T.StructField(name, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            fine = []
            for *k, t in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or k != key or t - last >= gap:
                    key, last = k, t
                    fine.append(True)
                else:
                    fine.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fine, pa.bool_())], names=[*by, at, name])

    return df.select(*by, at).where(F.col(at).isNotNull()).repartition(*by).sortWithinPartitions(*by, at).mapInArrow(run, kind)


def first_to_reach(df: DataFrame, by: list[str], order: list[str], good: Column, wins: int, losses: int) -> DataFrame:
    """(by, outcome, place): whether a group had `wins` good events or `losses` bad ones first, and at which event; open groups have neither."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = df.withColumn("_g", F.sum(F.when(good, 1).otherwise(0)).over(w)).withColumn("_n", F.count("*").over(w))
    run = run.withColumn("_o", F.when(F.col("_g") >= wins, "success").when(F.col("_n") - F.col("_g") >= losses, "failure"))
    return run.groupBy(*by).agg(F.coalesce(F.min_by("_o", F.when(F.col("_o").isNotNull(), F.col("_n"))), F.lit("open")).alias("outcome"), F.min(F.when(F.col("_o").isNotNull(), F.col("_n"))).alias("place"))
