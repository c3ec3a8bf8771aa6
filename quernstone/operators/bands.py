"""Range (band) joins as equi-joins on buckets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that values beyond all bands' finite ends are dealt to, as they share a bucket.
SALTS = 16


def band_join(left: DataFrame, bands: DataFrame, value: str, lo: str, hi: str, width: int, on: list[tuple[str, str]] | None = None, how: str = "inner") -> DataFrame:
    """Rows of `left` with the bands (both ends inclusive) that hold their value.

    A null `hi` is open; a null `lo`, a null value and an empty band match nothing. Bands are copied to each bucket they touch, so the join is one
    equi-join on the bucket (and the pairs of key columns in `on`), not a nested loop. Values beyond the highest finite end of all bands share one
    last bucket, to which open bands reach; its rows are dealt to SALTS tasks. Buckets are `width` wide, or as wide as bands are on average if that is more: so there are
    at most three copies a band on average, however long some are. `how` is inner or left; rows of `left` that are equal come out as often as they are there.
    """
    v, on = F.col(value), on or []
    real = bands.where(F.col(lo).isNotNull() & (F.col(hi).isNull() | (F.col(lo) <= F.col(hi))))
    ends = real.agg(F.min(lo).alias("first"), F.greatest(F.max(lo), F.max(hi)).alias("top")).first()
    if ends.first is None:
        ends_of, first, top = F.col(lo), 0, 0
    else:
        first, top = ends.first, ends.top
        ends_of = F.coalesce(hi, F.lit(top))
        mean = real.agg(F.avg(ends_of - F.col(lo)).alias("m")).first().m
        width = max(width, int(mean) + 1)
    low, high = int(first // width) - 1, int(top // width) + 1
    salts = F.array(*map(F.lit, range(SALTS)))
    last = F.when(F.col(hi).isNull(), F.lit(high)).otherwise(F.floor(F.col(hi) / width).cast("long"))
    copies = real.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), last.cast("long"))))
    copies = copies.withColumn("_s", F.explode(F.when(F.col("_b") == high, salts).otherwise(F.array(F.lit(0))))).alias("_r")
    bucket = F.least(F.lit(high), F.greatest(F.lit(low), F.floor(v / width).cast("long"))).cast("long")
    probe = left.withColumn("_b", F.when(v.isNotNull(), bucket))
    probe = probe.withColumn("_s", F.when(F.col("_b") == high, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)).alias("_l")
    cond = (F.col("_l._b") == F.col("_r._b")) & (F.col("_l._s") == F.col("_r._s")) & (F.col(f"_l.{value}") >= F.col(f"_r.{lo}")) & (F.col(f"_r.{hi}").isNull() | (F.col(f"_l.{value}") <= F.col(f"_r.{hi}")))
    for a, b in on:
        cond = cond & (F.col(f"_l.{a}") == F.col(f"_r.{b}"))
    out = [F.col(f"_l.{c}") for c in left.columns] + [F.col(f"_r.{c}") for c in bands.columns]
    return probe.join(copies, cond, how).select(*out)
