"""Queries through sinks and sources: what is written is read back."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.registry import Registry
from quernstone.sources import formats
from quernstone.sources.scratch import shared_folder
from quernstone.sources.tables import table as T

R = Registry()


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quernstone/files-{uuid.uuid4().hex}"


def _round_trip(kind: str):
    @R.query(f"f01_{kind}", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, c = _place(spark), T(spark, d, "customer")
        formats.write(c, kind, path)
        return formats.read(spark, kind, path, c.schema).withColumn("c_acctbal", F.round("c_acctbal", 2))

    return run


for _kind in ("parquet", "orc", "csv", "json"):
    _round_trip(_kind)


@R.query("f02_partitioned", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def f02(spark: SparkSession, d: str) -> DataFrame:
    """Written by partition; the filter on the partition column prunes folders."""
    path = _place(spark)
    formats.write(T(spark, d, "orders"), "parquet", path, by=["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.query("f03_text", "SELECT count(*) AS lines FROM region")
def f03(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    formats.write(T(spark, d, "region").select("r_name"), "text", path)
    return formats.read(spark, "text", path).agg(F.count("*").alias("lines"))


QUERIES, ORACLES = R.queries, R.oracles
