"""Queries of problems 6 and 7."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.encoding import encode, token_counts
from quernstone.llm.packing import pack
from quernstone.sources.tables import table

CAPACITY = 2048


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_counts(table(spark, d, "documents").where("text <> ''"), "doc_id", "text")
    return pack(sizes, "id", "n_tokens", CAPACITY).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: containers, tokens, and the share of unused space."""
    bins = p7_packed(spark, d).groupBy("bin_id").agg(F.sum("size").alias("used"))
    return bins.agg(
        F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(1 - F.sum("used") / (F.count("*") * CAPACITY), 6).alias("unused_share")
    )


QUERIES = {"p6_ids": p6_ids, "p7_packed": p7_packed, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}
