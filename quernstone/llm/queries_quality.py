"""Queries of problem 2."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.text_quality import quality
from quernstone.sources.tables import table


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return quality(table(spark, d, "page"), "page_id", "body").withColumnRenamed("id", "page_id")


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    """One row a page; one with nothing to count has zero counts and shares, and no reasons."""
    pages = table(spark, d, "page").select(F.col("page_id").cast("long").alias("page_id")).where("page_id IS NOT NULL").distinct()
    rows = _measured(spark, d)
    zero = [F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in rows.dtypes if c not in ("page_id", "reasons")]
    return pages.join(rows, "page_id", "left").select("page_id", *zero, F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).where(F.array_contains("reasons", "not_prose")).select("page_id")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many pages fail each rule."""
    return p2_statistics(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("pages"))


QUERIES = {"p2_found": p2_found, "p2_statistics": p2_statistics, "p2_reasons": p2_reasons}
ORACLES: dict[str, str] = {}
