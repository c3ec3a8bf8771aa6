"""Queries of problem 8."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.abuse import THRESHOLD, abuse_scores
from quernstone.sources.tables import table


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= THRESHOLD).select(F.col("id").alias("doc_id")).distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score."""
    scores = _scores(spark, d).groupBy("id").agg(F.max("score").alias("score"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(scores, docs.doc_id == scores.id, "left").select("doc_id", "source", F.coalesce("score", F.lit(0.0)).alias("score"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each source's share of documents with such content."""
    s = p8_scores(spark, d)
    return s.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("found"), F.round(F.avg((F.col("score") >= THRESHOLD).cast("double")), 6).alias("rate")
    )


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLES: dict[str, str] = {}
