"""Queries of problem 4."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.splitting import split_texts
from quernstone.sources.tables import table


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_texts(table(spark, d, "page"), "page_id", "body")
    return pieces.where("n_pieces > 1").withColumnRenamed("id", "page_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 1").select("page_id")


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Checks that pieces without their overlaps give each text back: characters and a hash of the text put together again, by page."""
    own = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.expr("substring(piece, 201)"))
    p = p4_pieces(spark, d).withColumn("own", own)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")  # one page's pieces
    return p.groupBy("page_id").agg(F.sum(F.length("own")).cast("bigint").alias("chars"), (F.max(F.length("piece")) <= 8000).alias("within"), F.md5(whole).alias("hash"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_coverage": p4_coverage}
ORACLES = {
    "p4_found": "SELECT page_id FROM page WHERE length(body) > 8000",
    "p4_coverage": "SELECT page_id, CAST(length(body) AS BIGINT) AS chars, true AS within, md5(body) AS hash FROM page WHERE length(body) > 8000",
}
