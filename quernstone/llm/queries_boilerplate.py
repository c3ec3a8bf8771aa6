"""Queries of problem 3."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.boilerplate import containers, furniture
from quernstone.llm.repeated_lines import without_lines
from quernstone.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture(table(spark, d, "page_raw"), "raw_id", "source_host", "md").toDF("raw_id", "line_no")


def p3_main(spark: SparkSession, d: str) -> DataFrame:
    """Each page without its furniture."""
    raw = table(spark, d, "page_raw").select("raw_id", "source_host", "md")
    return without_lines(raw, "raw_id", "md", furniture(raw, "raw_id", "source_host", "md"))


def p3_cues(spark: SparkSession, d: str) -> DataFrame:
    """How many containers each cue marks, and on how many hosts."""
    rows = containers(table(spark, d, "page_raw"), "raw_id", "source_host", "md")
    return rows.where("cue IS NOT NULL").groupBy("cue").agg(F.count("*").alias("lines"), F.count_distinct("site").alias("hosts"))


QUERIES = {"p3_found": p3_found, "p3_main": p3_main, "p3_cues": p3_cues}
ORACLES: dict[str, str] = {}
