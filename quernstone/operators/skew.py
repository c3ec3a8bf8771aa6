"""Equi-joins under skew."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join in which each key's left rows are dealt to `salts` tasks and its right rows copied to each.

    For a left side with hot keys and a right side with few rows a key. Null keys match nothing; `how` is inner, left, left_semi or left_anti.
    A row's salt is a hash of all its columns, so that a task run again deals alike; left rows that are equal in all columns share a task: count them first.
    """
    every = F.array(*map(F.lit, range(salts)))
    x = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    y = right.withColumn("_copy", F.explode(every))
    return x.join(y, (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")
