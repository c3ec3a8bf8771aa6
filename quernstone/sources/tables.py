"""Reading the Parquet tables of a folder, and spreading small scans over the cores."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`, lazily; filters and column lists reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, redistributed if its scan has fewer partitions than the session has cores.

    Meant for CPU-bound Python stages over a table that lies in one small file. A scan of many
    files has more partitions than cores and is returned as it is, without a shuffle; so is a plan that has a shuffle already.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
