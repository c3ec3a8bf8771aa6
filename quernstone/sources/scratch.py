"""Intermediate tables in the folder all executors share.

`materialize` cuts a lineage by writing Parquet under the folder named in
`spark.checkpoint.dir`, so that a lost executor costs a re-read, not a recomputation. Only where
that setting is absent (single-machine tests) is a temporary folder used.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate data; set to a temporary one if the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="quernstone-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Removes every intermediate table of this library; results that still depend on one become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quernstone")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
