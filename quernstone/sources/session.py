"""A session for local work; clusters bring their own."""

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local[cores] session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quernstone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
