"""Files in the formats Spark ships with, front matter of Markdown files, and sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "source_url", "canonical_url", "source_host", "revision_id", "retrieved_at_utc", "content_sha256", "categories")])


def read(spark: SparkSession, kind: str, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON, text, binaryFile, or (with their packages on the class path) Avro and JDBC. CSV and JSON need a schema: inference reads all data twice."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with front matter: path, the front matter's keys, typed, and body. Files without front matter have nulls and their whole text as body."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n\s*"
    head = F.regexp_extract("value", pattern, 1)
    key = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*?)[ \t\r]*$", 1), r"^[\"']|[\"']$", ""), F.lit(""))
    cells = [key(k).alias(k) for k in PAGE.fieldNames() if k not in ("retrieved_at_utc", "categories")]
    listed = F.from_json(F.regexp_extract(head, r"(?m)^categories:[ \t]*(\[.*?\])[ \t\r]*$", 1), "array<string>")
    return raw.select("path", *cells, key("retrieved_at_utc").try_cast("timestamp").alias("retrieved_at_utc"), listed.alias("categories"), F.regexp_replace("value", pattern, "").alias("body"))


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", by: list[str] | None = None, rows_per_file: int | None = None, **options) -> None:
    """A sink: any format of `read`, or noop. `by` are partition columns; their values are brought together before writing, so a value isn't strewn over all tasks' files."""
    if by:
        df = df.repartition(*by) if rows_per_file is None else df.repartitionByRange(*by)
    writer = df.write.format(kind).mode(mode).options(**options)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path) if kind != "noop" else writer.save()
