"""Queries that run a stream over the events to its end. Append mode emits closed windows only, and so does their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.plans.registry import Registry
from quernstone.sources.tables import table as T
from quernstone.streaming import jobs

R = Registry()
query = R.query
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.event_stream(spark, f"{d}/events.parquet")


@query(
    "t01_tumbling",
    f"SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM events) WHERE start + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY ALL",
)
def t01(spark: SparkSession, d: str) -> DataFrame:
    r = jobs.run_to_table(jobs.window_counts(_events(spark, d), "6 hours"))
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "t02_sliding",
    f"""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS start FROM events)
    WHERE start + INTERVAL 2 HOUR <= {_CLOSED} GROUP BY ALL""",
)
def t02(spark: SparkSession, d: str) -> DataFrame:
    r = jobs.run_to_table(jobs.window_counts(_events(spark, d), "2 hours", "1 hour"))
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "t03_sessions",
    f"""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
    FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
def t03(spark: SparkSession, d: str) -> DataFrame:
    r = jobs.run_to_table(jobs.session_counts(_events(spark, d), "30 minutes"))
    return r.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("t04_deduplicated", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def t04(spark: SparkSession, d: str) -> DataFrame:
    """The stream is read with every event twice; the repeats are dropped within the watermark."""
    e = _events(spark, d)
    r = jobs.run_to_table(jobs.deduplicated(e.union(e), ["event_id"]).select("event_id", "user_id", "event_type"))
    return r.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("t05_stream_static", "SELECT event_type, n_name, count(*) AS n FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey GROUP BY ALL")
def t05(spark: SparkSession, d: str) -> DataFrame:
    n = T(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    r = jobs.run_to_table(jobs.enriched(_events(spark, d).withColumn("k", F.col("user_id") % 25), n, "k").select("event_type", "n_name"))
    return r.groupBy("event_type", "n_name").agg(F.count("*").alias("n"))


@query(
    "t06_stream_stream",
    "SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
)
def t06(spark: SparkSession, d: str) -> DataFrame:
    a = _events(spark, d).where("event_type = 'click'")
    b = _events(spark, d).where("event_type = 'purchase'")
    return jobs.run_to_table(jobs.followed(a, b, "user_id", "30 MINUTES"))


@query("t07_state", "SELECT user_id, list_reduce(list(CASE WHEN value > 50 THEN 1 ELSE -1 END ORDER BY ts, event_id), lambda acc, x: least(5, greatest(0, acc + x)), 0)::INTEGER AS step, count(*) AS n FROM events GROUP BY user_id")
def t07(spark: SparkSession, d: str) -> DataFrame:
    r = jobs.run_to_table(jobs.running_state(_events(spark, d)), "update")
    return r.groupBy("user_id").agg(F.max(F.struct("batch", "n", "step")).alias("x")).select("user_id", "x.step", "x.n")


# Every seventh event comes late, in a third batch. A batch drops what is behind the watermark that the batch before it began with, so that is the first batch's.
@query(
    "t08_late_data",
    """WITH m AS (SELECT max(ts) AS top FROM events WHERE event_id % 7 > 1), k AS (SELECT event_id % 7 > 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > top - INTERVAL 10 MINUTE AS kept FROM events, m)
    SELECT count(*) AS events, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS late FROM k""",
)
def t08(spark: SparkSession, d: str) -> DataFrame:
    """A stream drops late events in silence, so those in its windows are compared with those that came."""
    events = T(spark, d, "events")
    stream = jobs.hourly_counts(jobs.in_steps(*[events.where(f"event_id % 7 {x}") for x in ("> 1", "= 1", "= 0")]))
    kept = jobs.run_to_table(stream, "update").groupBy("start").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    return events.agg(F.count("*").alias("events")).crossJoin(kept).select("events", "kept", (F.col("events") - F.col("kept")).alias("late"))


@query("t09_memory_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t09(spark: SparkSession, d: str) -> DataFrame:
    """A few totals kept in memory, complete after each batch."""
    return jobs.run_to_memory(_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), "totals_by_type")


QUERIES, ORACLES = R.queries, R.oracles
