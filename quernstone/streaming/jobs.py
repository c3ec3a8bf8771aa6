"""Structured Streaming jobs over an event stream, and running them to a table.

An event has event_id, ts (timestamp), user_id, event_type and value. In append mode a window comes out once the watermark has passed
its end; windows still open at the end of the input stay in the state.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quernstone.sources.scratch import shared_folder


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A file stream of events. `ts` is stored without a zone and is read as UTC, as watermarks need a timestamp."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    folder, name = path.rstrip("/").rsplit("/", 1)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a file source watches folders
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_to_table(stream: DataFrame, mode: str = "append", large_state: bool = True) -> DataFrame:
    """Runs a stream over all that is there and reads its results back.

    Results go to Parquet in the shared folder, each batch in a folder of its own that is overwritten if the batch is repeated.
    In update mode the rows of all batches are returned, with the batch number in `batch`. `large_state` keeps state on local disks instead of the heap
    (RocksDB, with its changes in the checkpoint folder), as transformWithState needs.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/quernstone/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    kept = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, f"org.apache.spark.sql.execution.streaming.state.{'RocksDB' if large_state else 'HDFSBacked'}StateStoreProvider")
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(save).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, kept) if kept else spark.conf.unset(_STORE)
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)
    return spark.read.schema(schema.add("batch", "long")).option("basePath", f"{base}/out").parquet(f"{base}/out")


def window_counts(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows: (start, event_type, n, total)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a user: (user_id, start, end, n)."""
    g = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def enriched(events: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Events with the columns of a static table."""
    return events.join(table, on, "left")


def followed(first: DataFrame, then: DataFrame, on: str, within: str, delay: str = "10 minutes") -> DataFrame:
    """Pairs of an event and a later one of the same key within a time; the columns of `then` are event_id, ts and the key."""
    a = first.withWatermark("ts", delay).select(F.col(on).alias("_k"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = then.withWatermark("ts", delay).select(on, F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"))
    cond = (F.col("_k") == F.col(on)) & (F.col("then_ts") > F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, cond).select(on, "first_id", "then_id")


class _Clamped(StatefulProcessor):
    """A key's clamped state. A batch's steps are composed to one map x -> min(b, max(a, x + s)) by array operations, without a loop over rows; state ends a time after a key's last event."""

    def __init__(self, lo: int, hi: int, idle_ms: int):
        self.lo, self.hi, self.idle_ms = lo, hi, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "step int, n long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        step, n, seen = self.state.get() if self.state.exists() else (0, 0, 0)
        parts = [(p["ts"].to_numpy(), p["event_id"].to_numpy(), np.where(p["value"].isna(), 0, np.where(p["value"] > 50, 1, -1))) for p in rows if len(p)]
        if parts:  # one user's events of one batch, as three arrays: the source's admission limit bounds them
            ts, ids, d = (np.concatenate(x) for x in zip(*parts))
            step, n = clamp_all(step, d[np.lexsort((ids, ts))], self.lo, self.hi), n + len(d)
            seen = max(seen, int(pd.Timestamp(ts.max()).timestamp() * 1000))
        self.state.update((step, n, seen))
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer(seen + self.idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "step": [step], "n": [n]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "step": pd.Series([], dtype="int32"), "n": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def clamp_all(x: int, steps: np.ndarray, lo: int, hi: int) -> int:
    """x after all steps, kept within [lo, hi] after each: pairs of steps are composed, halving their number, until one is left."""
    s, a, b = steps.astype(np.int64), np.full(len(steps), lo, np.int64), np.full(len(steps), hi, np.int64)
    while len(s) > 1:
        if len(s) % 2:
            s, a, b = np.append(s, 0), np.append(a, lo), np.append(b, hi)
        cut = lambda v: np.minimum(b[1::2], np.maximum(a[1::2], v + s[1::2]))
        s, a, b = s[::2] + s[1::2], cut(a[::2]), cut(b[::2])
    return int(min(b[0], max(a[0], x + s[0]))) if len(s) else x


def running_state(events: DataFrame, lo: int = 0, hi: int = 5, delay: str = "30 days", idle: str = "90 days") -> DataFrame:
    """Each user's clamped state after each batch, an up or down a step by the event's value: (user_id, step, n), in update mode.

    Within a batch a user's events are taken in order of time and id; events later than `delay` are dropped. A user's state ends once the watermark has passed
    their last event by `idle`. Null values are no step.
    """
    keep = int(pd.Timedelta(idle).total_seconds() * 1000)
    # Before the first watermark, what is not after the epoch counts as late: such times are lifted above it in the watermark's column.
    timed = events.withColumn("_at", F.greatest("ts", F.timestamp_millis(F.lit(1)))).withWatermark("_at", delay)
    return timed.groupBy("user_id").transformWithStateInPandas(_Clamped(lo, hi, keep), "user_id long, step int, n long", "Update", "EventTime")


def in_steps(*frames: DataFrame) -> DataFrame:
    """A file stream that has each of these tables of events in a batch of its own, in this order."""
    spark = frames[0].sparkSession
    path = f"{shared_folder(spark)}/quernstone/steps-{uuid.uuid4().hex}"
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return event_stream(spark, path, 1)


def hourly_counts(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(start, n): events an hour, without those that come behind the watermark."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there into a table in the driver's memory: for small results only."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
