"""Sources, sinks, scratch tables and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from quernstone.sources import formats, scratch
from quernstone.streaming import jobs


def test_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "A: b"\nsource_url: "u"\nretrieved_at_utc: "2025-01-02T03:04:05Z"\ncategories: ["x", "y"]\n---\n\n# Body\ntext\n')
    (tmp_path / "b.md").write_text("no front matter")
    got = {r.body: r for r in formats.read_pages(spark, str(tmp_path)).collect()}
    r = got["# Body\ntext\n"]
    assert (r.title, r.source_url, r.categories, r.retrieved_at_utc) == ("A: b", "u", ["x", "y"], datetime.datetime(2025, 1, 2, 3, 4, 5))
    assert got["no front matter"].title is None


def test_csv_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        formats.read(spark, "csv", str(tmp_path))


def test_partitioned_sink_writes_few_files(spark, tmp_path):
    formats.write(spark.range(1000).withColumn("k", F.col("id") % 3), "parquet", f"{tmp_path}/t", by=["k"])
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 3
    formats.write(spark.range(10), "noop", "", mode="overwrite")


def test_scratch_goes_to_the_shared_folder_and_is_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    kept = scratch.materialize(spark.range(5), "x")
    assert kept.count() == 5 and list((tmp_path / "shared").rglob("*.parquet"))
    scratch.drop_scratch(spark)
    assert not list((tmp_path / "shared").rglob("*.parquet"))


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError):
        scratch.shared_folder(Session())


def test_late_events_are_dropped_and_open_windows_wait(spark, tmp_path):
    def part(n, rows):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/tmp{n}")
        source = next((tmp_path / f"tmp{n}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        source.rename(tmp_path / "in" / f"{n}.parquet")

    import os

    part(1, [(1, "2024-01-01 00:05:00", 1, "a", 1.0), (2, "2024-01-01 02:00:00", 1, "a", 1.0)])
    part(2, [(3, "2024-01-01 04:00:00", 1, "a", 1.0)])
    part(3, [(4, "2024-01-01 00:10:00", 1, "a", 1.0), (5, "2024-01-01 05:00:00", 1, "a", None)])
    for n in (1, 2):
        os.utime(tmp_path / "in" / f"{n}.parquet", (n, n))
    events = jobs.event_stream(spark, f"{tmp_path}/in", files=1)
    got = jobs.run_to_table(jobs.window_counts(events, "1 hour")).collect()
    assert sorted((r.start.hour, r.n) for r in got) == [(0, 1), (2, 1)]


def test_state_carries_over_batches(spark, tmp_path):
    e = spark.createDataFrame([(i, 1, 60.0 if i < 8 else 0.0) for i in range(10)], "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz")).withColumn("event_type", F.lit("a"))
    for n, lo in enumerate((0, 5)):
        e.where(f"event_id >= {lo} AND event_id < {lo + 5}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    r = jobs.run_to_table(jobs.running_state(jobs.event_stream(spark, f"{tmp_path}/in", files=1)), "update")
    last = r.orderBy(F.desc("n")).first()
    assert last.n == 10 and r.count() == 2
