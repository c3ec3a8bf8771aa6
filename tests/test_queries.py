"""Every core query that has SQL against DuckDB on the smallest tables; the others run."""

import pytest

from quernstone.plans import catalog
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    same(spark, con, FOLDER, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).collect()


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "l_returnflag"
    assert set(ORACLES) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q10_inner_join"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,300000.0)" in plan


def test_sketches_are_near_the_exact_values(spark):
    from pyspark.sql import functions as F

    li = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    exact = {r.l_returnflag: r for r in li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.percentile("l_extendedprice", 0.5).alias("median")).collect()}
    for r in QUERIES["q26_approximate"](spark, FOLDER).collect():
        assert abs(r.parts - exact[r.l_returnflag].parts) <= 0.1 * exact[r.l_returnflag].parts
        assert abs(r.median - exact[r.l_returnflag].median) <= 0.02 * exact[r.l_returnflag].median
        assert len(r.frequent) == 3
