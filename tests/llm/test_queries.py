"""The subpackage's queries on the smallest tables, against SQL where there is any."""

import pytest

from quernstone.llm import registry
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        same(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, FOLDER).collect() or name == "p8_found"


def test_results_hold_together(spark):
    """Invariants of results that have no SQL, on tables of sf0.01."""
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    bins = {}
    for r in QUERIES["p7_packed"](spark, d).collect():
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r["size"]
    sizes = {r.doc_id: len(r.ids) for r in QUERIES["p6_ids"](spark, d).collect()}
    assert set(sizes) == set(docs) and sum(bins.values()) == sum(sizes.values()) and max(bins.values()) <= 2048 and sorted(bins) == list(range(len(bins)))
    scores = {r.doc_id: r.score for r in QUERIES["p8_scores"](spark, d).collect()}
    found = {r.doc_id for r in QUERIES["p8_found"](spark, d).collect()}
    assert set(scores) == set(docs) and found == {i for i, s in scores.items() if s >= 0.5} and all(0 <= s <= 1 for s in scores.values())
    rates = QUERIES["p8_rates"](spark, d).collect()
    assert sum(r.found for r in rates) == len(found) and sum(r.documents for r in rates) == len(docs)
    raw = {r.raw_id: r.md for r in spark.read.parquet(f"{d}/page_raw.parquet").collect()}
    lost = {(r.raw_id, r.line_no) for r in QUERIES["p3_found"](spark, d).collect()}
    for r in QUERIES["p3_main"](spark, d).collect():
        assert r.md == (None if raw[r.raw_id] is None else "\n".join(s for n, s in enumerate(raw[r.raw_id].split("\n"), 1) if (r.raw_id, n) not in lost))


def test_columns_of_found(spark):
    assert QUERIES["p1_found"](spark, FOLDER).dtypes == [("page_id_a", "bigint"), ("page_id_b", "bigint")]
    assert QUERIES["p2_found"](spark, FOLDER).dtypes == QUERIES["p4_found"](spark, FOLDER).dtypes == [("page_id", "bigint")]
    assert QUERIES["p3_found"](spark, FOLDER).dtypes == QUERIES["p5_found"](spark, FOLDER).dtypes == [("raw_id", "bigint"), ("line_no", "bigint")]
    assert QUERIES["p6_ids"](spark, FOLDER).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert QUERIES["p8_found"](spark, FOLDER).dtypes == [("doc_id", "bigint")]


def test_one_row_a_page_also_without_words(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/page.parquet")
    ids, empty = {r.page_id for r in pages.collect()}, {r.page_id for r in pages.where("body IS NULL OR trim(body) = ''").collect()}
    assert empty
    for name, alone in (("p1_classes", lambda i: (i, i, 1, 0)), ("p1_groups", lambda i: (i, i, 1)), ("p2_statistics", lambda i: (i, *[0] * 12, []))):
        rows = QUERIES[name](spark, d).collect()
        assert len(rows) == len(ids) and {r.page_id for r in rows} == ids
        assert all(tuple(r) == alone(r.page_id) for r in rows if r.page_id in empty)
