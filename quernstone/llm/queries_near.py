"""Queries of problem 1."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import near_duplicates as nd
from quernstone.sources.tables import table

SHINGLE, THRESHOLD = 3, 0.6


def _join(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nd.near_duplicates(table(spark, d, "page"), "page_id", "body", SHINGLE, THRESHOLD)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nd.expand_pairs(*_join(spark, d)).toDF("page_id_a", "page_id_b")


def _all_pages(spark: SparkSession, d: str, rows: DataFrame, alone: dict[str, int | None]) -> DataFrame:
    """`rows` with a row for each page without three words: an id column of its own where `alone` has None, else that value."""
    pages = table(spark, d, "page").select(F.col("page_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    values = [F.coalesce(c, "id" if x is None else F.lit(x)).cast("long").alias(c) for c, x in alone.items()]
    return pages.join(rows, "id", "left").select(F.col("id").alias("page_id"), *values)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a page; one without three words is a class of its own."""
    return _all_pages(spark, d, nd.classes(*_join(spark, d)), {"class_id": None, "copies": 1, "links": 0})


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a page: the group of pages it belongs to; one without three words is a group of its own."""
    return _all_pages(spark, d, nd.groups(*_join(spark, d)), {"group_id": None, "size": 1})


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_groups": p1_groups}
_SETS = r"""w AS (SELECT page_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS ws FROM page WHERE body IS NOT NULL),
s AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY page_id)"""
_PAIRS = """o AS (SELECT a.page_id AS page_id_a, b.page_id AS page_id_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.page_id < b.page_id GROUP BY ALL),
p AS (SELECT page_id_a, page_id_b FROM o JOIN n x ON x.page_id = page_id_a JOIN n y ON y.page_id = page_id_b WHERE o >= 0.6 * (x.n + y.n - o))"""
ORACLES = {
    "p1_found": f"WITH {_SETS}, {_PAIRS} SELECT page_id_a, page_id_b FROM p",
    "p1_classes": f"""WITH {_SETS}, {_PAIRS}, k AS (SELECT page_id, md5(string_agg(g, '|' ORDER BY g)) AS sig FROM s GROUP BY page_id), c AS (SELECT sig, min(page_id) AS class_id, count(*) AS copies FROM k GROUP BY sig),
r AS (SELECT page_id_a, page_id_b FROM p WHERE page_id_a IN (SELECT class_id FROM c) AND page_id_b IN (SELECT class_id FROM c)), l AS (SELECT x, count(*) AS links FROM (SELECT page_id_a AS x FROM r UNION ALL SELECT page_id_b FROM r) GROUP BY x)
SELECT d.page_id, coalesce(class_id, d.page_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links FROM (SELECT DISTINCT page_id FROM page WHERE page_id IS NOT NULL) d LEFT JOIN k USING (page_id) LEFT JOIN c USING (sig) LEFT JOIN l ON x = class_id""",
    "p1_groups": f"""WITH RECURSIVE {_SETS}, {_PAIRS}, e AS (SELECT page_id_a AS a, page_id_b AS b FROM p UNION ALL SELECT page_id_b, page_id_a FROM p), q AS (SELECT DISTINCT page_id AS a, page_id AS b FROM page WHERE page_id IS NOT NULL UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a)
SELECT a AS page_id, min(b) AS group_id, count(*) AS size FROM q GROUP BY a""",
}
