"""Queries of problem 5."""

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import repeated_lines as rl
from quernstone.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = rl.repeated_lines(table(spark, d, "page_raw"), "raw_id", "source_host", "md")
    return found.toDF("raw_id", "line_no")


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "page_raw").select("raw_id", "source_host", "md")
    return rl.without_lines(raw, "raw_id", "md", rl.repeated_lines(raw, "raw_id", "source_host", "md"))


_FOUND = r"""
WITH l AS (
  SELECT raw_id, source_host, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS line_no
  FROM page_raw WHERE md IS NOT NULL),
n AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'),
    '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS norm
  FROM l WHERE regexp_matches(line, '\p{L}+[^\p{L}]+\p{L}+', 's')),
c AS (SELECT source_host, norm FROM n GROUP BY ALL HAVING count(DISTINCT raw_id) >= 6)
SELECT raw_id, CAST(line_no AS BIGINT) AS line_no FROM n
WHERE EXISTS (SELECT 1 FROM c WHERE c.source_host IS NOT DISTINCT FROM n.source_host AND c.norm = n.norm)"""

QUERIES = {"p5_found": p5_found, "p5_cleaned": p5_cleaned}
ORACLES = {
    "p5_found": _FOUND,
    "p5_cleaned": f"""
WITH f AS ({_FOUND}), k AS (
  SELECT raw_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS line_no FROM page_raw WHERE md IS NOT NULL),
b AS (SELECT raw_id, string_agg(line, chr(10) ORDER BY line_no) AS md FROM k ANTI JOIN f USING (raw_id, line_no) GROUP BY raw_id)
SELECT r.raw_id, r.source_host, CASE WHEN r.md IS NOT NULL THEN coalesce(b.md, '') END AS md FROM page_raw r LEFT JOIN b USING (raw_id)""",
}
