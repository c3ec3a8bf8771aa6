"""Queries over the page corpus: aliases, categories, links, embedded tables, typed cells, lookups."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import values as V
from quernstone.operators import graphs, markdown
from quernstone.operators.bands import band_join
from quernstone.operators.skew import salted_join
from quernstone.operators.windows import before_max
from quernstone.plans.registry import Registry
from quernstone.sources.tables import table as T

R = Registry()
query = R.query
_ALIAS = "(SELECT source_url, min(canonical_url) AS canonical_url FROM alias WHERE source_url <> canonical_url GROUP BY source_url)"


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """One target an alias; rows that map a page to itself say nothing."""
    return T(spark, d, "alias").where("source_url <> canonical_url").groupBy("source_url").agg(F.min("canonical_url").alias("canonical_url"))


@query("a01_resolve_alias", f"SELECT l.src, coalesce(a.canonical_url, l.dst) AS target, count(*) AS links FROM link l LEFT JOIN {_ALIAS} a ON l.dst = a.source_url GROUP BY ALL")
def a01(spark: SparkSession, d: str) -> DataFrame:
    """Links are counted by source and target before the join; what is left of a hot target is dealt to several tasks."""
    pairs = T(spark, d, "link").groupBy("src", "dst").agg(F.count("*").alias("n"))
    named = salted_join(pairs, aliases(spark, d), "dst", "source_url", 8, "left")
    return named.groupBy("src", F.coalesce("canonical_url", "dst").alias("target")).agg(F.sum("n").alias("links"))


@query("a02_category_members", "SELECT DISTINCT canonical_url FROM page WHERE list_contains(categories, 'Feats')")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "page").where(F.array_contains("categories", "Feats")).select("canonical_url").distinct()


@query("a03_pages_per_category", "SELECT category, count(DISTINCT canonical_url) AS pages FROM (SELECT canonical_url, unnest(categories) AS category FROM page) GROUP BY category")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "page").select("canonical_url", F.explode("categories").alias("category")).groupBy("category").agg(F.count_distinct("canonical_url").alias("pages"))


@query(
    "a03_pages_per_book",
    r"""SELECT book, count(DISTINCT canonical_url) AS pages FROM (SELECT canonical_url, unnest(regexp_extract_all(regexp_extract(body, '(?m)^\*Reference Books?: (.*)$', 1), '\[([^\]]*)\]', 1)) AS book
    FROM page WHERE body IS NOT NULL) GROUP BY book""",
)
def a03b(spark: SparkSession, d: str) -> DataFrame:
    books = F.regexp_extract_all(F.regexp_extract("body", r"(?m)^\*Reference Books?: ([^\n]*)$", 1), F.lit(r"\[([^\]]*)\]"), F.lit(1))
    return T(spark, d, "page").select("canonical_url", F.explode(books).alias("book")).groupBy("book").agg(F.count_distinct("canonical_url").alias("pages"))


@query("a04_missing_targets", "SELECT dst, count(*) AS links FROM link WHERE NOT EXISTS (SELECT 1 FROM page WHERE canonical_url = dst) GROUP BY dst")
def a04(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "page").select(F.col("canonical_url").alias("dst")).distinct()
    counts = T(spark, d, "link").groupBy("dst").agg(F.count("*").alias("links"))  # before the join: a hot target is one row
    return counts.join(p, "dst", "left_anti")


@query("a04_followed_links", "SELECT l.src, l.dst, min(p.page_id) AS page_id FROM (SELECT DISTINCT src, dst FROM link) l LEFT JOIN page p ON p.canonical_url = l.dst GROUP BY ALL")
def a04b(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "page").groupBy(F.col("canonical_url").alias("url")).agg(F.min("page_id").alias("page_id"))
    return salted_join(T(spark, d, "link").select("src", "dst").distinct(), p, "dst", "url", 8, "left").select("src", "dst", "page_id")


@query("a05_backlinks", "SELECT dst, count(*) AS links, count(DISTINCT src) AS pages, count(*) FILTER (WHERE is_red) AS red FROM link GROUP BY dst")
def a05(spark: SparkSession, d: str) -> DataFrame:
    per = T(spark, d, "link").groupBy("dst", "src").agg(F.count("*").alias("n"), F.count_if("is_red").alias("r"))
    return per.groupBy("dst").agg(F.sum("n").alias("links"), F.count("*").alias("pages"), F.sum("r").alias("red"))


_EDGES = r"""SELECT DISTINCT canonical_url AS src, target AS dst FROM (SELECT canonical_url, unnest(regexp_extract_all(regexp_extract(body, '(?m)^\*\*Prerequisites?:\*\* (.*)$', 1), '\]\(([^ ]*)', 1)) AS target
  FROM page WHERE body IS NOT NULL AND canonical_url IS NOT NULL) WHERE target IS NOT NULL"""


@query("a06_prerequisite_reach", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src WHERE depth < 4) SELECT src, dst, min(depth) AS depth FROM r GROUP BY ALL")
def a06(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all(F.regexp_extract("body", r"(?m)^\*\*Prerequisites?:\*\* ([^\n]*)$", 1), F.lit(r"\]\(([^ ]*)"), F.lit(1))
    edges = T(spark, d, "page").where("canonical_url IS NOT NULL").select(F.col("canonical_url").alias("src"), F.explode(found).alias("dst"))
    return graphs.reach(edges, "src", "dst", 4)


@query(
    "a07_prerequisites_met",
    r"""SELECT page_id, len(p) AS clauses, list_bool_and(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '\d+$') THEN TRY_CAST(regexp_extract(x, '(\d+)$', 1) AS INTEGER) <= 25 END)) AS met FROM (
    SELECT page_id, list_transform(string_split(regexp_replace(regexp_extract(body, '(?m)^\*\*Prerequisites?:\*\* (.*)$', 1), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), ', '), lambda x: trim(x)) AS p
    FROM page WHERE regexp_matches(body, '(?m)^\*\*Prerequisites?:\*\* .'))""",
)
def a07(spark: SparkSession, d: str) -> DataFrame:
    """Whether someone with 25 in every score meets all clauses; a clause that is no number is unknown, so it never counts as met."""
    line = F.regexp_extract("body", r"(?m)^\*\*Prerequisites?:\*\* ([^\n]*)$", 1)
    p = T(spark, d, "page").where(F.col("body").rlike(r"(?m)^\*\*Prerequisites?:\*\* .")).select("page_id", F.transform(F.split(F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1"), ", "), lambda x: F.trim(x)).alias("p"))
    met = F.transform("p", lambda x: F.when(x.rlike(r"\d+$"), F.regexp_extract(x, r"(\d+)$", 1).try_cast("int") <= 25))
    known = F.filter(met, lambda x: x.isNotNull())
    return p.select("page_id", F.size("p").cast("bigint").alias("clauses"), F.when(F.size(known) > 0, F.forall(known, lambda x: x)).alias("met"))


@query(
    "a08_multi_valued",
    "SELECT kind, count(*) AS weapons FROM (SELECT trim(unnest(string_split(availability, ','))) AS kind FROM weapon WHERE availability IS NOT NULL) WHERE kind <> '' GROUP BY kind",
)
def a08(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "weapon").select(F.explode(V.items(F.col("availability"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("weapons"))


_LINES = "(SELECT page_id AS id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM page WHERE body IS NOT NULL)"


@query(
    "a09_index_tables",
    rf"""WITH r AS (SELECT id, pos, list_transform(string_split(regexp_replace(line, '^\s*\||\|\s*$', '', 'g'), '|'), lambda x: trim(x)) AS cells, regexp_matches(line, '^[\s|:-]*-[\s|:-]*$') AS rule FROM {_LINES} WHERE regexp_matches(line, '^\s*\|.*\|\s*$')),
    h AS (SELECT *, coalesce(lead(rule) OVER w AND lead(pos) OVER w = pos + 1, false) AND NOT rule AS head FROM r WINDOW w AS (PARTITION BY id ORDER BY pos)),
    m AS (SELECT *, CAST(sum(head::INTEGER) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS table_no FROM h),
    b AS (SELECT id, table_no, cells, first_value(cells) OVER t AS names, CAST(row_number() OVER t - 1 AS INTEGER) AS row_no FROM m WHERE table_no > 0 AND NOT rule WINDOW t AS (PARTITION BY id, table_no ORDER BY pos)),
    c AS (SELECT id, table_no, row_no, unnest(names[1:len(cells)]) AS col_name, unnest(cells[1:len(names)]) AS value FROM b WHERE row_no > 0)
    SELECT * FROM c WHERE col_name IS NOT NULL AND col_name <> '' AND value IS NOT NULL""",
)
def a09(spark: SparkSession, d: str) -> DataFrame:
    """Cells of all embedded tables in long form."""
    return markdown.table_cells(T(spark, d, "page"), "page_id", "body")


@query("a10_catalogue", "SELECT DISTINCT name, cost, size FROM weapon WHERE size IN ('Small', 'Medium') AND cost BETWEEN 200 AND 900 AND damage_type LIKE '%Energy%'")
def a10(spark: SparkSession, d: str) -> DataFrame:
    keep = F.col("size").isin("Small", "Medium") & F.col("cost").between(200, 900) & F.col("damage_type").contains("Energy")
    return T(spark, d, "weapon").where(keep).select("name", "cost", "size").distinct()


@query("a11_union_by_name", "SELECT name, NULL AS source FROM weapon WHERE source IS NULL UNION ALL SELECT name, source FROM weapon WHERE source IS NOT NULL")
def a11(spark: SparkSession, d: str) -> DataFrame:
    w = T(spark, d, "weapon")
    return w.where("source IS NULL").select("name").unionByName(w.where("source IS NOT NULL").select("name", "source"), allowMissingColumns=True)


@query("d01_canonical_pages", "SELECT canonical_url, max(retrieved_at_utc) AS latest, count(*) AS fetches FROM page GROUP BY canonical_url")
def d01(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "page").groupBy("canonical_url").agg(F.max("retrieved_at_utc").alias("latest"), F.count("*").alias("fetches"))


@query("d02_latest_revision", "SELECT canonical_url, page_id FROM page QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY retrieved_at_utc DESC NULLS LAST, page_id DESC) = 1")
def d02(spark: SparkSession, d: str) -> DataFrame:
    best = F.max(F.struct(F.col("retrieved_at_utc").isNotNull(), "retrieved_at_utc", "page_id"))
    return T(spark, d, "page").groupBy("canonical_url").agg(best.alias("b")).select("canonical_url", "b.page_id")


@query("d03_page_categories", "SELECT DISTINCT canonical_url, unnest(categories) AS category FROM page WHERE canonical_url IS NOT NULL")
def d03(spark: SparkSession, d: str) -> DataFrame:
    """Membership as a table of its own, one row a page and category, whatever the number of fetches."""
    return T(spark, d, "page").where("canonical_url IS NOT NULL").select("canonical_url", F.explode("categories").alias("category")).distinct()


@query("d04_sections", r"SELECT page_id, count(*) AS headings, max(length(regexp_extract(line, '^(#{1,6})', 1)))::BIGINT AS deepest FROM (SELECT page_id, unnest(string_split(body, chr(10))) AS line FROM page) WHERE regexp_matches(line, '^#{1,6}\s+\S') GROUP BY page_id")
def d04(spark: SparkSession, d: str) -> DataFrame:
    s = markdown.sections(T(spark, d, "page"), "page_id", "body")
    return s.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("headings"), F.max("level").cast("bigint").alias("deepest"))


_FIELD = r"^\s*(?:[-*]\s+)?\*{1,2}([^*:\n]+):\*{0,2}\s*(.*?)\*{0,2}\s*$"


@query("d05_labelled_fields", rf"SELECT id, regexp_extract(line, '{_FIELD}', 1) AS label, regexp_extract(line, '{_FIELD}', 2) AS value, CAST(pos AS INTEGER) AS pos FROM {_LINES} WHERE regexp_matches(line, '{_FIELD}')")
def d05(spark: SparkSession, d: str) -> DataFrame:
    return markdown.fields(T(spark, d, "page"), "page_id", "body")


_LINK = r'\[([^\[\]\n]*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+"([^"\n]*)")?\s*\)'


@query(
    "d09_links_of_pages",
    rf"""SELECT id, regexp_extract(x, '{_LINK}', 1) AS anchor, regexp_replace(regexp_extract(x, '{_LINK}', 2), '\?action=edit&redlink=1$', '') AS target, suffix(regexp_extract(x, '{_LINK}', 2), 'redlink=1') AS missing
    FROM (SELECT page_id AS id, unnest(regexp_extract_all(body, '{_LINK}', 0)) AS x FROM page WHERE body IS NOT NULL)""",
)
def d09(spark: SparkSession, d: str) -> DataFrame:
    return markdown.links(T(spark, d, "page"), "page_id", "body")


@query(
    "v01_dice",
    r"""SELECT name, damage, n, sides, mul, round((n * (sides + 1) / 2.0) * mul, 2) AS mean FROM (SELECT name, damage, CAST(regexp_extract(damage, '^(\d+)d(\d+)', 1) AS INTEGER) AS n, CAST(regexp_extract(damage, '^(\d+)d(\d+)', 2) AS INTEGER) AS sides,
    coalesce(TRY_CAST(regexp_extract(damage, 'x(\d+)$', 1) AS INTEGER), 1) AS mul FROM weapon WHERE regexp_matches(damage, '^\d+d\d+(x\d+)?$'))""",
)
def v01(spark: SparkSession, d: str) -> DataFrame:
    w = T(spark, d, "weapon").select("name", "damage", V.dice(F.col("damage")).alias("d")).where("d IS NOT NULL")
    return w.select("name", "damage", "d.n", "d.sides", "d.mul", F.round(V.mean_roll(F.col("d")), 2).alias("mean"))


@query("v02_alternatives", r"SELECT name, len(list_filter(string_split(damage, ' or '), lambda x: regexp_matches(x, '^\s*\d+d\d+(x\d+)?\s*$'))) AS choices FROM weapon WHERE damage IS NOT NULL")
def v02(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "weapon").where("damage IS NOT NULL").select("name", F.size(V.alternatives(F.col("damage"))).cast("bigint").alias("choices"))


@query("v03_footnotes", r"SELECT name, regexp_replace(trim(name), '([^\d\s,])\d+(,\d+)*$', '\1') AS plain FROM weapon WHERE name IS NOT NULL")
def v03(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "weapon").where("name IS NOT NULL").select("name", V.without_footnote(F.col("name")).alias("plain"))


_GROUPS = ["Rifles", "Pistols", "Thrown Charges", "Heavy Weapons", "Clubs"]


@query(
    "c02_range_penalty",
    f"""SELECT event_id, weapon_group, band, penalty FROM (SELECT event_id, (event_id * 31) % 220 AS dist, ({_GROUPS})[event_id % 5 + 1] AS g FROM events) LEFT JOIN range_band ON g = weapon_group AND dist BETWEEN lo AND hi""",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    """Each event is a shot with a weapon group and a distance; bands differ by group, and one group has none."""
    shots = T(spark, d, "events").select("event_id", (F.col("event_id") * 31 % 220).alias("dist"), F.get(F.array(*map(F.lit, _GROUPS)), (F.col("event_id") % 5).cast("int")).alias("g"))
    return band_join(shots, T(spark, d, "range_band"), "dist", "lo", "hi", 50, [("g", "weapon_group")], how="left").select("event_id", "weapon_group", "band", "penalty")


@query("k01_crawl_lag", "SELECT page_id, epoch_us(loaded_at) - epoch_us(retrieved_at_utc) AS lag_us FROM page WHERE loaded_at - retrieved_at_utc > INTERVAL 1 DAY")
def k01(spark: SparkSession, d: str) -> DataFrame:
    lag = F.unix_micros("loaded_at") - F.unix_micros("retrieved_at_utc")
    return T(spark, d, "page").select("page_id", lag.alias("lag_us")).where("lag_us > 86400000000")


@query("k02_exact_duplicates", "SELECT md5(body) AS hash, count(*) AS copies, min(page_id) AS first FROM page WHERE body IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def k02(spark: SparkSession, d: str) -> DataFrame:
    g = T(spark, d, "page").where("body IS NOT NULL").groupBy(F.md5("body").alias("hash")).agg(F.count("*").alias("copies"), F.min("page_id").alias("first"))
    return g.where("copies > 1")


@query("k03_hosts_share", "SELECT source_host, count(*) AS pages, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM page_raw GROUP BY source_host")
def k03(spark: SparkSession, d: str) -> DataFrame:
    g = T(spark, d, "page_raw").groupBy("source_host").agg(F.count("*").alias("pages"))
    total = g.agg(F.sum("pages").alias("total")).scalar()
    return g.select("source_host", "pages", F.round(F.col("pages") / total, 6).alias("share"))


@query("k04_raters_agree", "SELECT doc_id, count(*) AS ratings, sum(toxic)::BIGINT AS toxic, min(toxic) = max(toxic) AS agree FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id")
def k04(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "labels").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("ratings"), F.sum("toxic").alias("toxic"), (F.min("toxic") == F.max("toxic")).alias("agree"))


@query("k05_late_fetches", "SELECT page_id FROM (SELECT page_id, retrieved_at_utc, max(retrieved_at_utc) OVER (PARTITION BY source_host ORDER BY loaded_at, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM page) WHERE retrieved_at_utc < seen - INTERVAL 1 HOUR")
def k05(spark: SparkSession, d: str) -> DataFrame:
    """One wiki's pages are one host: its order is cut into ranges, and the latest time of earlier ranges is carried on."""
    p = before_max(T(spark, d, "page").select("page_id", "source_host", "loaded_at", "retrieved_at_utc"), ["source_host"], ["loaded_at", "page_id"], "retrieved_at_utc", "seen")
    return p.where(F.col("retrieved_at_utc") < F.col("seen") - F.expr("INTERVAL 1 HOUR")).select("page_id")


QUERIES, ORACLES = R.queries, R.oracles
