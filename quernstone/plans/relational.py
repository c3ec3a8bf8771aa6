"""Relational queries over the star schema: scans, projections, filters, joins, aggregates, windows, sets, top-k.

Each has the same result in DuckDB. Sums of doubles are rounded, as the order of addition isn't fixed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.operators.bands import band_join
from quernstone.operators.asof import asof_join
from quernstone.operators.intervals import overlap_join
from quernstone.operators.windows import groups_frame_sum, quantiles
from quernstone.plans.registry import Registry
from quernstone.sources.tables import table as T

R = Registry()
query = R.query


def r2(c):
    return F.round(c, 2)


@query(
    "q01_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def q01(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        r2(F.sum("l_quantity")).alias("sum_qty"), r2(F.sum("l_extendedprice")).alias("sum_base"), r2(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(
    "q02_project_cast",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS qty, upper(l_returnflag) || '-' || l_linestatus AS flag, try_cast(l_returnflag AS INTEGER) AS bad
    FROM lineitem""",
)
def q02(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("qty"), F.concat(F.upper("l_returnflag"), F.lit("-"), "l_linestatus").alias("flag"), F.col("l_returnflag").try_cast("int").alias("bad")
    )


@query(
    "q03_filter_forms",
    """SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#34') AND p_name LIKE '%a%'
    AND regexp_matches(p_type, '[A-Z]') AND p_retailprice IS NOT NULL AND p_brand IS NOT DISTINCT FROM p_brand""",
)
def q03(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "part")
    keep = F.col("p_size").between(10, 20) & F.col("p_brand").isin("Brand#12", "Brand#23", "Brand#34") & F.col("p_name").like("%a%") & F.col("p_type").rlike("[A-Z]") & F.col("p_retailprice").isNotNull()
    return p.where(keep & F.col("p_brand").eqNullSafe(F.col("p_brand"))).select("p_partkey", "p_name", "p_size")


@query(
    "q04_case_coalesce",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
    coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_acctbal, 0.0) AS at_least, least(c_acctbal, 1000.0) AS at_most FROM customer""",
)
def q04(spark: SparkSession, d: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return T(spark, d, "customer").select(
        "c_custkey", F.when(bal < 0, "debt").when(bal < 5000, "low").otherwise("high").alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"),
        F.greatest(bal, F.lit(0.0)).alias("at_least"), F.least(bal, F.lit(1000.0)).alias("at_most"),
    )


@query("q05_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q05(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("q06_first_per_key", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query(
    "q07_pivot",
    """SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS open, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS filled
    FROM lineitem GROUP BY l_returnflag""",
)
def q07(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(r2(F.sum("l_quantity")))
    return p.select("l_returnflag", F.col("O").alias("open"), F.col("F").alias("filled"))


@query("q08_unpivot", "SELECT c_custkey, attribute, val FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer) UNPIVOT (val FOR attribute IN (c_name, c_mktsegment))")
def q08(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "customer").unpivot("c_custkey", ["c_name", "c_mktsegment"], "attribute", "val").where("val IS NOT NULL")


@query("q09_pipe", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def q09(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("FROM {t} |> WHERE n_nationkey > 3 |> AGGREGATE count(*) AS n GROUP BY n_regionkey", t=T(spark, d, "nation"))


@query("q10_inner_join", "SELECT o_orderkey, c_name, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def q10(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").where("o_totalprice > 300000")
    return o.join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", r2(F.col("o_totalprice")).alias("price"))


@query(
    "q11_outer_joins",
    """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey""",
)
def q11(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").where("o_totalprice > 200000")
    return T(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query(
    "q12_full_outer",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a
    FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) b ON a.k = b.k""",
)
def q12(spark: SparkSession, d: str) -> DataFrame:
    a = T(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = T(spark, d, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full").select("k", "suppliers", "customers")


@query("q13_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q13(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return T(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("q14_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def q14(spark: SparkSession, d: str) -> DataFrame:
    o = T(spark, d, "orders").where("o_totalprice > 100000")
    return T(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("q15_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def q15(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT n_nationkey FROM {n} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {s} WHERE s_acctbal > 9000)", n=T(spark, d, "nation"), s=T(spark, d, "supplier"))


@query("q16_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def q16(spark: SparkSession, d: str) -> DataFrame:
    n = T(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query(
    "q17_band_join",
    """WITH bands(lo, hi, label) AS (VALUES (0, 999, 'small'), (1000, 4999, 'middle'), (5000, NULL, 'large'))
    SELECT c_custkey, label FROM customer JOIN bands ON floor(c_acctbal) >= lo AND (hi IS NULL OR floor(c_acctbal) <= hi)""",
)
def q17(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([(0, 999, "small"), (1000, 4999, "middle"), (5000, None, "large")], "lo int, hi int, label string")
    c = T(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("v"))
    return band_join(c, bands, "v", "lo", "hi", width=1000).select("c_custkey", "label")


@query(
    "q18_asof_join",
    """SELECT e.event_id, p.event_id AS purchase FROM events e ASOF JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events
    WHERE event_type = 'purchase') WHERE k = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'""",
)
def q18(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return asof_join(left, right, "ts", by="user_id", tie="purchase").where("purchase IS NOT NULL").select("event_id", "purchase")


@query(
    "q19_overlap_join",
    """WITH a AS (SELECT event_id AS id, user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events WHERE event_type = 'purchase'),
    b AS (SELECT event_id AS other, user_id, ts AS bs, ts + INTERVAL 45 MINUTE AS be FROM events WHERE event_type = 'click')
    SELECT id, other FROM a JOIN b ON a.user_id = b.user_id AND s < be AND bs < e""",
)
def q19(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events")
    sec = lambda m: F.unix_micros(F.col("ts").cast("timestamp")) + F.lit(m * 60_000_000)
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", sec(0).alias("s"), sec(30).alias("e"))
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("other"), F.col("user_id").alias("u"), sec(0).alias("bs"), sec(45).alias("be"))
    return overlap_join(a, b, ("s", "e"), ("bs", "be"), width=3_600_000_000, on=[("user_id", "u")]).select("id", "other")


@query(
    "q20_lateral",
    """SELECT n_name, x.c_custkey, x.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x""",
)
def q20(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT n_name, x.c_custkey, x.c_acctbal FROM {n}, LATERAL (SELECT c_custkey, c_acctbal FROM {c} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x",
        n=T(spark, d, "nation"), c=T(spark, d, "customer"),
    )


@query(
    "q21_recursive",
    """WITH RECURSIVE r(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 24 UNION ALL SELECT n_nationkey, depth + 1 FROM r JOIN nation ON n_nationkey = k // 2 WHERE k > 0)
    SELECT k, depth FROM r""",
)
def q21(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "WITH RECURSIVE r(k, depth) AS (SELECT n_nationkey, 0 FROM {n} WHERE n_nationkey = 24 UNION ALL SELECT n_nationkey, depth + 1 FROM r JOIN {n} ON n_nationkey = cast(k div 2 AS int) WHERE k > 0) SELECT k, depth FROM r",
        n=T(spark, d, "nation"),
    )


@query(
    "q22_correlated",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)""",
)
def q22(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM {l} l WHERE l_quantity < (SELECT 0.5D * avg(l_quantity) FROM {l} i WHERE i.l_partkey = l.l_partkey)", l=T(spark, d, "lineitem")
    )


@query(
    "q23_basic_aggregates",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high,
    round(stddev_samp(value), 4) AS sd, round(var_pop(value), 4) AS var, round(corr(value, user_id), 4) AS corr, bool_or(value > 50) AS some, bool_and(value >= 0) AS every_one FROM events GROUP BY event_type""",
)
def q23(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), r2(F.sum("value")).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.var_pop("value"), 4).alias("var"), F.round(F.corr("value", "user_id"), 4).alias("corr"), F.some(F.col("value") > 50).alias("some"), F.every(F.col("value") >= 0).alias("every_one"),
    )


@query(
    "q24_conditional",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders GROUP BY 1""",
)
def q24(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.sum(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)).alias("large"))


@query(
    "q25_quantiles",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, mode(l_quantity) IS NOT NULL AS has_mode FROM lineitem GROUP BY 1",
)
def q25(spark: SparkSession, d: str) -> DataFrame:
    """Three groups hold all rows: exact quantiles come from counted, range-partitioned values, and the mode from counts."""
    li = T(spark, d, "lineitem")
    q = quantiles(li, "l_returnflag", "l_extendedprice", {"median": 0.5, "p90": 0.9})
    often = li.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(F.max_by("l_quantity", F.when(F.col("l_quantity").isNotNull(), F.col("n"))).isNotNull().alias("has_mode"))
    return q.join(often, "l_returnflag").select("l_returnflag", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "has_mode")


@query("q26_approximate")
def q26(spark: SparkSession, d: str) -> DataFrame:
    """Sketch-based aggregates; tests hold them within their error bounds of the exact ones."""
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.approx_percentile("l_extendedprice", 0.5, 10000).alias("median"), F.expr("approx_top_k(l_quantity, 3)").alias("frequent")
    )


@query(
    "q27_collections",
    """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, max_by(n_name, n_nationkey) AS last, min_by(n_name, n_nationkey) AS first, count(DISTINCT substr(n_name, 1, 1)) AS initials
    FROM nation GROUP BY n_regionkey""",
)
def q27(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.max_by("n_name", "n_nationkey").alias("last"), F.min_by("n_name", "n_nationkey").alias("first"),
        F.size(F.collect_set(F.substring("n_name", 1, 1))).cast("bigint").alias("initials"),
    )


@query(
    "q28_grouping_sets",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
)
def q28(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(grouping(l_returnflag) AS bigint) AS g FROM {l} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", l=T(spark, d, "lineitem")
    )


@query("q29_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q29(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("q30_rollup_having", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING count(*) > 100")
def q30(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 100")


_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"


@query(
    "q31_ranking",
    f"""SELECT o_orderkey, CAST(row_number() {_W} AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS rk,
    CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS dr, CAST(ntile(4) {_W} AS INTEGER) AS quarter, round(percent_rank() {_W}, 6) AS pr, round(cume_dist() {_W}, 6) AS cd FROM orders""",
)
def q31(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by status, of which there are three, come from the counts of its few priorities; only ranks by customer sort the table."""
    w, s = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), W.partitionBy("o_orderstatus").orderBy("o_orderpriority")
    o = T(spark, d, "orders")
    kinds = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    places = kinds.select(
        F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pri"), (F.coalesce(F.sum("n").over(s.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int").alias("rk"), F.row_number().over(s).alias("dr")
    )
    o = o.join(places, F.col("o_orderstatus").eqNullSafe(F.col("st")) & F.col("o_orderpriority").eqNullSafe(F.col("pri")))
    return o.select(
        "o_orderkey", F.row_number().over(w).alias("rn"), "rk", "dr", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"),
        F.round(F.cume_dist().over(w), 6).alias("cd"),
    )


@query(
    "q32_offsets",
    f"""SELECT o_orderkey, lag(o_totalprice) {_W} AS prev, lead(o_totalprice, 2, 0.0) {_W} AS later, first_value(o_orderkey) {_W} AS first,
    nth_value(o_orderkey, 2) {_W} AS second, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) {_W} AS last_filled FROM orders""",
)
def q32(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return T(spark, d, "orders").select(
        "o_orderkey", F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_totalprice", 2, 0.0).over(w).alias("later"), F.first("o_orderkey").over(w).alias("first"), F.nth_value("o_orderkey", 2).over(w).alias("second"),
        F.last(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), ignorenulls=True).over(w).alias("last_filled"),
    )


@query(
    "q33_frames",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rows3,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events""",
)
def q33(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rows3,
        count(*) OVER (PARTITION BY user_id ORDER BY cast(ts AS timestamp) RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM {e}""",
        e=T(spark, d, "events"),
    )


@query(
    "q34_groups_frame",
    """SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS near FROM orders""",
)
def q34(spark: SparkSession, d: str) -> DataFrame:
    return groups_frame_sum(T(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", 1, 0, "near").select("o_orderkey", "near")


@query("q35_qualify", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def q35(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return T(spark, d, "customer").withColumn("k", F.row_number().over(w)).where("k <= 3").select("c_nationkey", "c_custkey")


@query("q36_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5")
def q36(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(5).limit(25).select("o_orderkey", "o_totalprice")


@query("q37_sort_nulls", "SELECT doc_id, lang, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS place FROM (SELECT * FROM documents) WHERE n_chars IS NULL OR n_chars < 200")
def q37(spark: SparkSession, d: str) -> DataFrame:
    """A global order as places, by range partitions and their counts instead of one task."""
    from quernstone.operators.windows import global_place

    docs = T(spark, d, "documents").where("n_chars IS NULL OR n_chars < 200").select("doc_id", "lang")
    return global_place(docs, [F.asc_nulls_first("lang"), F.asc("doc_id")], "place")


@query("q38_union_all", "SELECT s_name AS name, 's' AS kind FROM supplier UNION ALL SELECT c_name, 'c' FROM customer")
def q38(spark: SparkSession, d: str) -> DataFrame:
    s = T(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind"))
    return s.unionByName(T(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("c").alias("kind")))


@query("q39_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def q39(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(T(spark, d, "customer").select("c_nationkey")).distinct()


@query("q40_intersect_all", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer")
def q40(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersectAll(T(spark, d, "customer").select("c_nationkey"))


@query("q41_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def q41(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(T(spark, d, "supplier").select("s_nationkey"))


@query("q42_except_intersect", "(SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0) INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def q42(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer")
    return T(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(c.where("c_acctbal < 0").select("c_custkey")).intersect(c.where("c_nationkey < 12").select("c_custkey"))


@query(
    "q43_strings",
    """SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS n, substr(p_name, 2, 5) AS part, regexp_extract(p_brand, '([0-9])([0-9])', 1) AS tens, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked,
    string_split(p_type, ' ')[1] AS first_word, concat_ws('/', p_brand, p_type) AS both, CAST(levenshtein(p_brand, 'Brand#11') AS INTEGER) AS dist, reverse(p_brand) AS rev, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded FROM part""",
)
def q43(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").alias("n"), F.substring("p_name", 2, 5).alias("part"), F.regexp_extract("p_brand", "([0-9])([0-9])", 1).alias("tens"),
        F.regexp_replace("p_type", "[AEIOU]", "_").alias("masked"), F.split("p_type", " ")[0].alias("first_word"), F.concat_ws("/", "p_brand", "p_type").alias("both"), F.levenshtein("p_brand", F.lit("Brand#11")).alias("dist"),
        F.reverse("p_brand").alias("rev"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
    )


@query(
    "q44_dates",
    """SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(o_orderdate AS DATE) + 30 AS due, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days,
    extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, strftime(o_orderdate, '%Y-%m') AS ym, last_day(o_orderdate) AS month_end FROM orders""",
)
def q44(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return T(spark, d, "orders").select(
        "o_orderkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), F.date_add(day, 30).alias("due"), F.datediff(day, F.lit("1992-01-01").cast("date")).cast("bigint").alias("days"),
        F.year("o_orderdate").cast("bigint").alias("y"), F.quarter("o_orderdate").cast("bigint").alias("q"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.last_day(day).alias("month_end"),
    )


@query(
    "q45_math",
    """SELECT s_suppkey, floor(s_acctbal / 10)::BIGINT AS tens, ceil(s_acctbal)::BIGINT AS up, round(s_acctbal, 1) AS r, abs(s_acctbal) AS size, round(sqrt(abs(s_acctbal)), 6) AS root,
    round(ln(1 + abs(s_acctbal)), 6) AS ln, s_suppkey % 7 AS rest, power(2, s_suppkey % 5)::DOUBLE AS p, sign(s_acctbal)::INTEGER AS sgn FROM supplier""",
)
def q45(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("s_acctbal")
    return T(spark, d, "supplier").select(
        "s_suppkey", F.floor(b / 10).alias("tens"), F.ceil(b).alias("up"), F.round(b, 1).alias("r"), F.abs(b).alias("size"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.round(F.log1p(F.abs(b)), 6).alias("ln"),
        (F.col("s_suppkey") % 7).alias("rest"), F.pow(F.lit(2), F.col("s_suppkey") % 5).alias("p"), F.signum(b).cast("int").alias("sgn"),
    )


@query(
    "q46_arrays",
    """SELECT page_id, len(categories) AS n, list_sort(categories)[1] AS first, list_contains(categories, 'Feats') AS feats, array_to_string(list_transform(list_sort(categories), lambda x: upper(x)), '|') AS joined,
    len(list_filter(categories, lambda x: length(x) > 5)) AS long_ones FROM page WHERE categories IS NOT NULL""",
)
def q46(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("categories")
    return T(spark, d, "page").where("categories IS NOT NULL").select(
        "page_id", F.size(c).cast("bigint").alias("n"), F.get(F.array_sort(c), 0).alias("first"), F.array_contains(c, "Feats").alias("feats"), F.array_join(F.transform(F.array_sort(c), F.upper), "|").alias("joined"),
        F.size(F.filter(c, lambda x: F.length(x) > 5)).cast("bigint").alias("long_ones"),
    )


@query("q47_explode", "SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM page) GROUP BY category")
def q47(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "page").select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "q48_maps_structs",
    "SELECT s_suppkey, s_name || ':' || CAST(s_nationkey AS VARCHAR) AS pair, s_nationkey + 1 AS next FROM supplier",
)
def q48(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("name"), "s_name", F.lit("nation"), F.col("s_nationkey").cast("string"))
    s = F.named_struct(F.lit("k"), "s_nationkey")
    x = T(spark, d, "supplier").select("s_suppkey", F.transform_values(m, lambda k, v: F.trim(v)).alias("m"), s.alias("s"))
    return x.select("s_suppkey", F.concat_ws(":", F.element_at("m", "name"), F.element_at("m", "nation")).alias("pair"), (F.col("s.k") + 1).alias("next"))


@query("q49_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q49(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return T(spark, d, "events").select("event_id", F.coalesce(parsed["k"], F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


@query("q50_variant", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def q50(spark: SparkSession, d: str) -> DataFrame:
    k = F.expr("variant_get(parse_json(props), '$.k', 'bigint')")
    return T(spark, d, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "q51_vectors",
    """SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 5) AS cosine
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""",
)
def q51(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.functions.vectors import cosine

    e = T(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.withColumn("q", q.scalar()).select("vec_id", F.round(cosine("embedding", "q"), 5).alias("cosine"))


@query("q52_tablesample")
def q52(spark: SparkSession, d: str) -> DataFrame:
    """Bernoulli sampling with a fixed seed: the share drawn is near the share asked for."""
    o = T(spark, d, "orders")
    s = o.sample(0.1, seed=7).agg(F.count("*").alias("s")).scalar()
    return o.agg(F.count("*").alias("n")).select((F.abs(s / F.col("n") - 0.1) < 0.05).alias("within"))


@query(
    "q53_star_join",
    """SELECT r_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY ALL""",
)
def q53(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = T(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("r_name", "o_orderpriority").agg(r2(F.sum("v")).alias("revenue"))


@query(
    "q54_skewed_join",
    "SELECT event_type, count(*) AS n, count(DISTINCT e.user_id) AS users FROM events e JOIN (SELECT DISTINCT user_id FROM events WHERE value > 50) h ON e.user_id = h.user_id GROUP BY event_type",
)
def q54(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.operators.skew import salted_join

    e = T(spark, d, "events").select("user_id", "event_type")
    h = T(spark, d, "events").where("value > 50").select(F.col("user_id").alias("u")).distinct()
    return salted_join(e, h, "user_id", "u", salts=8).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("q55_sessions", "SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR gap > 1800000000) AS sessions FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id")
def q55(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = T(spark, d, "events").withColumn("us", us).withColumn("gap", F.col("us") - F.lag("us").over(w))
    return e.groupBy("user_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > 1_800_000_000)).alias("sessions"))


@query("q56_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def q56(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), r2(F.sum("value")).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "q57_sliding",
    """SELECT s AS start, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s""",
)
def q57(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("q58_session_window", "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL) GROUP BY user_id")
def q58(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("q59_udf_scalar", "SELECT s_suppkey, CAST(length(s_name) * 2 AS INTEGER) AS doubled, s_acctbal * 1.5 AS scaled FROM supplier")
def q59(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.functions.udfs import doubled_length, scale

    return T(spark, d, "supplier").select("s_suppkey", doubled_length("s_name").alias("doubled"), scale("s_acctbal").alias("scaled"))


@query("q60_udaf", "SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS span FROM customer GROUP BY 1")
def q60(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.functions.udfs import span

    return T(spark, d, "customer").groupBy("c_mktsegment").agg(r2(span("c_acctbal")).alias("span"))


@query("q61_udtf", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def q61(spark: SparkSession, d: str) -> DataFrame:
    from quernstone.functions.udfs import Words

    spark.udtf.register("words_of", Words)
    return spark.sql("SELECT p_partkey, w.word FROM {p}, LATERAL words_of(p_type) w", p=T(spark, d, "part"))


@query("q62_sql_function", "SELECT s_suppkey, CAST(floor((s_suppkey - 10) / 2.0) AS BIGINT) AS modifier FROM supplier")
def q62(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION half_above(x BIGINT) RETURNS BIGINT RETURN cast(floor((x - 10) / 2.0D) AS BIGINT)")
    return spark.sql("SELECT s_suppkey, half_above(s_suppkey) AS modifier FROM {s}", s=T(spark, d, "supplier"))


@query("q63_cross_join", "SELECT r_name, s.event_type, coalesce(n, 0) AS customers FROM region CROSS JOIN (SELECT DISTINCT event_type FROM events) s LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) c ON r_regionkey = n_regionkey")
def q63(spark: SparkSession, d: str) -> DataFrame:
    """All combinations of two small domains, five regions and the kinds of events, filled with counts made before."""
    kinds = T(spark, d, "events").select("event_type").distinct()
    n = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    grid = T(spark, d, "region").crossJoin(kinds)
    return grid.join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", "event_type", F.coalesce("n", F.lit(0)).alias("customers"))


@query("q64_sort_all_nulls", "SELECT doc_id, lang, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS place FROM documents")
def q64(spark: SparkSession, d: str) -> DataFrame:
    """The global order of the whole table."""
    from quernstone.operators.windows import global_place

    return global_place(T(spark, d, "documents").select("doc_id", "lang"), [F.asc_nulls_first("lang"), F.asc("doc_id")], "place")


@query(
    "q65_nearest_vectors",
    """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x) AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
    SELECT query, vec_id, cosine FROM (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(e.v, q.v) / (e.n * q.n), 5) AS cosine FROM u e JOIN u q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) <= 10""",
)
def q65(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors to every vector whose id is divisible by 100: exact scores in blocks, the best of each block and then of all."""
    from quernstone.functions.vectors import nearest

    e = T(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


QUERIES, ORACLES = R.queries, R.oracles
