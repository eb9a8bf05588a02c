"""Scans, joins, aggregates, windows, sets and upserts over the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import tabular
from .catalogue import query, table


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount >= 0.05 AND l_quantity < 24")
def scan_filter_project(spark, d):
    t = table(spark, d, "lineitem")
    return t.where((F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1995-01-01'")) & (F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1996-01-01'")) & (F.col("l_discount") >= 0.05) & (F.col("l_quantity") < 24)).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' AND starts_with(p_brand, 'Brand#1')")
def prefix_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_name").startswith("red") & F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def inlist_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS n_open,
coalesce(string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority), '') AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def optional_expand(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("p"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("open", F.lit(0)).alias("n_open"), F.coalesce("p", F.lit("")).alias("priorities"))


@query("""SELECT p_brand, band, count(*) AS n FROM part JOIN (SELECT i AS band, 900 + 100.0::DOUBLE * i AS lo, 1000 + 100.0::DOUBLE * i AS hi FROM range(0, 12) t(i)) b
ON p_retailprice >= lo AND p_retailprice < hi GROUP BY p_brand, band""")
def range_join(spark, d):
    bands = spark.range(12).select(F.col("id").alias("band"), (900 + 100.0 * F.col("id")).alias("lo"), (1000 + 100.0 * F.col("id")).alias("hi"))
    return tabular.range_join(table(spark, d, "part"), bands, "p_retailprice", "lo", "hi", 100.0).groupBy("p_brand", "band").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, string_agg(DISTINCT floor(value)::INTEGER::VARCHAR, ',' ORDER BY floor(value)::INTEGER::VARCHAR) AS vals, count(*) AS n FROM events
GROUP BY GROUPING SETS ((user_id, event_type), (event_type))""")
def words_pool_grouping_sets(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.floor("value").cast("int").cast("string").alias("v"))
    sets = e.groupingSets([["user_id", "event_type"], ["event_type"]], "user_id", "event_type")
    return sets.agg(F.array_join(F.sort_array(F.collect_set("v")), ",").alias("vals"), F.count("*").alias("n"))


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
def bbox_union(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@query("""SELECT user_id, round(avg(span), 9) AS mean_span, round(max(span), 9) AS most, count(*) AS days FROM (
SELECT user_id, CAST(ts AS DATE) AS d, least(1.0::DOUBLE, (max(value) - min(value)) / 100) AS span FROM events GROUP BY ALL) GROUP BY user_id""")
def span_ratio(spark, d):
    per = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.least(F.lit(1.0), (F.max("value") - F.min("value")) / 100).alias("span"))
    return per.groupBy("user_id").agg(F.round(F.avg("span"), 9).alias("mean_span"), F.round(F.max("span"), 9).alias("most"), F.count("*").alias("days"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.2), 4) AS p20 FROM orders GROUP BY o_orderpriority")
def percentile_breaks(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", F.lit(0.2)), 4).alias("p20"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O') AS open_parts, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY l_returnflag")
def distinct_filtered_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("open_parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("""WITH e AS (SELECT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM e WHERE a <> b GROUP BY ALL UNION ALL SELECT DISTINCT a, b, 1 FROM e WHERE a = b""")
def unordered_pair_count(spark, d):
    e = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return tabular.unordered_pairs(e.select("s_nationkey", "c_nationkey"), "s_nationkey", "c_nationkey")


@query("SELECT l_partkey, max(l_extendedprice) AS best, count(DISTINCT l_suppkey) AS n_topics FROM lineitem GROUP BY l_partkey")
def max_merge(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best"), F.count_distinct("l_suppkey").alias("n_topics"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def dedup_first(spark, d):
    return tabular.keep_one(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) AS k FROM lineitem) WHERE k = 1")
def dedup_last(spark, d):
    return tabular.keep_one(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS k FROM documents) WHERE k = 1""")
def dedup_longest(spark, d):
    t = table(spark, d, "documents").withColumn("k", F.concat_ws("|", "lang", "source"))
    return tabular.keep_longest(t, "k", "text", "doc_id").select("doc_id", "lang", "source")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topn_per_group(spark, d):
    return tabular.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q,
lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def window_functions(spark, d):
    w, t = W.partitionBy("o_custkey").orderBy("o_orderstatus"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.ntile(4).over(t).alias("q"), F.lead("o_orderkey").over(t).alias("next_order"), F.round(F.sum("o_totalprice").over(t.rowsBetween(-2, 0)), 2).alias("last3"))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def except_all_keys(spark, d):
    return table(spark, d, "part").select("p_partkey").exceptAll(table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"))


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name END AS c_name, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 1)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN n.c_name WHEN n.c_custkey IS NULL THEN o.c_name ELSE coalesce(n.c_name, o.c_name) END AS c_name,
CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal,
CASE WHEN o.c_custkey IS NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    old, key = c.where("c_custkey % 3 <> 0"), F.col("c_custkey")
    new = c.where("c_custkey % 3 <> 1").select("c_custkey", F.when(key % 2 == 0, F.concat(F.lit("new "), "c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return tabular.upsert(old, new, ["c_custkey"], {"c_acctbal": "overwrite", "c_mktsegment": "keep_first"})


@query("""WITH n AS (SELECT o_orderkey * 3 AS o_orderkey, 'new' AS o_orderstatus, NULL AS o_totalprice FROM orders WHERE o_custkey % 4 = 0), m AS (
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_totalprice FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, o_orderstatus, o_totalprice FROM m WHERE o_orderkey % 11 <> 5""")
def merged_table(spark, d):
    """A stored table of orders after a merge and a delete, each of which writes the buckets it touches."""
    from ..session import shared_path
    from ..sources.versioned import Versioned

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = Versioned(spark, shared_path(spark, "orders"))
    stored.replace(o, ["o_orderkey"])
    new = table(spark, d, "orders").where("o_custkey % 4 = 0").select((F.col("o_orderkey") * 3).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    stored.upsert(new, ["o_orderkey"], {})
    stored.delete(F.col("o_orderkey") % 11 == 5)
    return stored.read()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def delete_tenant(spark, d):
    from ..operators.graph import delete_graph

    return delete_graph(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "graph_id"), "BUILDING").select("c_custkey", F.col("graph_id").alias("c_mktsegment"))


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'P')) AS pending, round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*))::INTEGER AS percent FROM orders GROUP BY o_orderpriority""")
def status_progress(spark, d):
    return tabular.progress(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "P")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem),
i AS (SELECT *, sum(CASE WHEN r = 1 OR p <> l_returnflag THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS island FROM b)
SELECT l_orderkey, l_linenumber, island::BIGINT AS island, CAST(floor((row_number() OVER (PARTITION BY l_orderkey, island ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) / 2) AS INTEGER) AS part FROM i""")
def capped_runs(spark, d):
    t = table(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    w = W.partitionBy("l_orderkey").orderBy(*order)
    t = t.withColumn("_p", F.lag("l_returnflag").over(w))
    return tabular.capped_runs(t, ["l_orderkey"], order, F.col("_p") != F.col("l_returnflag"), 2).select("l_orderkey", "l_linenumber", "island", "part")


@query("""WITH p AS (SELECT o_custkey, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) // 30 AS BIGINT) AS page, o_orderkey FROM orders),
b AS (SELECT o_custkey, page, o_orderkey, CASE WHEN page - lag(page) OVER w = 1 THEN 0 ELSE 1 END AS s FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY page, o_orderkey)),
r AS (SELECT o_custkey, page, sum(s) OVER (PARTITION BY o_custkey ORDER BY page, o_orderkey) AS k FROM b), g AS (SELECT o_custkey, k, min(page) AS lo, max(page) AS hi FROM r GROUP BY o_custkey, k)
SELECT o_custkey, string_agg(CASE WHEN lo = hi THEN 'P' || lo ELSE 'P' || lo || '~P' || hi END, ', ' ORDER BY k) AS pages FROM g GROUP BY o_custkey""")
def islands_page_ranges(spark, d):
    page = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")) / 30).cast("long")
    return tabular.page_ranges(table(spark, d, "orders").select("o_custkey", page.alias("page")), ["o_custkey"], "page")


@query("SELECT s_suppkey, l_partkey, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL HAVING count(*) > 2")
def having_filter(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("s_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 2")


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o FROM orders GROUP BY o_orderpriority")
def pivot_status(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1))).select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query()
def approx_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 10000).alias("median"))


@query("SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_k_limit(spark, d):
    from ..operators.search import top_k

    return top_k(table(spark, d, "customer").where("c_acctbal > 5000"), [F.desc("c_acctbal"), F.col("c_custkey")], 25).select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("""WITH m AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source)
SELECT source, n, chars, chars::DOUBLE / n > 2500 AS long_texts, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS share FROM m""")
def source_distribution(spark, d):
    m = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return m.select("source", "n", "chars", (F.col("chars") / F.col("n") > 2500).alias("long_texts"), F.round(100.0 * F.col("n") / F.sum("n").over(whole), 6).alias("share"))
