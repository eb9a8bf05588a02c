"""Scans, set operators and scalar functions that the other modules of this folder leave out."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import plugins
from ..functions import ids, standards
from ..functions import text as tx
from ..operators import graph, records, tabular
from .catalogue import query, table
from .graph_queries import EDGES, star_edges

RULES = ["必须设置", "宜采用", "禁止堆放", "不得占用", "无", "必须不设", "不应设置"]
RULE = "CASE p_size % 7 WHEN 0 THEN '必须设置' WHEN 1 THEN '宜采用' WHEN 2 THEN '禁止堆放' WHEN 3 THEN '不得占用' WHEN 4 THEN '无' WHEN 5 THEN '必须不设' ELSE '不应设置' END"


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 100000000)")
def batch_lookup(spark, d):
    wanted = spark.createDataFrame([(1,), (5,), (9,), (100000000,)], "c_custkey long")
    return graph.lookup(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", wanted)


@query(f"WITH {EDGES} SELECT src, rel, dst, src = 'nation:1' AS outgoing FROM e WHERE src = 'nation:1' OR dst = 'nation:1'")
def edge_scan_undirected(spark, d):
    e = star_edges(spark, d).select("src", "rel", "dst").distinct()
    return e.where((F.col("src") == "nation:1") | (F.col("dst") == "nation:1")).withColumn("outgoing", F.col("src") == "nation:1")


@query("SELECT c_custkey, prop, val FROM (SELECT c_custkey, unnest([{'prop': 'name', 'val': c_name}, {'prop': 'segment', 'val': c_mktsegment}, {'prop': 'note', 'val': ''}], recursive := true) FROM customer) WHERE val <> ''")
def unpivot_properties(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("").alias("note"))
    return c.unpivot(["c_custkey"], ["name", "segment", "note"], "prop", "val").where("val <> ''")


@query("""WITH u AS (SELECT c_custkey, 0 AS g FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, min(g)::INTEGER AS g FROM u GROUP BY c_custkey""")
def cross_graph_keep_first(spark, d):
    c = table(spark, d, "customer")
    u = c.where("c_acctbal > 0").select("c_custkey", F.lit(0).alias("g")).union(c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(1)))
    return tabular.keep_one(u, ["c_custkey"], [F.col("g")])


@query("""WITH u AS (SELECT DISTINCT p_type AS name, 0 AS side FROM part UNION ALL SELECT DISTINCT lower(p_type), 1 FROM part UNION ALL SELECT DISTINCT p_brand, 1 FROM part)
SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY side, name) AS k FROM u) WHERE k = 1""")
def merge_types(spark, d):
    p = table(spark, d, "part")
    old = p.select(F.col("p_type").alias("name")).distinct()
    return records.merge_types(old, old.select(F.lower("name").alias("name")).union(p.select("p_brand")).distinct())


@query("""SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS siblings FROM lineitem""")
def parallel_edges(spark, d):
    w = W.partitionBy("l_suppkey", "l_partkey")
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", (F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_extendedprice")) - 1).alias("place"), F.count("*").over(w).alias("siblings"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_first(spark, d):
    return records.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 20, "o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, '?bboxes=' || url_encode('[[' || l_linenumber || ',' || l_partkey || ']]') AS link FROM lineitem")
def url_links(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("?bboxes="), F.url_encode(F.concat(F.lit("[["), "l_linenumber", F.lit(","), "l_partkey", F.lit("]]")))).alias("link"))


@query("SELECT page_id, regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1) AS file, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/?#]+)(?:[?#].*)?$", 1).alias("file"), F.lower(F.regexp_extract("url", "\\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).alias("ext"))


@query("SELECT item_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')), ['in', 'of', 'that', 'the'])) / 4.0::DOUBLE AS score FROM benchmark")
def overlap_score(spark, d):
    return plugins.score(table(spark, d, "benchmark"), "the of in that", "text").select("item_id", "score")


@query("SELECT doc_id, lang AS kind FROM documents")
def entity_types(spark, d):
    return table(spark, d, "documents").select("doc_id", graph.entity_type(F.array(F.lit("Entity"), "lang", F.lit("Node"))).alias("kind"))


@query("SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms // 1000 < 60 THEN ms // 1000 || 's' ELSE ms // 60000 || 'm ' || (ms // 1000) % 60 || 's' END AS took FROM (SELECT event_id, (floor(value) * 1000)::BIGINT AS ms FROM events)")
def duration_texts(spark, d):
    return table(spark, d, "events").select("event_id", standards.duration_text((F.floor("value") * 1000).cast("long")).alias("took"))


@query("""SELECT id, CASE WHEN len(string_split(id, '.')) = 3 THEN regexp_replace(id, '\\.[^.]+$', '') WHEN len(string_split(id, '.')) = 2 THEN CASE WHEN regexp_full_match(split_part(id, '.', 1), '[A-Za-z]+') THEN split_part(id, '.', 1) WHEN p > 0 THEN id ELSE split_part(id, '.', 1) END ELSE id END AS scope
FROM (SELECT DISTINCT p_size % 7 || '.' || p_size % 3 || CASE WHEN p_size % 2 = 0 THEN '.' || p_size % 5 ELSE '' END AS id, p_size % 3 AS p FROM part)""")
def scope_prefixes(spark, d):
    s = F.col("p_size")
    p = table(spark, d, "part").select(F.concat_ws(".", s % 7, s % 3, F.when(s % 2 == 0, s % 5)).alias("id"), (s % 3).alias("p")).distinct()
    return p.select("id", standards.scope_prefix(F.col("id"), F.col("p") > 0).alias("scope"))


@query(f"SELECT p_partkey, CASE WHEN t LIKE '%严禁%' OR t LIKE '%禁止%' OR t LIKE '%不得%' OR t LIKE '%不应%' OR t LIKE '%必须不%' THEN 'prohibited' WHEN t LIKE '%必须%' OR t LIKE '%应%' THEN 'mandatory' ELSE 'recommended' END AS a, CASE WHEN t LIKE '%必须%' OR t LIKE '%应%' OR t LIKE '%不得%' OR t LIKE '%不应%' THEN 'mandatory' WHEN t LIKE '%宜%' OR t LIKE '%可%' THEN 'recommended' WHEN t LIKE '%严禁%' OR t LIKE '%禁止%' THEN 'prohibited' END AS b FROM (SELECT p_partkey, {RULE} AS t FROM part)")
def requirement_types(spark, d):
    t = F.element_at(F.array(*map(F.lit, RULES)), F.col("p_size") % 7 + 1)
    return table(spark, d, "part").select("p_partkey", tx.requirement_first_ban(t).alias("a"), tx.requirement_first_must(t).alias("b"))


@query("""WITH f AS (SELECT doc_id, text, regexp_replace(split_part(text, chr(10), 1), '^[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x0B]+|[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x0B]+$', '', 'g') AS line FROM documents)
SELECT doc_id, 'CL_' || substr(md5(text), 1, 8) AS chunk_id, CASE WHEN length(line) > 100 THEN substr(line, 1, 100) || '...' ELSE line END AS title FROM f""")
def chunk_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.chunk_id("CL", F.col("text")).alias("chunk_id"), standards.title(F.col("text")).alias("title"))


@query("SELECT source, lang, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source, lang")
def ordered_concat(spark, d):
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").groupBy("source", "lang").agg(ordered.alias("ids"), F.sum(F.length("text")).alias("chars"))


@query("SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE c_acctbal < 0) AS expired, count(*) FILTER (WHERE c_acctbal >= 0) AS active, round(max(c_acctbal), 2) AS best FROM customer GROUP BY c_nationkey")
def conditional_partition(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("expired"), F.count_if(F.col("c_acctbal") >= 0).alias("active"), F.round(F.max("c_acctbal"), 2).alias("best"))


@query("SELECT r_name, n_name, count(c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def group_join_chapters(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers")), "n_nationkey", "left")
    return table(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))
