"""Graph operators over the star schema read as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import edge_id, node_id, uuid_of
from ..functions.text import natural_key, parent_id
from ..operators import graph, ordered, retrieval
from .catalogue import query, table


def keyed_edges(spark, d):
    """All foreign keys as typed edges, an end as its kind and key."""
    pairs = [("nation", "n_nationkey", "region", "n_regionkey", "IN_REGION"), ("customer", "c_custkey", "nation", "c_nationkey", "LIVES_IN"), ("supplier", "s_suppkey", "nation", "s_nationkey", "BASED_IN"), ("orders", "o_orderkey", "customer", "o_custkey", "ORDERED_BY"), ("lineitem", "l_orderkey", "part", "l_partkey", "CONTAINS")]
    name = {"nation": "nation", "customer": "customer", "supplier": "supplier", "orders": "order", "lineitem": "order"}
    out = None
    for t, a, target, b, rel in pairs:
        e = table(spark, d, t).select(F.lit(name[t]).alias("src_kind"), F.col(a).cast("long").alias("src_key"), F.lit(rel).alias("rel"), F.lit(target).alias("dst_kind"), F.col(b).cast("long").alias("dst_key"))
        out = e if out is None else out.unionByName(e)
    return out


def star_edges(spark, d):
    """The same with text ends."""
    end = lambda side: F.concat(f"{side}_kind", F.lit(":"), f"{side}_key").alias(side)
    return keyed_edges(spark, d).select(F.lit("g").alias("graph_id"), end("src"), "rel", end("dst"))


#: Kinds of nodes, by the number that number_of keeps of them.
KINDS = ("region", "nation", "customer", "supplier", "order", "part")


def number_of(kind, key):
    """A node's kind and key as one number, which shuffles faster than its text."""
    return key.cast("long") * 8 + F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1


def text_of(number):
    return F.concat(F.get(F.array(*map(F.lit, KINDS)), F.pmod(number, F.lit(8)).cast("int")), F.lit(":"), F.shiftright(number, 3))


def numbered_edges(spark, d):
    return keyed_edges(spark, d).select(*[number_of(F.col(f"{side}_kind"), F.col(f"{side}_key")).alias(side) for side in ("src", "dst")])


EDGES = """e AS (SELECT 'nation:' || n_nationkey AS src, 'IN_REGION' AS rel, 'region:' || n_regionkey AS dst FROM nation UNION SELECT 'customer:' || c_custkey, 'LIVES_IN', 'nation:' || c_nationkey FROM customer
UNION SELECT 'supplier:' || s_suppkey, 'BASED_IN', 'nation:' || s_nationkey FROM supplier UNION SELECT 'order:' || o_orderkey, 'ORDERED_BY', 'customer:' || o_custkey FROM orders UNION SELECT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey FROM lineitem)"""


@query(f"WITH {EDGES} SELECT src, rel, dst FROM e")
def union_typed_edges(spark, d):
    return star_edges(spark, d).select("src", "rel", "dst").distinct()


@query(f"WITH {EDGES} SELECT 'edge' AS kind, rel AS type, count(*) AS n FROM e GROUP BY rel UNION ALL SELECT 'node', split_part(x, ':', 1), count(DISTINCT x) FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) GROUP BY ALL")
def graph_info(spark, d):
    e = star_edges(spark, d).select("src", "rel", "dst").distinct()
    nodes = e.select(F.col("src").alias("uuid")).union(e.select("dst")).distinct().withColumn("label", F.split_part("uuid", F.lit(":"), F.lit(1)))
    return graph.counts(nodes, e)


@query("SELECT label, count(*) AS n FROM (SELECT unnest([lang, source, 'Entity']) AS label FROM documents) WHERE label <> 'Entity' GROUP BY label")
def label_unnest_count(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array("lang", "source", F.lit("Entity"))).alias("label")).where("label <> 'Entity'").groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS root, l_suppkey AS topic, o_orderkey AS clause FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT p_partkey AS root, count(DISTINCT topic) AS n_topics, count(clause) AS n_clauses FROM part LEFT JOIN p ON root = p_partkey GROUP BY p_partkey""")
def path_two_hop(spark, d):
    """From every part over all line items."""
    return two_hop_counts(spark, d, table(spark, d, "part"), table(spark, d, "lineitem"))


#: Rows that a task of a wide shuffle gets: adaptive execution goes by compressed bytes, which say little of the memory of numbers.
EACH_TASK = 1_000_000


def two_hop_counts(spark, d, parts, lines):
    """As all rows of hops, clauses and roots are distinct, paths are."""
    n = max(1, -(-lines.count() // EACH_TASK))
    roots = parts.select(F.col("p_partkey").alias("root")).repartition(n, "root").distinct()
    hop = lines.select(F.struct("l_suppkey", "l_orderkey").alias("topic"), F.col("l_partkey").alias("root")).repartition(n, "topic").distinct()
    clauses = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("clause"), F.struct("l_suppkey", "l_orderkey").alias("topic")).repartition(n, "topic").distinct()
    paths = graph.two_hop_paths(roots, hop, clauses).select("root", F.col("topic.l_suppkey").alias("topic"), "clause")
    return paths.groupBy("root").agg(F.count_distinct("topic").alias("n_topics"), F.count("clause").alias("n_clauses"))


@query("SELECT DISTINCT l_suppkey AS topic, l_partkey AS entity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def topic_entities_distinct(spark, d):
    return topic_entities(spark, d, table(spark, d, "supplier"))


def topic_entities(spark, d, suppliers):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.lit("MENTIONS").alias("rel"), F.col("l_partkey").alias("dst"))
    topics = suppliers.select(F.col("s_suppkey").alias("topic"))
    return graph.expand(topics, "topic", e, "MENTIONS", to="entity").select("topic", "entity")


@query(f"""WITH {EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), h1 AS (SELECT DISTINCT y FROM b WHERE x = 'customer:1' AND y <> 'customer:1'),
h2 AS (SELECT DISTINCT b.y FROM h1 JOIN b ON b.x = h1.y WHERE b.y <> 'customer:1') SELECT node, min(hops)::INTEGER AS hops FROM (SELECT y AS node, 1 AS hops FROM h1 UNION ALL SELECT y, 2 FROM h2) GROUP BY node""")
def two_hop_neighbors(spark, d):
    found = graph.neighbourhood(keyed_edges(spark, d), ("customer", 1), ("src_kind", "src_key"), ("dst_kind", "dst_key"))
    return found.select(F.concat_ws(":", "node.src_kind", "node.src_key").alias("node"), "hops")


@query(f"""WITH RECURSIVE {EDGES}, t AS (SELECT DISTINCT 'order:' || o_orderkey AS root, 'order:' || o_orderkey AS node, 0 AS hops FROM orders UNION SELECT t.root, e.dst, t.hops + 1 FROM t JOIN e ON e.src = t.node WHERE t.hops < 3)
SELECT root, node, min(hops)::INTEGER AS hops FROM t WHERE node <> root GROUP BY ALL""")
def bounded_traversal(spark, d):
    """From every order."""
    starts = table(spark, d, "orders").select(number_of(F.lit("order"), F.col("o_orderkey")).alias("root"))
    return graph.reach(numbered_edges(spark, d), starts, 3).select(text_of(F.col("root")).alias("root"), text_of(F.col("node")).alias("node"), "hops")


@query(f"""WITH {EDGES}, h1 AS (SELECT p AS root, src AS node FROM (SELECT 'part:' || p_partkey AS p FROM part) JOIN e ON dst = p), h2 AS (SELECT root, dst AS node FROM h1 JOIN e ON src = h1.node),
u AS (SELECT root, node, 1 AS hops FROM h1 UNION ALL SELECT root, node, 2 FROM h2) SELECT root, min(hops)::INTEGER AS nearest, count(DISTINCT node) AS n FROM u WHERE node <> root GROUP BY root""")
def entity_first_traversal(spark, d):
    """From every part, whose edges all come in: its first hop goes against them."""
    starts = table(spark, d, "part").select(number_of(F.lit("part"), F.col("p_partkey")).alias("root"))
    found = graph.reach(numbered_edges(spark, d), starts, 2, either_way_first=True)
    return found.groupBy("root").agg(F.min("hops").alias("nearest"), F.count("*").alias("n")).withColumn("root", text_of(F.col("root")))


@query("""WITH ids AS (SELECT DISTINCT strftime(o_orderdate, '%Y.%m.%d') AS id FROM orders UNION SELECT DISTINCT strftime(o_orderdate, '%Y.%m') FROM orders)
SELECT a.id AS child, b.id AS parent FROM ids a JOIN ids b ON b.id = regexp_replace(a.id, '\\.[^.]+$', '') AND a.id LIKE '%.%'""")
def hierarchy_parent(spark, d):
    o = table(spark, d, "orders")
    ids = o.select(F.date_format("o_orderdate", "yyyy.MM.dd").alias("id")).union(o.select(F.date_format("o_orderdate", "yyyy.MM"))).distinct()
    return ids.select(F.col("id").alias("child"), parent_id(F.col("id")).alias("parent")).join(ids.select(F.col("id").alias("parent")), "parent").select("child", "parent")


@query("""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+'))::VARCHAR AS ref FROM documents) SELECT DISTINCT r.doc_id AS src, d.doc_id AS dst FROM r JOIN documents d ON d.doc_id::VARCHAR = r.ref WHERE d.doc_id <> r.doc_id""")
def cross_ref(spark, d):
    docs = table(spark, d, "documents")
    refs = docs.select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)))).alias("ref"))
    return refs.join(docs.select(F.col("doc_id").cast("string").alias("ref"), F.col("doc_id").alias("dst")), "ref").where("src <> dst").select("src", "dst").distinct()


@query("""SELECT p_partkey, regexp_replace(md5('g:' || p_name || ':entity'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid, regexp_replace(md5('g:' || p_partkey || ':clause'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS clause_uuid FROM part""")
def det_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", node_id("entity", F.lit("g"), F.col("p_name")).alias("uuid"), uuid_of(F.lit("g"), F.col("p_partkey"), F.lit("clause")).alias("clause_uuid"))


@query(f"WITH {EDGES} SELECT rel, count(*) AS n, count(DISTINCT md5(src || '|' || rel || '|' || dst)) AS ids FROM e WHERE src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 0) AND dst IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY rel")
def edges_both_present(spark, d):
    nodes = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("uuid")).union(table(spark, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("nation:"), "n_nationkey")))
    e = graph.edges_within(star_edges(spark, d), nodes)
    return e.groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct(edge_id(F.col("src"), F.col("rel"), F.col("dst"))).alias("ids"))


@query(f"WITH {EDGES}, n AS (SELECT 'nation:' || n_nationkey AS uuid, n_name AS name FROM nation) SELECT src, dst, coalesce(a.name, 'Unknown') AS src_name, coalesce(b.name, 'Unknown') AS dst_name FROM e LEFT JOIN n a ON a.uuid = src LEFT JOIN n b ON b.uuid = dst WHERE rel = 'IN_REGION' OR rel = 'BASED_IN'")
def edge_names(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name"))
    return graph.name_edges(star_edges(spark, d).where("rel IN ('IN_REGION', 'BASED_IN')"), n).select("src", "dst", "src_name", "dst_name")


@query(f"WITH {EDGES} SELECT rel, count(*) AS n FROM e WHERE src IN ('nation:1', 'customer:5') OR dst IN ('nation:1', 'customer:5') GROUP BY rel")
def edges_touching_results(spark, d):
    nodes = spark.createDataFrame([("nation:1",), ("customer:5",)], "uuid string")
    return graph.edges_touching(star_edges(spark, d), nodes).groupBy("rel").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT DISTINCT label FROM (SELECT (p_size % 12)::VARCHAR AS label FROM part UNION SELECT (p_size % 5) || '.' || (p_size % 11) FROM part UNION SELECT 'Appendix ' || chr(65 + p_size % 4) FROM part UNION SELECT p_type FROM part))
SELECT label, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(label, '[0-9]+') THEN 0 WHEN regexp_full_match(label, '[0-9]+(\\.[0-9]+)+') THEN 1 WHEN label LIKE 'Appendix %' THEN 3 ELSE 2 END,
CASE WHEN regexp_full_match(label, '[0-9.]+') THEN list_transform(string_split(label, '.'), lambda x: x::BIGINT) ELSE [] END, label) AS place FROM k""")
def natural_sort(spark, d):
    p = table(spark, d, "part")
    labels = p.select((F.col("p_size") % 12).cast("string").alias("label")).union(p.select(F.concat_ws(".", F.col("p_size") % 5, F.col("p_size") % 11))).union(p.select(F.concat(F.lit("Appendix "), F.char(65 + F.col("p_size") % 4)))).union(p.select("p_type")).distinct()
    return ordered.numbered(labels.withColumn("key", natural_key(F.col("label"))), [], ["key"]).select("label", "place")


PATHS = """r AS (SELECT p_partkey AS root, p_name AS name, p_partkey % 2 AS type_ord, p_partkey AS root_ord FROM part),
f AS (SELECT o_orderkey AS clause, o_orderpriority || ' ' || o_custkey AS fact FROM orders),
l AS (SELECT DISTINCT l_partkey AS root, l_suppkey AS topic, l_orderkey AS clause FROM lineitem),
p AS (SELECT r.*, l.topic, l.clause, f.fact, row_number() OVER (PARTITION BY lower(regexp_replace(fact, '[^A-Za-z0-9_]', '', 'g')) ORDER BY type_ord, root_ord, topic, l.clause) AS k FROM r JOIN l USING (root) JOIN f ON f.clause = l.clause),
c AS (SELECT root, name, type_ord, root_ord, count(*) AS n_facts, count(DISTINCT (topic, clause)) AS n_topics FROM p WHERE k = 1 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY type_ord ORDER BY n_facts DESC, root_ord) AS rank FROM c)"""


@query(f"WITH {PATHS} SELECT root, n_facts, n_topics, row_number() OVER (ORDER BY CASE WHEN root = 7 THEN 0 ELSE 1 END, type_ord, rank) AS place FROM t WHERE rank <= 10")
def batch_path_search(spark, d):
    """From every part."""
    return path_search(spark, d, table(spark, d, "part"))


def path_search(spark, d, p):
    roots = p.select(F.col("p_partkey").alias("root"), F.concat(F.lit("part "), "p_partkey").alias("name"), (F.col("p_partkey") % 2).alias("type_ord"), F.col("p_partkey").alias("root_ord"), F.lit(1.0).alias("score"))
    lines = table(spark, d, "lineitem").join(roots.select(F.col("root").alias("l_partkey")), "l_partkey", "left_semi")
    # a topic is a part's supplier within an order, as the paths go through one line item
    topic = F.struct("l_suppkey", "l_orderkey", "l_partkey").alias("topic")
    mentions = lines.select(topic, F.col("l_partkey").alias("root")).distinct()
    has_topic = lines.select(F.col("l_orderkey").alias("clause"), topic).distinct()
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("clause"), F.concat_ws(" ", "o_orderpriority", "o_custkey").alias("fact"))
    return retrieval.batch_path_search(roots, mentions, has_topic, facts, 10, "part 7").select("root", "n_facts", "n_topics", "place")
