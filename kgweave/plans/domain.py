"""Small tables of the engine's own kinds (nodes, edges, clauses, layout blocks, apps), made from the driver's tables.

Each is one SELECT that Spark and DuckDB read alike, so that queries over them and their SQL begin with the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import table

_CHAPTER = "CAST(p_partkey % 9 + 1 AS STRING)"
_TEXT_LINES = [
    "'第' || CASE s_suppkey % 3 WHEN 0 THEN '一' WHEN 1 THEN '二' ELSE '3' END || '章 ' || s_name",
    "n || '.1 Scope'",
    "n || '.1.1 ' || CASE s_suppkey % 4 WHEN 0 THEN '必须设置' WHEN 1 THEN '宜采用' WHEN 2 THEN '严禁使用' ELSE 'keep' END || ' 见表' || n || '.2'",
    "n || '.2 Rules'",
    "n || '.2.1 适用于TN-S系统 公式(3.1-2) see 1.1.1'",
    "'2.0.' || CAST(s_suppkey AS STRING) || ' Term: meaning of ' || s_name",
    "'表 4.1 sizes'",
    "'1 | width | 20 mm'",
    "'---|---'",
    "'2 | height | 30 mm'",
    "'end'",
]
#: name: the tables it is made from, and its SELECT.
TABLES = {
    "nodes": (
        ["part"],
        f"""SELECT 'g' || CAST(p_partkey % 3 AS STRING) AS graph_id, 'u' || CAST(p_partkey AS STRING) AS uuid,
CASE p_partkey % 7 WHEN 0 THEN 'Clause' WHEN 1 THEN 'Topic' WHEN 2 THEN 'Entity' WHEN 3 THEN 'Term' WHEN 4 THEN 'Image' WHEN 5 THEN 'Table' ELSE 'Episode' END AS label,
p_name AS name, CASE WHEN p_partkey % 7 = 1 THEN p_type END AS topic, CASE WHEN p_partkey % 14 = 0 THEN {_CHAPTER} || '.1.' || CAST(p_size AS STRING) END AS clause_id,
CASE WHEN p_partkey % 5 <> 0 THEN p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_name END AS data, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS caption,
'img/' || p_brand AS img_path, 'T' || CAST(p_size AS STRING) AS table_id, p_type AS table_content, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS summary FROM {{part}}""",
    ),
    "edges": (
        ["orders"],
        """SELECT o_orderkey AS no, 'e' || CAST(o_orderkey AS STRING) AS uuid, 'u' || CAST(o_orderkey % 200 AS STRING) AS src, 'u' || CAST(o_custkey % 200 AS STRING) AS dst,
CASE o_orderkey % 4 WHEN 0 THEN 'MENTIONS' WHEN 1 THEN 'HAS_TOPIC' WHEN 2 THEN 'PART_OF' ELSE '' END AS rel, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END AS name,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS fact, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS expired_at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS invalid_at FROM {orders}""",
    ),
    "episodes": (
        ["events"],
        """SELECT 'ep' || CAST(event_id AS STRING) AS uuid, event_type AS data, 'doc' || CAST(user_id % 5 AS STRING) AS source, CAST(user_id % 30 AS INT) AS page, CASE WHEN event_id % 9 = 0 THEN 'broken' ELSE props END AS metadata_json,
'u' || CAST(event_id % 150 AS STRING) AS node FROM {events}""",
    ),
    "chunks": (
        ["orders"],
        """SELECT 'doc' || CAST(o_custkey % 20 AS STRING) AS source, o_orderkey AS chunk_seq, 'chunk_' || CAST(o_orderkey AS STRING) AS chunk_id, CAST(o_orderkey % 50 AS INT) AS page_idx, CAST(o_orderkey % 4 AS INT) AS category_id,
CASE o_orderkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'table' ELSE 'image' END AS type, o_orderkey % 13 = 5 AS is_layout,
CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(o_custkey % 9 + 1 AS STRING) || ' ' || o_orderpriority WHEN 3 THEN CAST(o_custkey % 9 + 1 AS STRING) || '.' || CAST(o_custkey % 5 AS STRING) || ' ' || o_orderpriority
WHEN 4 THEN CAST(o_custkey % 9 + 1 AS STRING) || '.' || CAST(o_custkey % 5 AS STRING) || '.' || CAST(o_orderkey % 7 AS STRING) || ' 宜采用 ' || o_orderpriority
WHEN 5 THEN CAST(o_custkey % 9 + 1 AS STRING) || '.' || CAST(o_custkey % 5 AS STRING) || '.9 必须 ' || o_orderpriority WHEN 6 THEN '表 ' || CAST(o_custkey % 9 + 1 AS STRING) || '.' || CAST(o_custkey % 6 AS STRING) || ' sizes'
ELSE 'text of ' || o_orderpriority || ' see 3.2.' || CAST(o_custkey % 7 AS STRING) END AS content,
CAST(o_orderkey % 90 AS DOUBLE) AS x0, CAST(o_custkey % 80 AS DOUBLE) AS y0, CAST(o_orderkey % 90 + o_custkey % 40 AS DOUBLE) AS x1, CAST(o_custkey % 80 + o_orderkey % 30 AS DOUBLE) AS y1 FROM {orders}""",
    ),
    # documents of four kinds: numbered, with titles that aren't, without titles, with chapters alone
    "blocks": (
        ["orders"],
        """SELECT source, chunk_seq, 'chunk_' || CAST(chunk_seq AS STRING) AS chunk_id, CAST(chunk_seq % 50 AS INT) AS page_idx, mode,
CASE WHEN k = 5 THEN 'table' WHEN k = 7 THEN 'image' WHEN mode <> 2 AND k IN (0, 2) OR mode < 2 AND k = 1 THEN 'title' ELSE 'text' END AS type,
CASE WHEN k = 6 THEN ' ' WHEN k = 5 THEN 'Table of ' || word WHEN mode IN (0, 3) AND k = 0 THEN a || ' Chapter ' || word WHEN mode = 0 AND k = 1 THEN a || '.' || b || ' Section ' || word
WHEN mode < 2 AND k = 2 AND chunk_seq % 2 = 0 THEN '附录' || CASE WHEN chunk_seq % 4 = 0 THEN 'A' ELSE 'B' END || ' ' || word WHEN mode < 2 AND k = 4 THEN 'A.0.' || b || ' of ' || word
WHEN mode = 0 AND k = 3 THEN a || '.' || b || '.' || c || ' 必须 ' || word WHEN mode = 0 AND k = 8 THEN a || '.' || b || '.' || c || '.1 宜 ' || word
ELSE word || chr(10) || 'line ' || CAST(chunk_seq AS STRING) END AS content, CASE WHEN k = 5 AND chunk_seq % 2 = 0 THEN '<t>' || word || '</t>' END AS table_content,
CAST(chunk_seq % 90 AS DOUBLE) AS x0, CAST(chunk_seq % 80 AS DOUBLE) AS y0, CAST(chunk_seq % 90 + 10 AS DOUBLE) AS x1, CAST(chunk_seq % 80 + chunk_seq % 30 AS DOUBLE) AS y1
FROM (SELECT 'doc' || CAST(o_custkey % 20 AS STRING) AS source, o_custkey % 20 % 4 AS mode, o_orderkey AS chunk_seq, o_orderkey % 11 AS k, 'as ' || o_orderpriority AS word,
CAST(o_custkey % 9 + 1 AS STRING) AS a, CAST(o_custkey % 5 AS STRING) AS b, CAST(o_orderkey % 7 AS STRING) AS c FROM {orders}) AS o""",
    ),
    "clauses": (
        ["part"],
        f"""SELECT p_partkey AS clause_no, 'doc' || CAST(p_partkey % 7 AS STRING) AS source, {_CHAPTER} || '.' || CAST(p_partkey % 4 AS STRING) || '.' || CAST(p_partkey % 37 AS STRING) AS clause_id, p_name AS title,
CASE p_partkey % 6 WHEN 0 THEN '必须设置消防车道 ' WHEN 1 THEN '宜采用水泵 ' WHEN 2 THEN '不得占用 ' ELSE '' END || p_type || ' see ' || {_CHAPTER} || '.1.2' AS content,
CASE WHEN p_partkey % 10 > 0 THEN {_CHAPTER} END AS parent_chapter, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE CAST(p_partkey % 4 AS INT) END AS level FROM {{part}}""",
    ),
    "elements": (
        ["customer"],
        """SELECT c_custkey AS element_id, CASE c_custkey % 6 WHEN 0 THEN 'table_row' WHEN 1 THEN 'term' WHEN 2 THEN 'formula' WHEN 3 THEN '' WHEN 4 THEN 'unknown' END AS element_type,
CAST(c_custkey % 9 + 1 AS STRING) || '.' || CAST(c_custkey % 4 AS STRING) || '.' || CAST(c_custkey % 37 AS STRING) AS source_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS key, c_mktsegment AS content,
CASE WHEN c_custkey % 4 = 0 THEN 'size of ' || c_mktsegment END AS definition, lower(c_mktsegment) AS keyword, CAST(c_custkey % 9 + 1 AS STRING) AS parent_chapter,
CAST(c_custkey % 9 + 1 AS STRING) || '.' || CAST(c_custkey % 3 AS STRING) || '.' || CAST(c_custkey % 11 AS STRING) || '_' || CAST(c_custkey AS STRING) AS chunk_id FROM {customer}""",
    ),
    "chapters": (["nation"], "SELECT n_nationkey AS ord, n_nationkey % 9 + 1 AS chapter_number, n_name AS title, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name || ' text' END AS content FROM {nation}"),
    "texts": (["supplier"], f"SELECT s_suppkey, s_name, n, {' || chr(10) || '.join(_TEXT_LINES)} AS text FROM (SELECT s_suppkey, s_name, CAST(s_suppkey % 9 + 1 AS STRING) AS n FROM {{supplier}}) AS s"),
    "projects": (["supplier"], "SELECT 'p' || CAST(s_suppkey AS STRING) AS project_id, s_name AS name, CASE WHEN s_suppkey % 4 > 0 THEN 'g' || CAST(s_suppkey % 3 AS STRING) END AS graph_id, s_suppkey % 5 = 0 AS deleted FROM {supplier}"),
    "apps": (
        ["customer"],
        """SELECT 'a' || CAST(c_custkey AS STRING) AS app_id, c_name AS name, c_custkey % 3 > 0 AS is_published, 'p' || CAST(c_custkey % 12 AS STRING) AS p1, 'p' || CAST(c_custkey % 10 * 5 AS STRING) AS p2,
'g' || CAST(c_custkey % 2 + 7 AS STRING) AS g1, c_custkey % 8 = 1 AS lists_none FROM {customer}""",
    ),
}


def make(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources, select = TABLES[name]
    return spark.sql(select, **{t: table(spark, sf_dir, t) for t in sources})


def cte(*names: str) -> str:
    """The same tables as common table expressions."""
    return ", ".join(f"{n} AS ({TABLES[n][1].format(**{t: t for t in TABLES[n][0]})})" for n in names)


def labels() -> Column:
    """Labels of a node: Terms are Entities too. In SQL: LABELS."""
    return F.when(F.col("label") == "Term", F.array(F.lit("Entity"), F.lit("Term"))).otherwise(F.array("label"))


LABELS = "CASE WHEN label = 'Term' THEN ['Entity', 'Term'] ELSE [label] END"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make(spark, sf_dir, "nodes").withColumn("labels", labels())


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make(spark, sf_dir, "chunks").withColumn("bbox", F.array("x0", "y0", "x1", "y1"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make(spark, sf_dir, "blocks").withColumn("bbox", F.array("x0", "y0", "x1", "y1"))


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apps with their settings; in SQL: the lists [p1, p2] (none where lists_none) and [g1]."""
    a = make(spark, sf_dir, "apps")
    none = F.array().cast("array<string>")
    return a.select("app_id", "name", "is_published", F.struct(F.when(F.col("lists_none"), none).otherwise(F.array("p1", "p2")).alias("selectedProjectIds"), F.array("g1").alias("selectedGraphIds")).alias("workflow_data"))


APP_LISTS = "CASE WHEN lists_none THEN [] ELSE [p1, p2] END"
