"""Queries that write the driver's rows as files of the engine's sources and sinks, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking, records, search
from ..operators.text_index import Index, indexes
from ..session import shared_path
from ..sources import readers, writers
from ..sources.versioned import Versioned
from ..streaming import pipelines, state
from . import domain
from .catalogue import query, table
from .domain import cte


def written(spark, lines, tag: str, compression: str = "none") -> str:
    """A folder of text files of lines (one string column)."""
    path = shared_path(spark, tag)
    lines.write.option("compression", compression).text(path)
    return path


@query(f"WITH {cte('projects')} SELECT project_id, name, graph_id, deleted FROM projects")
def project_records(spark, d):
    """Projects as JSON lines, every seventh after a line that doesn't parse."""
    p = domain.make(spark, d, "projects")
    line = F.to_json(F.struct("project_id", "name", "graph_id", "deleted"))
    broken = F.when(F.substring("project_id", -1, 1) == "7", F.array(F.substring(line, 1, 25), line)).otherwise(F.array(line))
    read = readers.json_records(spark, written(spark, p.select(F.explode(broken)), "projects"), readers.PROJECTS, lines=True)
    return read.select("project_id", "name", "graph_id", "deleted")


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INTEGER AS chunk_seq, s_name AS content, s_nationkey AS page_idx FROM supplier")
def json_array_rows(spark, d):
    """One JSON array of all suppliers, as a file of chunks is one."""
    each = F.collect_list(F.struct("s_suppkey", F.struct(F.col("s_name").alias("content"), F.col("s_nationkey").alias("page_idx")).alias("e")))
    one = table(spark, d, "supplier").agg(F.to_json(F.transform(F.sort_array(each), lambda x: x["e"])).alias("value"))
    return readers.json_array(spark, written(spark, one, "array"), "content: STRING, page_idx: INT")


PAGE_LOG = """p AS (SELECT 'doc' || l_suppkey % 20 AS source, (l_partkey % 50 + 1)::INTEGER AS page_num, l_shipdate::DATE || ' ' || l_orderkey AS md_content, l_orderkey * 10 + l_linenumber AS line FROM lineitem),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, page_num ORDER BY line DESC) = 1)"""


def page_log(spark, d):
    """A log of pages, many of them parsed again later, with empty lines and lines that don't parse."""
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("doc"), F.col("l_suppkey") % 20).alias("source"), (F.col("l_partkey") % 50 + 1).cast("int").alias("page_num"),
        F.concat(F.col("l_shipdate").cast("date").cast("string"), F.lit(" "), "l_orderkey").alias("md_content"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
    )
    line = F.to_json(F.struct("source", "page_num", "md_content"))
    lines = F.when(F.col("line") % 9 == 0, F.array(F.lit(""), F.substring(line, 1, 20), line)).otherwise(F.array(line))
    ordered = rows.repartitionByRange("line").sortWithinPartitions("line")  # files are named in the order of their ranges
    return readers.parsed_pages(spark, written(spark, ordered.select(F.explode(lines)), "pages"))


@query(f"WITH {PAGE_LOG} SELECT source, page_num, md_content FROM k")
def last_pages(spark, d):
    return page_log(spark, d).select("source", "page_num", "md_content")


@query(f"WITH {PAGE_LOG} SELECT source, md5(string_agg(md_content, chr(10) || chr(10) ORDER BY page_num)) AS text FROM k GROUP BY source")
def assembled_pages(spark, d):
    return readers.assembled(page_log(spark, d)).select("source", F.md5("text").alias("text"))


@query(f"WITH {cte('clauses')} SELECT clause_id, parent_chapter, count(*) AS n FROM clauses GROUP BY ALL")
def clause_records(spark, d):
    """Clauses appended as JSON lines in two goes, and read by chapter and id."""
    c = domain.make(spark, d, "clauses").select("clause_no", "clause_id", "parent_chapter")
    path = shared_path(spark, "clauses")
    for k in range(2):
        writers.append_jsonl(c.where(F.col("clause_no") % 2 == k).drop("clause_no"), path)
    read = readers.clauses(spark, path, "clause_id string, parent_chapter string")
    return read.groupBy("clause_id", "parent_chapter").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, '消防 ' || s_name AS name FROM supplier")
def texts_of_encodings(spark, d):
    """Files in UTF-8 and UTF-16, half of the suppliers each."""
    s, path = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("消防 "), "s_name").alias("name")), shared_path(spark, "texts")
    for k, encoding in enumerate(("UTF-8", "UTF-16")):
        s.where(F.col("s_suppkey") % 2 == k).coalesce(1).write.mode("append").option("encoding", encoding).csv(f"{path}/{encoding}")
    lines = readers.texts(spark, path, "*.csv").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.split_part("line", F.lit(","), F.lit(1)).cast("long").alias("s_suppkey"), F.split_part("line", F.lit(","), F.lit(2)).alias("name"))


@query("""SELECT 'doc' || l_suppkey % 20 AS source, (row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1)::INTEGER AS chunk_seq,
CASE l_linenumber % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'table' ELSE 'image' END AS type, CASE WHEN l_linenumber % 4 IN (0, 1) THEN l_returnflag || l_linestatus || '!' ELSE 'cap ' || l_partkey END AS content,
CASE WHEN l_linenumber % 4 = 2 THEN '<t>' || l_partkey || '</t>' END AS table_content, l_quantity AS x0 FROM lineitem""")
def layout_rows(spark, d):
    """Pages of blocks with lines, spans and sub-blocks, one an order and source, as typed rows."""
    i = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ["title", "text", "table", "image"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    span = lambda text, html=None: F.struct(text.alias("content"), (F.lit(None).cast("string") if html is None else html).alias("html"))
    box = F.array("l_quantity", "l_tax", F.col("l_quantity") + 10, F.col("l_tax") + 10)
    line = lambda *spans: F.array(F.struct(box.alias("bbox"), F.array(*spans).alias("spans")))
    lines = F.when(kind.isin("title", "text"), line(span(F.col("l_returnflag")), span(F.concat("l_linestatus", F.lit("!")))))
    cap, html = F.concat(F.lit("cap "), "l_partkey"), F.concat(F.lit("<t>"), "l_partkey", F.lit("</t>"))
    sub = F.array(F.struct(F.concat(kind, F.lit("_caption")).alias("type"), line(span(cap)).alias("lines")), F.struct(F.lit("table_body").alias("type"), line(span(F.lit(None).cast("string"), html)).alias("lines")))
    block = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.struct(kind.alias("type"), box.alias("bbox"), lines.alias("lines"), F.when(lines.isNull(), sub).alias("blocks")).alias("b"))
    pages = i.groupBy(F.concat(F.lit("doc"), F.col("l_suppkey") % 20).alias("source"), F.col("l_orderkey").alias("page_num")).agg(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]).alias("preproc_blocks"))
    info = F.struct(F.array(F.struct(F.lit(0).alias("page_idx"), F.array(F.lit(100.0), F.lit(200.0)).alias("page_size"), "preproc_blocks")).alias("pdf_info"))
    read = readers.parsed_pages(spark, written(spark, pages.select(F.to_json(F.struct("source", "page_num", info.alias("middle_json")))), "layout", "gzip"))
    return readers.layout_chunks(read).select("source", "chunk_seq", "type", "content", "table_content", F.get("bbox_pdf", F.lit(0)).alias("x0"))


@query("SELECT doc_id, md5(coalesce(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '')) AS text FROM documents")
def csv_rows(spark, d):
    """Documents as CSV, line ends as spaces, read back."""
    path = shared_path(spark, "csv")
    writers.write_csv(table(spark, d, "documents").select("doc_id", "text"), path)
    return readers.csv_rows(spark, path, "doc_id long, text string").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query(f"WITH {cte('projects')} SELECT project_id, CASE WHEN project_id IN ('p3', 'p9', 'p27') THEN NULL ELSE graph_id END AS graph_id, deleted OR project_id IN ('p3', 'p9', 'p27') AS deleted FROM projects")
def soft_deleted_projects(spark, d):
    return writers.soft_deleted(domain.make(spark, d, "projects"), "project_id", ["p3", "p9", "p27"]).select("project_id", "graph_id", "deleted")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return writers.duplicates(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT lang AS scope, count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))), 6) AS mean_len, true AS ready FROM documents GROUP BY lang""")
def index_catalogue(spark, d):
    """The catalogue of a folder with one full-text index, narrowed by language."""
    path = shared_path(spark, "catalogue")
    Index(spark, f"{path}/documents").build(table(spark, d, "documents"), "doc_id", F.col("text"), F.col("lang"))
    return indexes(spark, path).select("scope", "n_docs", F.round("mean_len", 6).alias("mean_len"), "ready")


CLAUSE_ROWS = """c AS (SELECT (p_partkey % 9 + 1) || '.' || p_partkey // 9 AS clause_id, p_name AS content, p_brand AS topic, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, p_type AS term, p_size AS size FROM part)"""


def clause_rows(spark, d):
    """Clauses as an extraction leaves them: a topic with two entities, a term, an image, a table and references."""
    p = table(spark, d, "part")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    id_ = F.concat_ws(".", F.col("p_partkey") % 9 + 1, F.floor(F.col("p_partkey") / 9))
    return p.select(
        id_.alias("clause_id"), F.col("p_name").alias("content"), F.array(F.struct(F.col("p_brand").alias("topic"), F.array(word(1), word(2), F.lit(" ")).alias("entities")), F.struct(F.lit(" ").alias("topic"), F.array(F.lit("lost")).alias("entities"))).alias("topics"),
        F.array(F.struct(F.col("p_type").alias("term_name"), F.lit("a type").alias("definition"))).alias("terms"), F.array(F.struct(F.concat(F.lit("img/"), "p_size").alias("img_path"), F.lit("picture").alias("caption"))).alias("images"),
        F.array(F.struct(F.concat(F.lit("T"), F.col("p_size") % 7).alias("table_id"), F.lit("").alias("caption"), F.lit("c").alias("chunk_id"))).alias("referenced_tables"), F.array(F.concat_ws(".", F.col("p_partkey") % 9 + 1, F.lit("1")), id_).alias("referenced_clauses"),
    )


def ingested(spark, d):
    """Node and edge tables after a stream of clause files was merged into them, in two runs on one checkpoint."""
    path, rows = shared_path(spark, "graph"), clause_rows(spark, d)
    nodes, edges = (Versioned(spark, f"{path}/{n}", buckets=8) for n in ("nodes", "edges"))
    for k in range(2):
        rows.where(F.pmod(F.crc32("clause_id"), F.lit(2)) == k).write.mode("append").json(f"{path}/in")
        pipelines.ingest_clauses(pipelines.source(spark, f"{path}/in", rows.schema), f"{path}/checkpoint", "g", nodes, edges).awaitTermination()
    return nodes.read(), edges.read()


@query(f"""WITH {CLAUSE_ROWS} SELECT 'Clause' AS label, clause_id AS name, max(content) AS summary FROM c GROUP BY clause_id UNION ALL SELECT 'Topic', topic, NULL FROM c UNION ALL
SELECT 'Entity', word, NULL FROM (SELECT first AS word FROM c UNION SELECT second FROM c) WHERE word <> '' UNION ALL SELECT 'Term', term, 'a type' FROM c GROUP BY term
UNION ALL SELECT 'Image', 'picture', NULL FROM c GROUP BY size UNION ALL SELECT 'Table', 'T' || size % 7, NULL FROM c GROUP BY size % 7""")
def ingested_nodes(spark, d):
    return ingested(spark, d)[0].select("label", "name", "summary")


@query(f"""WITH {CLAUSE_ROWS}, w AS (SELECT topic, clause_id, first AS word FROM c UNION SELECT topic, clause_id, second FROM c), e AS (SELECT 'HAS_TOPIC' AS rel, count(*) AS n FROM c UNION ALL SELECT 'MENTIONS', (SELECT count(*) FROM w WHERE word <> '') + 3 * (SELECT count(*) FROM c) UNION ALL
SELECT 'CROSS_REFERENCE', count(*) FROM c JOIN (SELECT DISTINCT clause_id AS ref FROM c) r ON ref = split_part(clause_id, '.', 1) || '.1' AND ref <> clause_id) SELECT rel, n FROM e WHERE n > 0""")
def ingested_edges(spark, d):
    return ingested(spark, d)[1].groupBy("rel").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'parse:completed,graph:completed,export:failed' ELSE 'parse:completed,graph:pending,export:pending' END AS stages, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 END AS current_stage_index FROM customer""")
def retried_stages(spark, d):
    """Pipelines retried from the graph stage, which a quarter of them doesn't have by that name."""
    k = F.col("c_custkey") % 4
    stage = lambda name, status: F.struct(name.alias("name"), F.lit(status).alias("status"), F.lit("m").alias("message"))
    stages = F.array(stage(F.lit("parse"), "completed"), stage(F.when(k == 3, "graph ").otherwise("graph"), "completed"), stage(F.lit("export"), "failed"))
    reset = records.retry_from(table(spark, d, "customer").select("c_custkey", stages.alias("stages")), "graph")
    told = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", F.trim(s["name"]), s["status"])), ",")
    return reset.select("c_custkey", told.alias("stages"), "current_stage_index")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' ELSE 'completed' END AS status, CASE c_custkey % 3 WHEN 1 THEN 'completed,pending' ELSE 'completed,graph_failed' END AS stages FROM customer""")
def recovered_pipelines(spark, d):
    """The status table after a restart."""
    k = F.col("c_custkey") % 3
    stage = lambda c: F.struct(c.alias("status"))
    stages = F.array(stage(F.lit("completed")), stage(F.when(k == 1, "graph_processing").otherwise("graph_failed")))
    rows = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "pending").when(k == 1, "running").otherwise("completed").alias("status"), stages.alias("stages"))
    return state.recovered(rows).select("c_custkey", "status", F.array_join(F.transform("stages", lambda s: s["status"]), ",").alias("stages"))


@query(f"""WITH {cte("clauses")} SELECT clause_no, CASE WHEN clause_id = '2.1.1' THEN 'new title' ELSE title END AS title, CASE WHEN clause_id = '2.1.1' THEN 'own:x,fresh:1,pump:2' ELSE 'pump:' || clause_no || ',own:x' END AS terms FROM clauses""")
def edited_clause(spark, d):
    """One clause with another title and terms, of which one replaces that of its name."""
    c = domain.make(spark, d, "clauses")
    term = lambda name, definition: F.struct(F.lit(name).alias("term_name"), definition.alias("definition"))
    c = c.withColumn("terms", F.array(term("pump", F.col("clause_no").cast("string")), term("own", F.lit("x"))))
    fresh = spark.createDataFrame([("pump", "2"), ("fresh", "1")], "term_name string, definition string")
    told = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term_name"], t["definition"])), ",")
    return linking.edited(c, "2.1.1", {"title": "new title"}, fresh).select("clause_no", "title", told.alias("terms"))


TYPED = f"""{cte("nodes")}, o AS (SELECT uuid AS key, name, coalesce(summary, '') AS summary, p_retailprice AS price FROM nodes JOIN part ON 'u' || p_partkey = uuid WHERE label = 'Entity'),
v AS (SELECT key, round(price / 3000, 9) AS score FROM o WHERE round(price / 3000, 9) >= 0.3 ORDER BY score DESC, key LIMIT 13),
t AS (SELECT key, list_distinct(regexp_extract_all(lower(name || ' ' || summary), '[a-z0-9]+')) AS words, lower(name) AS n, lower(summary) AS s FROM o),
w AS (SELECT key, 1.0::DOUBLE AS score, 0 AS tier FROM t WHERE list_contains(words, 'bolt') UNION ALL SELECT key, 0.9::DOUBLE, 1 FROM t WHERE len(list_filter(words, lambda x: contains(x, 'bolt'))) > 0 UNION ALL SELECT key, 0.8::DOUBLE, 2 FROM t WHERE contains(n, 'bolt') OR contains(s, 'bolt')),
k AS (SELECT key, score FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier) = 1) ORDER BY tier, score DESC, key LIMIT 13),
r AS (SELECT key, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, key)) AS part FROM v UNION ALL SELECT key, 2.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, key)) FROM k),
g AS (SELECT key, round(sum(part), 12) AS rrf FROM r GROUP BY key ORDER BY rrf DESC, key LIMIT 8)"""


@query(f"WITH {TYPED} SELECT key, rrf, round(rrf / max(rrf) OVER (), 12) AS score FROM g")
def typed_search(spark, d):
    """Entities by vectors and by three keyword searches, each asked for five more than wanted."""
    n = domain.nodes(spark, d).where("label = 'Entity'").join(table(spark, d, "part").select(F.concat(F.lit("u"), "p_partkey").alias("uuid"), "p_retailprice"), "uuid")
    n = n.select(F.col("uuid").alias("key"), "name", F.coalesce("summary", F.lit("")).alias("summary"), F.round(F.col("p_retailprice") / 3000, 9).alias("score"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "summary")), F.lit("([a-z0-9]+)"), F.lit(1)))
    tiers = [F.array_contains(words, "bolt"), F.exists(words, lambda w: F.contains(w, F.lit("bolt"))), search.contains_any(["name", "summary"], "bolt")]
    keyword = [n.where(hit).select("key", F.lit(score).alias("score")) for hit, score in zip(tiers, (1.0, 0.9, 0.8), strict=True)]
    return search.typed_search(n.select("key", "score"), keyword, 8, 0.3).select("key", "rrf", "score")
