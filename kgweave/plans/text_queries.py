"""Text, JSON and chunking operators over documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import plugins
from ..functions import text as tx
from ..operators import chunking, tabular
from .catalogue import query, table

LEVELS = [("prohibited", ("must not", "never")), ("mandatory", ("must", "the")), ("recommended", ("may", "en"))]


@query("SELECT doc_id, x.i AS ord, x.id AS clause_id FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '\\b([0-9]+\\.[0-9]+\\.[0-9]+)\\b', 1), lambda v, i: {'i': i, 'id': v})) AS x FROM documents)")
def clause_id_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.clause_ids(F.col("text"))).alias("ord", "clause_id")).select("doc_id", (F.col("ord") + 1).cast("long").alias("ord"), "clause_id")


@query("SELECT doc_id, CASE WHEN contains(text, 'must not') OR contains(text, 'never') THEN 'prohibited' WHEN contains(text, 'must') OR contains(text, 'the') THEN 'mandatory' WHEN contains(text, 'may') OR contains(text, 'en') THEN 'recommended' ELSE 'none' END AS level FROM documents")
def requirement_classifier(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.classify(F.col("text"), LEVELS, "none").alias("level"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""WITH n AS (SELECT doc_id, unnest(list_transform(range(0, greatest(length(text) - 20, 0), 10), lambda i: substr(text, i + 1, 20))) AS g FROM documents),
b AS (SELECT item_id, unnest(list_transform(range(0, greatest(length(text) - 20, 0), 5), lambda i: substr(text, i + 1, 20))) AS g FROM benchmark)
SELECT doc_id, item_id, count(*) AS shared FROM n JOIN b USING (g) GROUP BY ALL HAVING count(*) >= 3""")
def ngram_overlap(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.explode(tx.ngrams(F.col("text"), 20, 10)).alias("g"))
    b = table(spark, d, "benchmark").select("item_id", F.explode(tx.ngrams(F.col("text"), 20, 5)).alias("g"))
    return n.join(b, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).where("shared >= 3")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS chunk_index, floor(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 12)::BIGINT AS win FROM documents")
def running_index(spark, d):
    r = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", (r - 1).alias("chunk_index"), F.floor(r / 12).alias("win"))


@query("""WITH o AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM o)
SELECT conv_id, island::BIGINT AS island, min(role) AS role, count(*) AS turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island""")
def merge_turns(spark, d):
    t = table(spark, d, "conversations").withColumn("_p", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    runs = tabular.islands(t, ["conv_id"], ["turn"], F.col("_p") != F.col("role"))
    return runs.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations")
def fill_down(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.length("text")).alias("asked"))
    return tabular.fill_down(t, ["conv_id"], ["turn"], ["asked"])


@query("SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short FROM documents")
def truncate_description(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), tx.truncate(F.col("text"), 100).alias("short"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '(?i)<title[^>]*>([^<]*)', 1) AS title, len(regexp_extract_all(html, '(?i)<p[ >]'))::INTEGER AS paragraphs,
len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::INTEGER AS links FROM pages""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)", 1).alias("title"), F.regexp_count("html", F.lit("(?i)<p[ >]")).alias("paragraphs"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("links"))


@query("SELECT entities, CASE WHEN n <= 1 THEN 3 WHEN n <= 3 THEN 8 WHEN n <= 10 THEN 15 ELSE 999 END AS target FROM (SELECT source AS entities, count(*) // 10 AS n FROM documents GROUP BY source)")
def entity_targets(spark, d):
    c = table(spark, d, "documents").groupBy(F.col("source").alias("entities")).agg(F.floor(F.count("*") / 10).alias("n"))
    return c.select("entities", tx.entity_target(F.col("n")).alias("target"))


@query()
def split_windows(spark, d):
    return chunking.split_texts(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
b AS (SELECT source, doc_id, chars, k, 0 AS batch, 1 AS n, chars AS total, chars > 1500 AS alone FROM r WHERE k = 1 UNION ALL
SELECT source, doc_id, chars, k, CASE WHEN opens THEN batch + 1 ELSE batch END, CASE WHEN opens THEN 1 ELSE n + 1 END, CASE WHEN opens THEN chars ELSE total + chars END, chars > 1500
FROM (SELECT r.source, r.doc_id, r.chars, r.k, batch, n, total, alone OR r.chars > 1500 OR n >= 8 OR total + r.chars > 8000 AS opens FROM b JOIN r ON r.source = b.source AND r.k = b.k + 1))
SELECT doc_id, source, chars::INTEGER AS chars, batch FROM b""")
def capacity_batches(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    return chunking.capacity_batches(t, ["source"], "doc_id", "chars")


@query()
def sentence_chunks(spark, d):
    """Sentences of every document, chunked within it by the vectors of the offline embedder."""
    each = table(spark, d, "documents").select("source", "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "text"))
    vectors = plugins.embed(each, "text").select("source", "doc_id", "ord", F.length("text").alias("chars"), "embedding")
    return chunking.semantic_chunks(vectors, ["source", "doc_id"], "ord", "chars", "embedding", 4000).select("source", "doc_id", "ord", "chars", "chunk")
