"""Vector, keyword and fused search over documents and embeddings, and the flows on top."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WORD, normalize_text
from ..functions.vectors import cosine
from ..operators import ordered, retrieval, search
from ..operators.text_index import FIRST, Index
from ..operators.vector_index import VectorIndex, blocked_scores
from ..session import shared_path
from .catalogue import query, table

TERMS = ["the", "that", "with", "from"]


def words():
    return F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))


#: Search queries: every vector whose number is divisible by 100, against all.
VEC = """q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
v AS (SELECT query, vec_id, label, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS score FROM embeddings, q)"""
BM25 = """d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents), a AS (SELECT count(*) AS n, avg(len(words)) AS mean_len FROM d),
t AS (SELECT doc_id, len(words) AS len, unnest(words) AS token FROM d), h AS (SELECT doc_id, len, token, count(*) AS tf FROM t WHERE token IN ('the', 'that', 'with', 'from') GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM h GROUP BY token),
b AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len))), 6) AS score FROM h JOIN f USING (token), a GROUP BY doc_id)"""
FUSED = """x AS (SELECT query, vec_id AS key, score FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 15), y AS (SELECT doc_id AS key, score FROM b ORDER BY score DESC, key LIMIT 15),
r AS (SELECT query, key, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY score DESC, key)) AS part FROM x UNION ALL SELECT query, key, 2.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY score DESC, key)) FROM y, (SELECT query FROM q)),
g AS (SELECT query, key, round(sum(part), 12) AS rrf FROM r GROUP BY query, key), s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY rrf DESC, key) <= 10), z AS (SELECT query, key, rrf, round(rrf / max(rrf) OVER (PARTITION BY query), 12) AS score FROM s)"""


def keywords(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", words(), TERMS, digits=6, length=F.regexp_count(F.lower("text"), F.lit(WORD)))


def vectors(spark, d, **kw):
    """The best embeddings of all for each query, or those that score enough."""
    e = table(spark, d, "embeddings")
    return blocked_scores(e, "vec_id", "embedding", e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), "query", "q", **kw).withColumnRenamed("key", "vec_id")


@query(f"WITH {VEC} SELECT query, vec_id, score FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10")
def vector_topk(spark, d):
    return vectors(spark, d, k=10).select("query", "vec_id", "score")


def indexed(spark, d):
    """The index of all embeddings, built for the query, and the query vectors."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return VectorIndex(spark, shared_path(spark, "vectors")).build(e, "vec_id", "embedding"), asked


@query(f"WITH {VEC} SELECT query, vec_id, score FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10")
def vector_index_all_cells(spark, d):
    """The stored index with every cell probed: codes choose the candidates, and the result is the exact one."""
    index, asked = indexed(spark, d)
    return index.search(asked, "query", "q", 10, probes=index.about()["cells"]).withColumnRenamed("key", "vec_id")


@query("SELECT count(*) AS n_queries, 10 * count(*) AS n_wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, d):
    """Whether the index, probing as many cells as it was measured for, finds 0.9 of the exact ten nearest."""
    index, asked = indexed(spark, d)
    found = index.search(asked, "query", "q", 10).withColumnRenamed("key", "vec_id").withColumn("found", F.lit(1))
    both = vector_topk(spark, d).join(found.select("query", "vec_id", "found"), ["query", "vec_id"], "left")
    counts = both.agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_wanted"), F.count("found").alias("n_found"))
    return counts.select("n_queries", "n_wanted", (F.col("n_found") >= 0.9 * F.col("n_wanted")).alias("reached"))


@query(f"WITH {VEC} SELECT query, vec_id, score FROM v WHERE score >= 0.2")
def vector_threshold(spark, d):
    return vectors(spark, d, at_least=0.2).select("query", "vec_id", "score")


@query(f"WITH {VEC} SELECT query, label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS rank FROM v) WHERE rank <= 3")
def vector_topk_by_label(spark, d):
    return vectors(spark, d, k=3, by="label").select("query", "label", "vec_id", "score", "rank")


@query(f"WITH {BM25} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return search.top_k(keywords(spark, d), [F.desc("score"), F.col("key")], 20).select(F.col("key").alias("doc_id"), "score")


def text_index(spark, d):
    """The full-text index of all documents, built for the query."""
    return Index(spark, shared_path(spark, "texts")).build(table(spark, d, "documents"), "doc_id", F.col("text"))


STORED = BM25.replace("'[a-z]+'", "'[a-z0-9]+'")


@query(f"WITH {STORED} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def text_index_topk(spark, d):
    """The best documents by the stored index, which skips blocks that can't hold one."""
    return text_index(spark, d).search(" ".join(TERMS), digits=6, k=20).select(F.col("key").alias("doc_id"), "score")


@query(f"WITH {STORED} SELECT sum(df)::BIGINT AS n_postings, true AS fewer FROM f")
def text_index_reads(spark, d):
    """How many postings the query's tokens have, and that the search above reads fewer; a table of as few blocks as are
    scored first is read whole."""
    few = F.col("n_blocks") <= FIRST
    return text_index(spark, d).reads(" ".join(TERMS), 20, digits=6).select("n_postings", (few | (F.col("n_read") < F.col("n_postings"))).alias("fewer"))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents) SELECT doc_id, count(*) AS n_tokens FROM t WHERE contains(token, 'tion') GROUP BY doc_id""")
def wildcard_index(spark, d):
    """Documents with tokens that have a string in them, and how many: the tokens by the dictionary of substrings."""
    index = text_index(spark, d)
    found = index.wildcard("Tion ").join(index.read("postings").join(index.tokens_with("tion"), "token", "left_semi"), "key")
    return found.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_tokens"))


@query("SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY ALL) GROUP BY token")
def postings_statistics(spark, d):
    p = search.postings(table(spark, d, "documents"), "doc_id", words())
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def fused(spark, d):
    """For each query vector its neighbours, fused with the documents that the same words find: a vector is that of the
    document of its number, documents without one are in the keyword list alone."""
    v = vectors(spark, d, k=15).select("query", F.col("vec_id").alias("key"), "score")
    b = search.top_k(keywords(spark, d), [F.desc("score"), F.col("key")], 15)
    queries = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"))
    return search.hybrid(v, queries.crossJoin(F.broadcast(b)).select("query", "key", "score"), by=("query",))  # 15 rows


@query(f"WITH {VEC}, {BM25}, {FUSED} SELECT query, key, rrf, score FROM z")
def hybrid_topk(spark, d):
    return fused(spark, d)


@query(f"WITH {VEC}, {BM25}, {FUSED}, n AS (SELECT query, z.key, source, score, row_number() OVER (PARTITION BY query, lower(trim(source)) = 'src3' ORDER BY rrf DESC, z.key) AS k FROM z JOIN documents ON doc_id = z.key) SELECT query, key, lower(trim(source)) = 'src3' AND k = 1 AS boosted, CASE WHEN lower(trim(source)) = 'src3' AND k = 1 THEN 1.0::DOUBLE ELSE score END AS score FROM n")
def hybrid_boost(spark, d):
    named = fused(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source"), "key")
    return search.boost_exact(named, "source", "SRC3", [F.desc("rrf"), F.col("key")], ("query",)).select("query", "key", "boosted", "score")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), lower('Licensed')) OR contains(lower(source), 'licensed')")
def contains_ci(spark, d):
    return table(spark, d, "documents").where(search.contains_any(["text", "source"], "Licensed")).select("doc_id", "lang")


CASCADE = """a AS (SELECT doc_id, text FROM documents), e AS (SELECT doc_id AS key, 1 AS tier FROM a WHERE list_contains(regexp_extract_all(lower(text), '[a-z]+'), 'licens')),
w AS (SELECT DISTINCT doc_id AS key, 2 AS tier FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM a) WHERE contains(token, 'licens')), c AS (SELECT doc_id AS key, 3 AS tier FROM a WHERE contains(lower(text), 'licens')),
u AS (SELECT * FROM e UNION ALL SELECT * FROM w UNION ALL SELECT * FROM c)"""


@query(f"WITH {CASCADE} SELECT key, (tier - 1)::INTEGER AS tier, 1.0::DOUBLE AS score FROM u WHERE tier = (SELECT min(tier) FROM u)")
def cascade_first_nonempty(spark, d):
    # one scan tells the first of the three searches that finds a document; a word that has it is also a substring
    docs = table(spark, d, "documents").where(search.contains_any(["text"], "licens")).select(F.col("doc_id").alias("key"), words().alias("tokens"))
    tiers = docs.select("key", F.when(F.array_contains("tokens", "licens"), 0).when(F.exists("tokens", lambda t: F.contains(t, F.lit("licens"))), 1).otherwise(2).alias("first"))
    return search.cascade(tiers).select("key", "tier", "score")


@query("""WITH f AS (SELECT o_custkey AS root, o_orderpriority AS fact, o_orderkey AS ord, round(o_totalprice / 500000, 9) AS s, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS k FROM orders),
c AS (SELECT root, fact, ord, round_even(s * 100, 1) AS score FROM f WHERE k = 1 ORDER BY ord LIMIT 50)
SELECT root, fact, ord, score FROM c WHERE score >= 30 OR NOT EXISTS (SELECT 1 FROM c WHERE score >= 30) ORDER BY score DESC, ord LIMIT 12""")
def rerank_threshold_topk(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderpriority").alias("fact"), F.col("o_orderkey").alias("ord"), F.round(F.col("o_totalprice") / 500000, 9).alias("s"))
    return retrieval.retrieval_flow(f, F.col("s"), 30, 12).select("root", "fact", "ord", "score")


@query("""WITH t AS (SELECT s_suppkey AS topic, s_acctbal AS score FROM supplier ORDER BY score DESC, topic LIMIT 5), p AS (SELECT DISTINCT topic, l_partkey AS entity, p_retailprice AS es FROM t JOIN lineitem ON l_suppkey = topic JOIN part ON p_partkey = l_partkey),
a AS (SELECT DISTINCT entity, es FROM p ORDER BY es DESC, entity LIMIT 8), n AS (SELECT p.topic, p.entity, row_number() OVER (PARTITION BY topic ORDER BY p.es DESC, p.entity) AS rank FROM p JOIN a USING (entity)),
e AS (SELECT topic, string_agg(entity::VARCHAR, ',' ORDER BY rank) AS entities FROM n GROUP BY topic), c AS (SELECT topic, count(DISTINCT l_orderkey) AS n_clauses, min(l_orderkey) AS first_clause FROM t JOIN lineitem ON l_suppkey = topic GROUP BY topic)
SELECT topic, score, entities, n_clauses, first_clause FROM t LEFT JOIN e USING (topic) LEFT JOIN c USING (topic)""")
def intent_match(spark, d):
    topics = table(spark, d, "supplier").select(F.col("s_suppkey").alias("topic"), F.col("s_acctbal").alias("score"))
    lines = table(spark, d, "lineitem")
    entity = lines.select(F.col("l_suppkey").alias("topic"), F.col("l_partkey").alias("entity")).distinct()
    clause = lines.select(F.col("l_suppkey").alias("topic"), F.col("l_orderkey").alias("clause"))
    score = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("entity_score"))
    return retrieval.intent_match(topics, entity, clause, score, 5, 8)


@query("""WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, round(coalesce(list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))), 0), 9) AS likeness FROM l""")
def lag_similarity(spark, d):
    e = ordered.running(table(spark, d, "embeddings").select("vec_id", "embedding"), [], ["vec_id"], {"before": (ordered.LAG, F.col("embedding"))})
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.col("before")), 9).alias("likeness"))


@query("""WITH c AS (SELECT s_suppkey AS root, s_name AS name, count(*) AS n_facts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT root, round(CASE WHEN lower(trim(name)) = 'supplier#000000001' THEN 50 WHEN contains(lower(trim(name)), 'supplier#000000001') THEN 35 WHEN contains('supplier#000000001', lower(trim(name))) THEN 20 ELSE 0 END + 30.0::DOUBLE * n_facts / max(n_facts) OVER () + 20, 6) AS score FROM c""")
def coarse_rescore(spark, d):
    c = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("root"), F.col("s_name").alias("name")).agg(F.count("*").alias("n_facts"))
    return retrieval.coarse_scores(c, "name", "Supplier#000000001", "n_facts").select("root", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x0B]+', '', 'g'), '[^\\p{L}\\p{N}\\p{M}_]', '', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS h FROM f""")
def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("h"))
