"""Search: vector top-k, BM25 over a postings table, rank fusion, cascades and boosts.

Scores are rounded before they rank, so that sums in another order can't change a result; every order ends
in an id."""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..session import shared_path
from .tabular import keep_one

#: BM25's usual parameters, and the constant of reciprocal-rank fusion: fixed values.
K1, B, RRF_K = 1.2, 0.75, 60


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def vector_scores(df: DataFrame, vector: str, query: DataFrame, at_least: float | None = None, digits: int = 9) -> DataFrame:
    """df with the cosine to each vector of query (column q, and any key columns, which stay). query is broadcast."""
    scored = df.crossJoin(F.broadcast(query)).withColumn("score", F.round(cosine(F.col(vector), F.col("q")), digits)).drop("q")
    return scored if at_least is None else scored.where(F.col("score") >= at_least)


def postings(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, token, tf, len: the index that BM25 reads; make it once and keep it as a table."""
    rows = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    each = rows.select("key", F.size("tokens").alias("len"), F.explode("tokens").alias("token"))
    return each.groupBy("key", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def totals(df: DataFrame, length: Column) -> DataFrame:
    """One row: how many rows there are and their mean number of tokens."""
    return df.agg(F.count("*").alias("n_docs"), F.avg(length).alias("mean_len"))


def bm25_of(hits: DataFrame, total: DataFrame, digits: int = 9, df_of: DataFrame | None = None) -> DataFrame:
    """key, score from postings (key, token, tf, len) of a query's tokens and the one row of totals. df_of: token and df,
    where hits aren't all postings of the tokens."""
    if df_of is None:
        df_of = hits.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as the query has tokens
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    joined = hits.join(F.broadcast(df_of), "token").crossJoin(F.broadcast(total))
    return joined.groupBy("key").agg(F.round(F.sum(part), digits).alias("score"))


def bm25(df: DataFrame, key: str, tokens: Column, query: list[str], digits: int = 9, length: Column | None = None) -> DataFrame:
    """key, score of rows that hold any of the query's tokens, from the texts themselves; text_index.Index reads stored postings.

    length: a cheaper expression for the number of tokens, if there is one."""
    wanted = F.array(*map(F.lit, sorted(set(query))))
    rows = df.select(F.col(key).alias("key"), tokens.alias("tokens")).withColumn("len", F.size("tokens"))
    total = totals(rows, F.col("len")) if length is None else totals(df, length)
    hits = rows.select("key", "len", F.explode(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("token")).groupBy("key", "len", "token").agg(F.count("*").alias("tf"))
    return bm25_of(hits, total, digits)


def degraded(search, *args, **kwargs) -> DataFrame | None:
    """A search's result, or None where its index is absent or unreadable: one part that fails leaves the others.

    The search runs here, and its rows are kept as a table in the shared folder, so what breaks only while files are read
    shows now as well. For searches whose results are few, as a limit makes them."""
    try:
        found = search(*args, **kwargs)
        path = shared_path(found.sparkSession, "found")
        found.write.parquet(path)
        return found.sparkSession.read.schema(found.schema).parquet(path)
    except (PySparkException, Py4JJavaError, FileNotFoundError) as fault:
        warnings.warn(f"a search was left out: {str(fault)[:200]}", stacklevel=2)
        return None


def keep_first_union(lists: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Rows (key, score) of several searches, each key once, from the first search that has it, in the order of the
    searches and then by score."""
    stacked = None
    for n, df in enumerate(lists):
        part = df.select("key", "score", F.lit(n).alias("tier"))
        stacked = part if stacked is None else stacked.unionByName(part)
    once = keep_one(stacked, ["key"], [F.col("tier")])
    return once if limit is None else once.orderBy("tier", F.desc("score"), "key").limit(limit)


#: How many times its limit a search asks of each list that it fuses.
OVERSAMPLING = 2


def hybrid_search(lists: dict[str, tuple[DataFrame | None, DataFrame | None]], scopes: list[str], limit: int, boost: tuple[DataFrame, str] | None = None) -> DataFrame:
    """scope, key, rrf, score: for each scope (episodes always, and those asked for) the fusion of its vector and keyword
    lists (key, score; None where an index is absent), each asked for OVERSAMPLING limits. A scope with neither list has
    no rows. boost: (key, name) of nodes and the query; among nodes the first of that very name leads with score 1."""
    out = None
    for scope in dict.fromkeys(["episodes", *scopes]):
        both = lists.get(scope, (None, None))
        found = [(top_k(df, [F.desc("score"), F.col("key")], OVERSAMPLING * limit), w) for df, w in zip(both, (1.0, 2.0), strict=True) if df is not None]
        if not found:
            continue
        rows = fuse(found, limit=limit)
        if scope == "nodes" and boost is not None:
            names, query = boost
            rows = boost_exact(rows.join(names, "key", "left"), "name", query, [F.desc("rrf"), F.col("key")]).select("key", "rrf", "score")
        rows = rows.select(F.lit(scope).alias("scope"), "key", "rrf", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


#: How many more than its limit a search of typed nodes asks of each list.
MORE = 5


def typed_search(vectors: DataFrame | None, keyword: list[DataFrame], limit: int, at_least: float | None = None, boost: tuple[DataFrame, str] | None = None) -> DataFrame | None:
    """key, rrf, score of nodes of one type, the best `limit`: the fusion of a vector list and of the keyword searches
    (full text, wildcard, substring), all of which run; a node counts by the first that finds it. Each list is asked for
    MORE than the limit, and of rows that score at_least. None where there is no list. boost as in hybrid_search."""
    enough = lambda df: df if at_least is None else df.where(F.col("score") >= at_least)
    lists = [] if vectors is None else [(top_k(enough(vectors), [F.desc("score"), F.col("key")], limit + MORE), 1.0)]
    if keyword:
        lists.append((keep_first_union([enough(k) for k in keyword], limit + MORE).select("key", "score"), 2.0))
    if not lists:
        return None
    rows = fuse(lists, limit=limit)
    if boost is not None:
        rows = boost_exact(rows.join(boost[0], "key", "left"), "name", boost[1], [F.desc("rrf"), F.col("key")])
    return rows.select("key", "rrf", "score")


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K, limit: int | None = None, digits: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranked lists (key, score) with weights, to key and the weighted sum of 1 / (k + rank), normalised by the best.

    Ties in a list go by key; ties in the result by the first list's order and then key. by: columns of all lists
    that name a query; each query is fused alone."""
    ranked = None
    for n, (df, weight) in enumerate(lists):
        r = df.select(*by, "key", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "key")).alias("rank")).select(*by, "key", F.lit(n).alias("list"), "rank", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
        ranked = r if ranked is None else ranked.unionByName(r)
    out = ranked.groupBy(*by, "key").agg(F.round(F.sum("part"), digits).alias("rrf"))
    if limit is not None:
        place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("rrf"), "key"))
        out = out.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place") if by else out.orderBy(F.desc("rrf"), "key").limit(limit)
    best = F.max("rrf").over(W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return out.withColumn("score", F.round(F.col("rrf") / best, digits))


def boost_exact(df: DataFrame, name: str, query: str, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """The first row (of each query, if by names the queries) whose name equals the query, whatever the case, moves to the front with score 1."""
    same = F.lower(F.trim(name)) == query.strip().lower()
    first = F.row_number().over(W.partitionBy(*by, same).orderBy(*order)) == 1
    return df.withColumn("boosted", F.coalesce(same & first, F.lit(False))).withColumn("score", F.when(F.col("boosted"), F.lit(1.0)).otherwise(F.col("score")))


def contains_any(columns: list[str], keyword: str) -> Column:
    """Case-insensitive substring in any of the columns; null columns don't count."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(keyword.lower())), F.lit(False))
    return out if keyword.strip() else F.lit(False)


def cascade(found: DataFrame, tiers: int = 3) -> DataFrame:
    """The rows of the first search that found any. found: key, first: the first search that finds the row, of `tiers`
    searches each of which finds whatever those before it do."""
    from .tabular import first_tier

    each = found.select("key", F.lit(1.0).alias("score"), F.explode(F.sequence(F.col("first"), F.lit(tiers - 1))).alias("tier"))
    return first_tier(each)


def hybrid(vectors: DataFrame, texts: DataFrame, weights: tuple[float, float] = (1.0, 2.0), limit: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Fusion of a vector list and a keyword list (key, score each)."""
    return fuse([(vectors, weights[0]), (texts, weights[1])], limit=limit, by=by)
