"""Stored full-text index: postings by token and block of documents, with each block's greatest impact.

Documents are put in an order in which those that the same frequent words lead lie together, and cut into blocks. For
each token and block the index keeps the greatest share that the token adds to a score there. A search for the k best
reads these bounds, scores the most promising blocks, and then only those whose bounds sum to the k-th score or more;
their postings are ranged by token and block, so that the rest isn't read. Substrings of tokens find the tokens of a
wildcard. All tables lie below a folder that driver and executors share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .search import B, K1, bm25_of, top_k

#: Documents of a block, frequent words that order them, blocks scored first for the k-th score, and ids that a filter
#: takes before a join does.
BLOCK, LEADERS, FIRST, LISTED = 128, 32, 8, 2000
#: Postings up to which a search reads them all at once.
FEW = 4096


def impact(tf: Column, length: Column, mean: Column) -> Column:
    """What a token adds to a BM25 score, but for its inverse document frequency."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Index:
    """Tokens are lower-case words and pairs of CJK characters, of a document's text as of a query's. Null texts are
    documents without tokens, null scopes the scope ''; rows that repeat a key are one document with all their
    tokens. Keys aren't null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    # ---- building

    def build(self, df: DataFrame, key: str, text: Column, scope: Column | None = None) -> Index:
        """Writes the index of df; scope is a column by which searches may be narrowed, as a graph or a label."""
        rows = df.select(F.col(key).alias("key"), (F.lit("") if scope is None else F.coalesce(scope.cast("string"), F.lit(""))).alias("scope"), tx.tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
        self._write(rows.withColumn("len", F.size("tokens")), "staged_rows")
        rows = self.read("staged_rows")
        lengths = rows.groupBy("scope", "key").agg(F.sum("len").alias("len"))
        self._write(lengths.groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len")).coalesce(1), "totals")
        # whole rows go to their document's task, where tokens are counted: postings aren't shuffled one by one
        each = rows.repartition("scope", "key").select("key", "scope", F.explode("tokens").alias("token")).groupBy("scope", "key", "token").agg(F.count("*").alias("tf"))
        posted = each.join(lengths.hint("shuffle_hash"), ["scope", "key"]).join(self.read("totals").select("scope", "mean_len"), "scope")
        posted = posted.withColumn("impact", impact(F.col("tf"), F.col("len"), F.col("mean_len"))).drop("mean_len")
        self._write(posted, "staged_postings")
        posted = self.read("staged_postings")
        words = posted.groupBy("scope", "token").agg(F.count("*").alias("df"))
        self._write(words.repartitionByRange("token", "scope").sortWithinPartitions("token", "scope"), "vocabulary")
        tokens = self.read("vocabulary").select("token").distinct()
        self._write(tokens.select(F.explode(tx.leading_grams(F.col("token"))).alias("gram"), "token").repartitionByRange("gram", "token").sortWithinPartitions("gram", "token"), "grams")
        self._write(self._blocks(posted), "staged_blocks")
        placed = posted.join(self.read("staged_blocks").hint("shuffle_hash"), ["scope", "key"]).repartitionByRange("token", "scope", "block", "key").sortWithinPartitions("token", "scope", "block", "key")
        placed.write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{self.path}/postings")
        bounds = self.read("postings").groupBy("token", "scope", "block").agg(F.max("impact").alias("most"), F.count("*").alias("n"))
        self._write(bounds.repartitionByRange("token", "scope", "block").sortWithinPartitions("token", "scope", "block"), "bounds")
        return self

    def _write(self, df: DataFrame, part: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{part}")

    def _blocks(self, posted: DataFrame) -> DataFrame:
        """scope, key, block: documents in the order of the frequent word that adds most to them and of how much it adds."""
        often = self.read("vocabulary").withColumn("place", F.row_number().over(W.partitionBy("scope").orderBy(F.desc("df"), "token"))).where(F.col("place") <= LEADERS)
        often = often.select("scope", "token")
        # LEADERS a scope: a broadcast keeps postings in place, where scopes are few
        often = F.broadcast(often) if self.read("totals").count() <= LISTED else often
        lead = posted.join(often, ["scope", "token"]).groupBy("scope", "key").agg(F.max(F.struct("impact", "token")).alias("lead"))
        docs = self.read("staged_rows").where("len > 0").select("scope", "key").distinct()
        lead = docs.join(lead, ["scope", "key"], "left").select("scope", "key", F.col("lead.token").alias("word"), F.col("lead.impact").alias("much"))
        laid = lead.repartitionByRange("scope", "word", "much", "key").withColumn("part", F.spark_partition_id())
        place = F.row_number().over(W.partitionBy("part", "scope").orderBy("word", "much", "key"))
        return laid.select("scope", "key", (F.col("part").cast("long") * (1 << 32) + F.floor((place - 1) / BLOCK)).alias("block"))

    # ---- searching

    def _tokens(self, query: str) -> list[str]:
        """The query's distinct tokens, cut as texts are."""
        return sorted(set(self.spark.range(1).select(tx.tokens(F.lit(query))).first()[0]))

    def _scored(self, hits: DataFrame, weights: dict[str, tuple[int, float]], scope: str, digits: int) -> DataFrame:
        """key, score of postings, with the document frequencies of the whole scope."""
        counts = self.spark.createDataFrame([(t, df) for t, (df, _) in weights.items()] or [("", 0)], "token string, df long")
        return bm25_of(hits.select("key", "token", "tf", "len"), self.read("totals").where(F.col("scope") == scope).select("n_docs", "mean_len"), digits, counts)

    def _weights(self, query: str, scope: str) -> dict[str, tuple[int, float]]:
        """Document and inverse frequency of the query's tokens that occur in the scope."""
        total = self.read("totals").where(F.col("scope") == scope).first()
        found = self.read("vocabulary").where((F.col("scope") == scope) & F.col("token").isin(self._tokens(query))).collect()  # a row per token
        return {r["token"]: (r["df"], math.log1p((total["n_docs"] - r["df"] + 0.5) / (r["df"] + 0.5))) for r in found}

    def _hits(self, weights: dict, scope: str) -> DataFrame:
        return self.read("postings").where((F.col("scope") == scope) & F.col("token").isin(list(weights)))

    def _bounds(self, weights: dict, scope: str) -> DataFrame:
        """block, bound: the most that a document of the block can score; n: its postings of the tokens."""
        factor = F.lit(None).cast("double")
        for token, (_, idf) in weights.items():
            factor = F.when(F.col("token") == token, idf).otherwise(factor)
        found = self.read("bounds").where((F.col("scope") == scope) & F.col("token").isin(list(weights)))
        return found.groupBy("block").agg(F.sum(factor * F.col("most")).alias("bound"), F.sum("n").alias("n"))

    def _least(self, weights: dict, scope: str, k: int, digits: int) -> tuple[DataFrame, float]:
        """The bounds, and a score that the k-th best reaches at least: the k-th of the most promising blocks."""
        bounds = self._bounds(weights, scope)
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST + k // BLOCK).collect()]
        best = top_k(self._scored(self._hits(weights, scope).where(F.col("block").isin(first)), weights, scope, digits), [F.desc("score"), F.col("key")], k).agg(F.min("score"), F.count("*")).first()
        return bounds, best[0] if best[1] == k else 0.0

    def search(self, query: str, scope: str = "", digits: int = 9, at_least: float | None = None, k: int | None = None) -> DataFrame:
        """key, score by BM25 within the scope: all documents with a token of the query, or the k best (ties by key)."""
        weights = self._weights(query, scope)
        hits = self._hits(weights, scope)
        if k is not None and sum(df for df, _ in weights.values()) > FEW:
            bounds, least = self._least(weights, scope, k, digits)
            # scores are rounded, sums in another order differ in their last digits
            kept = bounds.where(F.col("bound") >= least - max(10.0**-digits, 1e-9))
            some = [r["block"] for r in kept.select("block").limit(LISTED + 1).collect()]
            hits = hits.where(F.col("block").isin(some)) if len(some) <= LISTED else hits.join(kept.select("block"), "block", "left_semi")
        found = self._scored(hits, weights, scope, digits)
        found = found if at_least is None else found.where(F.col("score") >= at_least)
        return found if k is None else top_k(found, [F.desc("score"), F.col("key")], k)

    def reads(self, query: str, k: int, scope: str = "", digits: int = 9) -> DataFrame:
        """One row: n_blocks and n_postings of the query's tokens, and n_read, those of blocks that can hold one of the k best."""
        weights = self._weights(query, scope)
        bounds, least = self._least(weights, scope, k, digits)
        return bounds.agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_postings"), F.sum(F.when(F.col("bound") >= least - max(10.0**-digits, 1e-9), F.col("n")).otherwise(0)).alias("n_read"))

    def tokens_with(self, part: str) -> DataFrame:
        """token: those that have part in them, by the dictionary of substrings; none for an empty part."""
        part = part.strip().lower()
        if not part:
            return self.read("grams").select("token").limit(0)
        wanted = sorted({part[i : i + tx.GRAM] for i in range(max(1, len(part) - tx.GRAM + 1))})
        # shorter ones lead the substring at their place
        found = self.read("grams").where(F.col("gram").isin(wanted) if len(part) >= tx.GRAM else F.col("gram").startswith(part))
        if len(wanted) > 1:
            found = found.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
        return found.where(F.contains("token", F.lit(part))).select("token").distinct()

    def wildcard(self, part: str, scope: str = "") -> DataFrame:
        """key, score 1 of rows with a token that has part in it."""
        tokens = self.tokens_with(part)
        some = [r["token"] for r in tokens.limit(LISTED + 1).collect()]
        hits = self.read("postings").where(F.col("scope") == scope)
        hits = hits.where(F.col("token").isin(some)) if len(some) <= LISTED else hits.join(tokens, "token", "left_semi")
        return hits.select("key").distinct().withColumn("score", F.lit(1.0))


#: Tables without which an index isn't whole.
PARTS = ("totals", "vocabulary", "grams", "postings", "bounds")


def indexes(spark: SparkSession, path: str) -> DataFrame:
    """name, scope, n_docs, mean_len of the indexes below a folder, and whether each is whole: the catalogue of what can
    be searched."""
    out = spark.createDataFrame([], "name string, scope string, n_docs long, mean_len double, ready boolean")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in sorted(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*")) or [], key=lambda s: s.getPath().getName()):
        name, at = s.getPath().getName(), s.getPath().toString()
        whole = all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/{part}/_SUCCESS")) for part in PARTS)
        rows = spark.read.parquet(f"{at}/totals") if whole else spark.createDataFrame([(None, None, None)], "scope string, n_docs long, mean_len double")
        out = out.unionByName(rows.select(F.lit(name).alias("name"), "scope", "n_docs", "mean_len", F.lit(whole).alias("ready")))
    return out
