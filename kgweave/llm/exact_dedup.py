"""Exact duplicates by sorting content.

Normalised texts are range-partitioned by splitters that Spark samples from the keys (the text's first
characters, then its SHA-256, so that many texts with one beginning still split), each partition is
sorted externally by the whole text, and neighbours with equal texts form a run. The longest original
stays, then the one with the smallest identifier.

A content with more rows or characters than a run may have is dealt out over several runs by a salt; those
runs are joined again by SHA-256."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, documents, materialise


def normalised(text) -> F.Column:
    """text without [\\x20\\x09-\\x0D]; null as empty."""
    return reduce(lambda c, code: F.replace(c, F.lit(chr(code)), F.lit("")), (32, 9, 10, 11, 12, 13), F.coalesce(text, F.lit("")))


def exact_duplicates(df: DataFrame, hot_rows: int = 1000, hot_chars: int = 1 << 25, hot_contents: int = 200_000) -> DataFrame:
    """df's columns with keep_id, group_size, kept and text_sha256.

    Null text counts as empty; all such rows are one group. Null ids come last. Of repeated rows one is
    kept. An empty table gives none. Columns of df with the names added here are replaced (kept_rows() leaves
    them alone). hot_rows and hot_chars bound a run, at every size of the table; up to hot_contents contents
    above them are broadcast, more are joined by a shuffle."""
    if "text" not in df.columns:
        raise ValueError("text is missing")
    rest = df.drop("keep_id", "group_size", "kept", "text_sha256")
    names = rest.columns
    size = F.length(F.coalesce("text", F.lit("")))
    sha = F.sha2(normalised(F.col("text")), 256)
    # partial sums run before the shuffle, so a hot content is one row per task; texts don't leave the scan
    narrow = materialise(df.select(F.col("doc_id").alias("id"), size.alias("size"), F.unhex(sha).alias("sha")), "contents")
    many = F.greatest(F.ceil(F.col("hot_size") / hot_rows), F.ceil(F.col("hot_size") * F.col("hot_len") / hot_chars))
    hot = narrow.groupBy("sha").agg(F.count("*").alias("hot_size"), F.max("size").alias("hot_len")).where((F.col("hot_size") > 1) & (many > 1))
    hot = materialise(hot.withColumn("salts", F.least(many, F.col("hot_size")).cast("int")), "hot")
    few = F.broadcast if hot.count() <= hot_contents else lambda table: table
    # hot contents: the smallest identifier of all runs among their longest rows
    best = narrow.join(few(hot), "sha").where("size = hot_len").groupBy("sha").agg(F.min("id").alias("hot_keep"))
    hot = materialise(hot.join(best, "sha", "left").select(F.lower(F.hex("sha")).alias("text_sha256"), "hot_size", "hot_len", "salts", "hot_keep"), "hot")
    row = rest.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), F.col("text").alias("original"), F.col("doc_id").alias("id"), size.alias("size"), normalised(F.col("text")).alias("norm"), sha.alias("text_sha256"))
    salted = row.join(few(hot), "text_sha256", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "size"), F.col("salts")), F.lit(0))).withColumn("start", F.substring("norm", 1, 32))
    dealt = salted.repartitionByRange("start", "text_sha256", "salt")
    run = W.partitionBy("start", "text_sha256", "salt", "norm").orderBy(F.desc("size"), F.asc_nulls_last("id"))
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    runs = dealt.withColumn("keep_id", F.first("id").over(whole)).withColumn("group_size", F.count("*").over(whole)).withColumn("place", F.row_number().over(run))
    cold = F.col("hot_size").isNull()
    # rows of one id and size are in one run, so that only one run begins with the kept row
    first = F.col("keep_id").eqNullSafe(F.col("hot_keep")) & (F.col("size") == F.col("hot_len"))
    return runs.select(
        *[F.col("original").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names],
        F.when(cold, F.col("keep_id")).otherwise(F.col("hot_keep")).alias("keep_id"),
        F.coalesce("hot_size", "group_size").alias("group_size"),
        ((F.col("place") == 1) & (cold | first)).alias("kept"),
        "text_sha256",
    )


def kept_rows(df: DataFrame) -> DataFrame:
    """df without the copies: its own columns, whatever their names."""
    plain, back = apart(df, "doc_id", "text")
    return back(exact_duplicates(plain).where("kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
