"""Mixing sources to target weights by repetition rates.

Sizes are summed per source; each source's target is its weight's share of the mix, but at most `most`
times its size, and what a source can't give is shared again by weight until no target is above. The
rate target / size is at most `most`. A document is emitted floor(rate) times, plus once more with the
fraction as probability, drawn by hashing its identifier, source and text: the same in every run, on any
cluster. Of `seeds` such draws each source takes the one whose words come nearest its target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, apart, documents, materialise

RANGE = 1 << 52


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds target.

    Targets are min(most * size, weight * level) with the level that fills the mix. Sources in order of
    most * size / weight: those below the level come first and give all they may. So one sorted pass finds
    it: the first source whose share of what is left fits sets the level for all after it."""
    order = W.orderBy(F.asc_nulls_last("source"))
    cap = F.col("source_size") * most
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    up = W.orderBy(cap * 1.0 / F.col("weight"), F.asc_nulls_last("source"))
    s = s.withColumn("capped", F.coalesce(F.sum(cap).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (total * share - F.col("capped")) / F.col("left_weight")
    s = s.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= cap * 1.0)
    s = s.withColumn("at", F.min(F.when(F.col("fits"), F.row_number().over(up))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s = s.withColumn("place", F.row_number().over(up))
    s = s.withColumn("chosen", F.max(F.when(F.col("place") == F.col("at"), F.col("level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("at").isNull() | (F.col("place") < F.col("at")), cap * 1.0).otherwise(F.col("chosen") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def draws(seed: str) -> list[F.Column]:
    """Two numbers below 2^52 from the seed and the row's id, source and text, out of one MD5."""
    key = F.concat(F.lit(seed + ":"), *[x for c in ("doc_id", "source", "text") for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"))])
    digits = F.md5(key)
    return [F.conv(F.substring(digits, at, 13), 16, 10).cast("long").alias(name) for at, name in ((1, "draw_a"), (14, "draw_b"))]


def drawn(k) -> F.Column:
    """The k-th draw of a row, from 0 to 1 (excluded)."""
    return F.pmod(F.col("draw_a") + k * F.col("draw_b"), F.lit(RANGE)) / F.lit(float(RANGE))


def fraction() -> F.Column:
    return F.col("rate") - F.floor("rate")


def mix(df: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seeds: int = 64) -> DataFrame:
    """df's columns with size, source_size, target and copies (how often the mix takes the row).

    Null text has size 0; a null source is a source of its own, last in order. Sources without words take
    nothing. Null and repeated ids draw by their texts; rows that repeat id, source and text share a draw.
    Columns of df with the names added here are replaced (emit() leaves them alone). An empty table gives none."""
    sized = df.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    # the sources' sums read two columns; a hot source is one row per task before the shuffle
    sums = df.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sums, weights, share, most).withColumnRenamed("source", "_source")
    rates = materialise(rates.withColumn("rate", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))).coalesce(1), "rates")
    # one row per source; without a hint the planner broadcasts it only while its measured size allows
    same = F.col("source").eqNullSafe(F.col("_source"))
    # what each seed would draw, summed per task first: `seeds` rows a source
    open_rows = df.select("source", word_count(F.col("text")).alias("size"), *draws(seed)).join(rates, same).where(fraction() > 0)
    tried = open_rows.select("_source", "size", "rate", "target", "source_size", "draw_a", "draw_b", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("k"))
    taken = tried.groupBy("_source", "k").agg(F.sum(F.when(drawn(F.col("k")) < fraction(), F.col("size")).otherwise(0)).alias("extra"), F.max(F.col("target") - F.floor("rate") * F.col("source_size")).alias("wanted"))
    best = W.partitionBy("_source").orderBy(F.abs(F.col("extra") - F.col("wanted")), "k")
    chosen = taken.withColumn("place", F.row_number().over(best)).where("place = 1").select(F.col("_source").alias("_other"), "k")
    rates = materialise(rates.join(chosen, F.col("_source").eqNullSafe(F.col("_other")), "left").drop("_other").coalesce(1), "seeds")
    joined = sized.join(rates, same, "left").withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumns({n: c for n, c in zip(("draw_a", "draw_b"), draws(seed), strict=True)})
    copies = F.floor("rate") + F.when(drawn(F.coalesce("k", F.lit(0))) < fraction(), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).drop("_source", "rate", "k", "draw_a", "draw_b")


def emit(df: DataFrame, **params) -> DataFrame:
    """The mix itself: df's rows and columns, each row as often as it is taken."""
    plain, back = apart(df, "doc_id", "text", "source")
    return back(mix(plain, **params).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s
), o AS (
  SELECT *, row_number() OVER u AS place, coalesce(sum(cap) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    (sum(weight) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_weight, (sum(source_size) OVER ())::BIGINT AS total
  FROM w WINDOW u AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), l AS (
  SELECT *, (total * 1.5::DOUBLE - capped) / left_weight AS level FROM o
), a AS (
  SELECT min(place) AS first_fit, arg_min(level, place) AS chosen FROM l WHERE level * weight <= cap::DOUBLE
), t AS (
  SELECT source, source_size, CASE WHEN first_fit IS NULL OR place < first_fit THEN cap::DOUBLE ELSE chosen * weight END AS target FROM l, a
), h AS (
  SELECT doc_id, source, size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || coalesce(text, '') || ':') AS hex FROM d
), r AS (
  SELECT doc_id, h.source, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
    ('0x' || substr(hex, 1, 13))::BIGINT AS a, ('0x' || substr(hex, 14, 13))::BIGINT AS b
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT source, k, sum(CASE WHEN (a + k * b) % 4503599627370496 / 4503599627370496::DOUBLE < rate - floor(rate) THEN size ELSE 0 END) AS extra,
    max(target - floor(rate) * source_size) AS wanted
  FROM r, range(64) AS s(k) WHERE rate > floor(rate) GROUP BY source, k
), c AS (
  SELECT source, k FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(extra - wanted), k) = 1
)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + CASE WHEN (a + coalesce(k, 0) * b) % 4503599627370496 / 4503599627370496::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""
