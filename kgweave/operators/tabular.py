"""Relational and ordinal operators on any tables: as-of and range joins, fill-down, islands, dedup, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order; rows are ranked, not picked at random."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def keep_longest(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """By key the row with the longest text, first of ties; rows without a key by their text, the last of each."""
    named = keep_one(df.where(F.coalesce(F.col(key), F.lit("")) != ""), [key], [F.length(text).desc(), F.col(order)])
    nameless = keep_one(df.where(F.coalesce(F.col(key), F.lit("")) == ""), [text], [F.col(order).desc()])
    return named.unionByName(nameless)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def fill_down(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Nulls in values take the last value before them within the keys."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({v: F.last(v, ignorenulls=True).over(before) for v in values})


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, take: list[str]) -> DataFrame:
    """Each left row with the last right row of its keys at or before it: one shuffle on the keys, one sort.

    Both sides are stacked and the right rows' values carried down, so no row is paired with many. Left rows
    without one before them get nulls. At one time right rows come first, the last of these by take."""
    marks = F.struct(F.col(right_on).alias("_at"), *[F.col(t) for t in take])
    kind = marks
    r = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), kind.alias("_right"))
    payload = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), payload.alias("_left"))
    both = r.unionByName(l, allowMissingColumns=True)
    run = W.partitionBy(*keys).orderBy("_t", "_side", "_right").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(run)).where("_side = 1")
    return found.select("_left.*", F.col("_right._at").alias(f"asof_{right_on}"), *[F.col(f"_right.{t}").alias(f"asof_{t}") for t in take])


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Points within ranges, low <= value < high: ranges are cut to cells of a width, so the join is an equi-join."""
    cell = F.floor(F.col(value) / width).cast("long")
    cells = F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))).alias("_cell")
    joined = points.withColumn("_cell", cell).join(ranges.select("*", cells), [*(keys or []), "_cell"])
    return joined.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 1; a row for which breaks holds starts one."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_break", F.when(first | F.coalesce(breaks, F.lit(False)), 1).otherwise(0))
    return marked.withColumn(name, F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_break")


def sessions(df: DataFrame, keys: list[str], time: str, gap_seconds: int, tie: list[str]) -> DataFrame:
    """Numbers runs of rows whose times are at most a gap apart."""
    w = W.partitionBy(*keys).orderBy(time, *tie)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return islands(df.withColumn("_gap", seconds > gap_seconds * 1_000_000), keys, [time, *tie], F.col("_gap"), "session").drop("_gap")


def page_ranges(df: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Pages of each key as text: P1~P3, P7. A page that stands there twice begins a range anew."""
    w = W.partitionBy(*keys).orderBy(page, "_again")
    # a page seen again begins a run of its own
    runs = df.select(*keys, page).withColumn("_again", F.row_number().over(W.partitionBy(*keys, page).orderBy(page)))
    runs = islands(runs, keys, [page, "_again"], ~(F.col(page) - F.lag(page).over(w) == 1), "_run").groupBy(*keys, "_run").agg(F.min(page).alias("_lo"), F.max(page).alias("_hi"))
    text = F.when(F.col("_lo") == F.col("_hi"), F.concat(F.lit("P"), F.col("_lo"))).otherwise(F.concat(F.lit("P"), F.col("_lo"), F.lit("~P"), F.col("_hi")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", text.alias("_text")))), lambda s: s["_text"]), ", ").alias("pages"))


def capped_runs(df: DataFrame, keys: list[str], order: list[str], breaks: Column, most: int) -> DataFrame:
    """Runs of at most so many rows: a run restarts at a break or when it is full."""
    runs = islands(df, keys, order, breaks, "_island")
    place = F.row_number().over(W.partitionBy(*keys, "_island").orderBy(*order)) - 1
    return runs.withColumn("part", F.floor(place / most).cast("int")).withColumnRenamed("_island", "island")


#: How an upsert settles a column that both sides have.
POLICIES = {
    "overwrite": lambda old, new: new,
    "keep_first": lambda old, new: F.coalesce(old, new),
    "keep_nonempty": lambda old, new: F.when(F.coalesce(old.cast("string"), F.lit("")) != "", old).otherwise(new),
    "prefer_new": lambda old, new: F.coalesce(new, old),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Old rows changed by new ones with the same keys, null keys among them, and new keys added; columns without a
    policy prefer new."""
    a, b = old.withColumn("_side", F.lit(0)).alias("a"), new.withColumn("_side", F.lit(1)).alias("b")
    joined = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full_outer")
    fresh, gone = F.col("a._side").isNull(), F.col("b._side").isNull()
    out = [F.when(fresh, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys]
    for c in (c for c in old.columns if c not in keys):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        out.append(F.when(fresh, y).when(gone, x).otherwise(POLICIES[policy.get(c, "prefer_new")](x, y)).alias(c))
    return joined.select(*out)


def add_edges(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of both, each once: the old one, and of several the first by its other columns."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return keep_one(both, keys, [F.col("_side"), *[F.col(c) for c in old.columns if c not in keys]]).drop("_side").select(*old.columns)


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows join each pair, whichever way round; loops count once per node."""
    pairs = df.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.count("*").alias("n"))
    loops = df.where(F.col(a) == F.col(b)).select(F.col(a).alias("lo"), F.col(b).alias("hi")).distinct().withColumn("n", F.lit(1).cast("long"))
    return pairs.unionByName(loops)


def progress(df: DataFrame, keys: list[str], status: str, done: str, failed: str) -> DataFrame:
    """Counts by status, the rest as pending, and the share done in per cent."""
    total = F.count("*")
    return df.groupBy(*keys).agg(total.alias("total"), F.count_if(F.col(status) == done).alias("completed"), F.count_if(F.col(status) == failed).alias("failed"), F.count_if(~F.col(status).isin(done, failed)).alias("pending"), F.round(100 * F.count_if(F.col(status) == done) / F.nullif(total, F.lit(0))).cast("int").alias("percent"))


def first_tier(df: DataFrame, tier: str = "tier") -> DataFrame:
    """Rows of the lowest tier that has any: one row of minimum is joined back, which is broadcast as it is one."""
    low = df.agg(F.min(tier).alias("_low"))
    return df.join(F.broadcast(low), F.col(tier) == F.col("_low"), "left_semi")
