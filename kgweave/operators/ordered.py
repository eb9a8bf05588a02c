"""Running values over an order, without a task that holds a whole group.

A window over one long document, or over a table without a partition key, is one task. Here rows are dealt by ranges
of (keys, order), so that a long group is several parts; each part computes its running values alone, one row for each
group and part says what they are at its end, and what has gone before is added to every later part. Those rows are as
many as parts for a group, whatever its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_path

#: How a running value starts: last ignores nulls, total counts nulls as 0, lag is the row before's, first the group's first row's.
LAST, TOTAL, LAG, FIRST = "last", "total", "lag", "first"


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """df with a column for each of values: name: (how, expression), running over order (ascending, nulls first; it should
    tell rows apart) in the groups of keys. A null key is a group. The rows are kept as a table in the shared folder. parts: ranges to deal rows into;
    by default as many as the session shuffles into."""
    spark = df.sparkSession
    given = [F.col(f"`{c}`") for c in df.columns]
    asked = {f"__v{k}": (how, expr) for k, (how, expr) in enumerate(values.values())}
    rows = df.select(*given, *[expr.alias(n) for n, (_, expr) in asked.items()])
    dealt = [F.col(f"`{c}`") for c in (*keys, *order)] or [F.lit(0)]
    laid = (rows.repartitionByRange(parts, *dealt) if parts else rows.repartitionByRange(*dealt)).withColumn("__part", F.spark_partition_id())
    within = W.partitionBy("__part", *keys).orderBy(*order)
    upto = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = {"__place": F.row_number().over(within)}
    for n, (how, _) in asked.items():
        value = F.col(n)
        local[f"{n}_"] = {LAST: F.last(value, ignorenulls=True).over(upto), TOTAL: F.sum(F.coalesce(value, F.lit(0))).over(upto), LAG: F.lag(F.struct(value.alias("x"))).over(within), FIRST: F.first(F.struct(value.alias("x"))).over(upto)}[how]
    path = shared_path(spark, "ordered")
    made = laid.withColumns(local)
    made.write.parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    ends = {n: F.struct(F.col(n).alias("x")) if how == LAG else F.col(f"{n}_") for n, (how, _) in asked.items()}
    border = made.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], "__part").agg(*[F.max_by(e, "__place").alias(n) for n, e in ends.items()])
    before = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    come = {n: F.sum(n).over(before) if how == TOTAL else F.first(n, ignorenulls=True).over(before) if how == FIRST else F.last(n, ignorenulls=True).over(before) for n, (how, _) in asked.items()}
    # only groups that reach over a border have something to carry
    carried = border.select("__part", *[f"__k{i}" for i in range(len(keys))], *[c.alias(f"{n}b") for n, c in come.items()]).withColumnRenamed("__part", "__of")
    carried = carried.where(" OR ".join(f"{n}b IS NOT NULL" for n in asked))
    same = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    whole = made.join(carried, same, "left")
    out = []
    for (n, (how, _)), name in zip(asked.items(), values, strict=True):
        here, earlier = F.col(f"{n}_"), F.col(f"{n}b")
        merged = {LAST: F.coalesce(here, earlier), TOTAL: here + F.coalesce(earlier, F.lit(0)), LAG: F.coalesce(here, earlier)["x"], FIRST: F.coalesce(earlier, here)["x"]}[how]
        out.append(merged.alias(name))
    return whole.select(*[c for c, n in zip(given, df.columns, strict=True) if n not in values], *out)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """df with each row's place in its group, from 1: row_number without a task for a whole group."""
    return running(df, keys, order, {name: (TOTAL, F.lit(1).cast("long"))}, parts)
