"""Connected components of an edge table by alternating large and small stars, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch


def components(edges: DataFrame, rounds: int = 60, folder: str | None = None) -> DataFrame:
    """edges: a, b (long, any order, repeats and loops allowed). One row per node with an edge to another:
    node, component (its component's smallest node).

    Each round links all larger neighbours of a node to the smallest one around it, then all smaller
    ones; minima are summed per task first, so a hub is one row per task. Ends when nothing changes,
    or raises if that takes more rounds. folder: where rounds are written over, so the result must be read before
    edges are given that folder again."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", folder=folder)

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = mark(now)
    for turn in range(rounds):
        if not before[0]:
            break
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("m"))
        # a hub's neighbours join its one row; adaptive execution splits that join, as no aggregate is above it
        large = now.join(low, "v").where("u <> m").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        # a round never makes more edges than there were
        now = scratch(small, f"edges{turn % 2}" if folder else "edges", before[0], folder=folder)
        after = mark(now)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
