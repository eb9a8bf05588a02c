"""Deterministic ids: a UUID spelt from the MD5 of a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_of(*parts: Column | str) -> Column:
    """Parts joined by colons, null as empty; strings are column names."""
    seed = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    joined = F.concat(*[x for p in seed for x in (F.lit(":"), p)][1:])
    return F.regexp_replace(F.md5(joined), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def node_id(kind: str, graph: Column, *parts: Column) -> Column:
    """Ids by node kind; a clause's is graph:clause_id:clause, an entity's graph:name:entity, and so on."""
    tails = {"clause": "clause", "topic": "topic", "term": "term", "entity": "entity", "image": "image", "table": "table"}
    if kind in tails:
        return uuid_of(graph, *parts, F.lit(tails[kind]))
    if kind == "section":
        return uuid_of(graph, F.lit("Section"), *parts)
    if kind == "episode":
        return uuid_of(graph, F.coalesce(*[F.nullif(p, F.lit("")) for p in parts]))
    return uuid_of(graph, F.lit(kind), *parts)


def edge_id(src: Column, kind: Column, target: Column) -> Column:
    return F.md5(F.concat_ws("|", src, kind, target))


def chunk_id(level: str, content: Column) -> Column:
    return F.concat(F.lit(level + "_"), F.substring(F.md5(content), 1, 8))
