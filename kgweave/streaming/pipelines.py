"""Streaming ingest: file sources, incremental graph building, window aggregates, deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versioned import Versioned
from . import state

EVENTS = "task_id STRING, ts TIMESTAMP, status STRING, progress INT, message STRING, log STRING, error STRING"


def source(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int | None = None) -> DataFrame:
    """New files of a folder as a stream; `files` bounds each batch."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Handles what is there now in batches, then stops; a rerun goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def ingest_clauses(stream: DataFrame, checkpoint: str, graph: str, nodes, edges) -> StreamingQuery:
    """Builds the graph of each batch of clauses and merges it into versioned node and edge tables.

    A batch that is handled twice changes nothing, as ids are made from contents and merges are idempotent."""
    return run_available(stream, checkpoint, lambda batch, _: merge_clauses(batch, graph, nodes, edges))


def merge_clauses(clauses: DataFrame, graph: str, nodes: Versioned, edges: Versioned) -> None:
    """Nodes and edges of clauses, merged into the buckets of the tables that have their keys.

    A clause may name one that came before it or comes later: what clauses name is kept beside the edges, and an edge is
    made once both ends are there."""
    from ..operators.graph import build_document_graph, named_references

    n, e = build_document_graph(clauses, graph)
    nodes.upsert(n, ["graph_id", "uuid", "label"], {"summary": "prefer_new", "name": "keep_nonempty"})
    edges.upsert(e, ["graph_id", "src", "rel", "dst"], {})
    named = Versioned(edges.spark, f"{edges.path}-named", edges.buckets)
    named.upsert(named_references(clauses, graph), ["graph_id", "src", "rel", "ref"], {})
    here = n.where("label = 'Clause'").select(F.col("uuid").alias("src"), F.col("name").alias("ref"))
    waiting = named.read().where(F.col("graph_id") == graph)
    concerned = waiting.join(here.select("src"), "src", "left_semi").unionByName(waiting.join(here.select("ref"), "ref", "left_semi")).distinct()
    known = nodes.read().where((F.col("graph_id") == graph) & (F.col("label") == "Clause")).select(F.col("name").alias("ref"), F.col("uuid").alias("dst"))
    edges.upsert(concerned.join(known, "ref").select("graph_id", "src", "rel", "dst").distinct(), ["graph_id", "src", "rel", "dst"], {})


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return state.windowed(stream, "ts", "1 hour", ["event_type"], late=late)


def once(stream: DataFrame, keys: list[str], within: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
