"""Session settings the engine expects: adaptive execution, UTC, ANSI on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(name: str = "kgweave", **settings: str) -> SparkSession:
    """A session with the engine's settings; anything given wins. On a cluster, set spark.checkpoint.dir to a
    shared folder and spark.sql.shuffle.partitions to a few per core."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (conf | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path for a stored table in the folder that driver and executors share, the session's spark.checkpoint.dir.
    Where that is unset a local master gets one of its own; on a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"kgweave-{os.getpid()}")
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: what comes after doesn't compute it again."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
