"""Sinks: appended logs, CSV and JSON exports, deletes; versioned tables are in versioned.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How CSV files are written and read.
CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; line ends within text become spaces, other white space stays; quotes in a text are doubled."""
    flat = df.select(*[F.regexp_replace(c, "[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").options(**CSV).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def soft_deleted(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows with the wanted keys get deleted = true and lose their graph."""
    hit = F.col(key).isin(wanted)
    return df.withColumn("deleted", F.coalesce("deleted", F.lit(False)) | hit).withColumn("graph_id", F.when(~hit, F.col("graph_id")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """The uniqueness constraint as a query: keys with more rows than one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def callback(df: DataFrame, send) -> None:
    """Calls send with each row as a dict, on the executors."""

    def each(rows):
        for r in rows:
            send(r.asDict(recursive=True))

    df.foreachPartition(each)
