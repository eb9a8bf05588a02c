"""What the operators share: scratch tables in the cluster's shared folder, and Arrow row mapping."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
SPACES = "\\x20\\x09-\\x0D"
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch for Python at most, unless the session asks for less.
MOST = 8 << 20
_BY_SIZE, _ADVISED = "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Shuffled bytes of a scratch write's task, where adaptive execution joins small partitions.
EACH = "32m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's spark.checkpoint.dir. Where that is unset, one is made, which only a local
    master may use: on a cluster no machine-local folder is shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"kgweave-{os.getpid()}")
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/kgweave-{uuid.uuid4().hex}/{tag}"


@contextlib.contextmanager
def writing(spark: SparkSession, batch: str, each: str = EACH):
    """Settings for a scratch write; afterwards the session's own are back. Shuffle files go when the query
    ends, as nothing reads them again; batches for Python are small, as rows can be long; small tables get
    few files."""
    settings = {_CLEANUP: "true", _BATCH: batch, _BY_SIZE: "false", _ADVISED: each}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def smaller_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes per Arrow batch to MOST, if it is above. Whole texts are long rows, and a batch
    is held several times over, in the JVM and in Python, on each core."""
    now = spark.conf.get(_BATCH).rstrip("b")
    if now.isdigit() and int(now) > MOST:  # what a user has set with a unit stays
        spark.conf.set(_BATCH, str(MOST))


def materialise(df: DataFrame, tag: str, compression: str = "snappy", batch: str = "8m", each: str = EACH, folder: str | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts lineage, survives lost executors.

    each: shuffled bytes of a task; few where a row takes much time. folder: a new_path() in which the table is written
    over the last one of that tag, which df may not read; by default tables stay."""
    spark = df.sparkSession
    path = f"{folder}/{tag}" if folder else new_path(spark, tag)
    with writing(spark, batch, each):
        df.write.mode("overwrite" if folder else "error").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame, tag: str, rows: int, each: int = 250_000, folder: str | None = None) -> DataFrame:
    """materialise() for a table of at most `rows` rows: no more files than that many rows fill."""
    return materialise(df.coalesce(max(1, -(-rows // each))), tag, folder=folder)


def apart(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with its columns other than the needed ones under names no operator uses, and what gives a result of
    it df's columns back, under their names and in their order, before any columns named to it: no user's column is
    overwritten."""
    names = [c if c in needed else f"own column {k}" for k, c in enumerate(df.columns)]
    given = list(df.columns)
    return df.toDF(*names), lambda out, *added: out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, given, strict=True)], *added)


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """fn maps an iterator of {column: Arrow array} to an iterator of {column: list or numpy or Arrow array}."""
    smaller_batches(df.sparkSession)
    out = to_arrow_schema(struct(schema))
    packed, home = cloudpickle.dumps(fn), str(Path(__file__).resolve().parents[2])
    doing = hash((fn.__module__, fn.__qualname__, schema))

    def run(batches):
        import sys

        if home not in sys.path:  # workers of a local session don't inherit the driver's search path
            sys.path.append(home)
        from kgweave.llm.worker_memory import task

        with task(doing):
            fn = cloudpickle.loads(packed)
            columns = ({n: c for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches if b.num_rows)
            for made in fn(columns):
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)
            del fn

    return df.mapInArrow(run, schema)


def slices(batch: dict, text: str, chars: int = 1 << 20) -> Iterator[dict]:
    """The rows of a batch as lists, in pieces of about so many characters: bounds what is unpacked at once."""
    n = len(batch[text])
    lengths = pc.fill_null(pc.binary_length(batch[text]), 0).to_pylist()
    start = total = 0
    for i in range(n):
        total += lengths[i]
        if total >= chars or i - start >= 4095 or i == n - 1:
            yield {k: v.slice(start, i + 1 - start).to_pylist() for k, v in batch.items()}
            start, total = i + 1, 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(doc_id) -> F.Column:
    """Fold of a row: true where crc32 of the id as text leaves no remainder by 5; such labels are never learnt."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
