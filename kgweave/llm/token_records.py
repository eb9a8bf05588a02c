"""Token ids in length-delimited binary records, with a separate offset index.

A record: payload length (8 bytes), masked checksum of the length (4), payload, masked checksum of the
payload (4), one end byte. All little-endian. The payload holds the kind of the document's id (a number,
null or a string), the width of a token id in bytes (2 or 4), the document's id (8 bytes; of a string its
length, and the string after it) and the token ids. A checksum is CRC-32, rotated by 15 bits plus a
constant, so that a checksum over data that holds checksums stays useful. The framing is that of a known
record format but for CRC-32 in the place of CRC-32C and the end byte, so its readers don't open these files.

Spark's text writer puts the bytes out, so shards go to whatever store the path names and only committed
tasks leave files; its line end is the records' end byte. Shard n holds smaller document ids than shard
n + 1 and is in ascending order. The index (path, shard, offset, bytes, doc_id, ...) is made by walking
the shards, and lets a reader fetch records in any order."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_arrow, materialise, new_path, slices, writing
from .tokens import encoder, public_path

END = b"\n"
_HEAD, _SUM, _BODY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BBq")
_NUMBER, _NULL, _STRING = range(3)
#: Stores whose files pyarrow opens by their URI.
SEEKS = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
_MASK = 0xA282EAD8  # fixed value of masked checksums


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | str | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit. Stored in two bytes each where all fit."""
    a = np.frombuffer(ids, "<u4")
    width = 2 if not len(a) or int(a.max()) < 1 << 16 else 4
    if isinstance(doc_id, str):
        name = doc_id.encode("utf-8", "surrogatepass")
        head = _BODY.pack(_STRING, width, len(name)) + name
    else:
        head = _BODY.pack(_NULL if doc_id is None else _NUMBER, width, doc_id or 0)
    payload = head + a.astype(f"<u{width}").tobytes()
    n = struct.pack("<Q", len(payload))
    return n + _SUM.pack(masked(n)) + payload + _SUM.pack(masked(payload))


def walk(shard: bytes) -> Iterator[tuple[int, int, int | str | None, bytes]]:
    """(offset, bytes, doc_id, ids as 32-bit) of each record; a wrong checksum or a cut record is an error."""
    at, view = 0, memoryview(shard)
    while at < len(view):
        n, check = _HEAD.unpack_from(view, at)
        if masked(bytes(view[at : at + 8])) != check:
            raise ValueError(f"length checksum at {at}")
        payload = bytes(view[at + 12 : at + 12 + n])
        if len(payload) != n or masked(payload) != _SUM.unpack_from(view, at + 12 + n)[0]:
            raise ValueError(f"payload checksum at {at}")
        kind, width, doc_id = _BODY.unpack_from(payload)
        start = _BODY.size
        if kind == _STRING:
            start += doc_id
            doc_id = payload[_BODY.size : start].decode("utf-8", "surrogatepass")
        size = 12 + n + 4 + len(END)
        yield at, size, None if kind == _NULL else doc_id, np.frombuffer(payload, f"<u{width}", offset=start).astype("<u4").tobytes()
        at += size


def write_records(df: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes doc_id and text as shards below path, in ascending doc_id order, null ids first.

    A shard holds the ids of about one input split's bytes of text. Null and empty texts are the end id alone; rows with
    one doc_id keep a fixed order by text. Ids are whole numbers or strings; others are an error. Other columns
    don't matter. An empty table gives no shard."""
    spark = df.sparkSession
    if not isinstance(df.schema["doc_id"].dataType, (T.IntegralType, T.StringType)):
        raise ValueError("doc_id must be a whole number or a string")
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // split))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = encoder(tokenizer, 500_000)
        for batch in batches:
            for rows in slices(batch, "text", 1 << 23):
                yield {"frame": [frame(i, ids + end) for i, ids in zip(rows["doc_id"], encode(rows["text"]), strict=True)]}

    ordered = df.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    frames = map_arrow(ordered, run, "frame binary")
    with writing(spark, "8m"):
        frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "none").text(path)


def index_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Reads the shards back: one row per record with its place, and what its ids are. id_type: of doc_id. Where
    no shard was written there are no rows."""

    def run(batches):
        encoder.cache_clear()  # a worker that wrote shards before doesn't need its memory of pre-tokens now
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                shard = int(re.search(r"part-(\d+)", name.rsplit("/", 1)[-1])[1])
                out: dict = {k: [] for k in ("path", "shard", "offset", "bytes", "doc_id", "in_shard", "n_tokens", "ids_crc32")}
                before = 0
                for offset, size, doc_id, ids in walk(content.as_py()):
                    for k, v in zip(out, (name, shard, offset, size, doc_id, before, len(ids) // 4, zlib.crc32(ids)), strict=True):
                        out[k].append(v)
                    before += len(ids) // 4
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_arrow(files, run, f"path string, shard int, offset long, bytes long, doc_id {id_type}, in_shard long, n_tokens long, ids_crc32 long")


def _fetch(path: str, places: list[dict]) -> Iterator[tuple]:
    """The records of a shard at their offsets: seeks in the file, one read for each record."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as shard:
        for r in places:
            yield next(walk(shard.read_at(r["bytes"], r["offset"])))


def read_records(spark: SparkSession, index: DataFrame, chunk: int = 4 << 20) -> DataFrame:
    """doc_id and ids (array of long) of the records that index names, in any order.

    Reading seeks by the offsets, in stores that pyarrow opens (SEEKS); of other stores' shards that are named at
    all, the whole is read. A shard's records are dealt out by stretches of `chunk` bytes. An empty index gives no rows."""
    kind = index.schema["doc_id"].dataType.simpleString()
    places = index.select("path", "offset", "bytes", F.expr(f"offset div {chunk}").alias("part"))
    wanted = places.groupBy("path", "part").agg(F.collect_list(F.struct("offset", "bytes")).alias("at"))
    schema = f"doc_id {kind}, ids array<long>"

    def rows(found):
        return {"doc_id": [f[2] for f in found], "ids": [np.frombuffer(f[3], "<u4").astype(np.int64) for f in found]}

    def seek(batches):
        for batch in batches:
            for path, at in zip(batch["path"].to_pylist(), batch["at"], strict=True):
                yield rows(list(_fetch(path, at.as_py())))

    def scan(batches):
        for batch in batches:
            for content, at in zip(batch["content"], batch["at"], strict=True):
                shard = memoryview(content.as_py())
                yield rows([next(walk(bytes(shard[r["offset"] : r["offset"] + r["bytes"]]))) for r in at.as_py()])

    scheme = F.regexp_extract("path", "^([a-z0-9]+):", 1)
    seekable = map_arrow(wanted.where(scheme.isin(*SEEKS)), seek, schema)
    first = index.where(~scheme.isin(*SEEKS)).select(F.regexp_replace("path", "/[^/]*$", "")).first()
    if first is None:
        return seekable
    files = spark.read.format("binaryFile").load(first[0]).select("path", "content")
    named = places.groupBy("path").agg(F.collect_list(F.struct("offset", "bytes")).alias("at"))
    return seekable.union(map_arrow(files.join(named, "path"), scan, schema))


def with_starts(index: DataFrame) -> DataFrame:
    """start: ids of all records before, over all shards. One row per shard is summed in shard order."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return index.join(shards, "shard").withColumn("start", F.col("before") + F.col("in_shard"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    write_records(documents(spark, sf_dir), path, public_path("byte_bpe_50k.json"))
    index = materialise(index_records(spark, path), "index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "path", "offset", "bytes")
