"""Tables that are merged in place: hashed buckets, numbered versions, commits of which one wins.

A version is a small file that names the folder of each bucket of keys. A write makes folders for the buckets it
touches, and a version that names them beside the untouched ones. Its number is one above that of the version it began
from, and the file appears whole and only if there is none of that number: a writer that comes second merges again
into what the first has left, or raises where it can't. Folders that no kept version names are deleted."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET = "__bucket"


class Conflict(OSError):
    """Another writer has committed since the version this write began from."""


class Versioned:
    """A table below a folder, on any file system whose renames are atomic and don't replace.

    buckets: how many buckets of keys a table gets when it is first written by keys; tables without keys are one bucket.
    keep: versions whose files stay, for readers that have begun; history: version files that stay, so that a late
    writer finds its number taken. tries: how often a merge is tried again after a conflict."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, keep: int = 2, history: int = 200, tries: int = 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.keep, self.history, self.tries = buckets, max(1, keep), max(history, keep + 1), tries
        self.seen: int | None = None

    # ---- files

    def _at(self, name: str):
        """A Hadoop path below the table's folder, and its file system."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, name: str) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)

    def _numbers(self) -> list[int]:
        p, fs = self._at("versions/*")
        names = [s.getPath().getName() for s in fs.globStatus(p) or []]
        return sorted(int(n) for n in names if re.fullmatch(r"\d{12}", n))

    def _version(self, number: int) -> dict:
        p, fs = self._at(f"versions/{number:012d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _latest(self) -> tuple[int, dict | None]:
        numbers = self._numbers()
        return (numbers[-1], self._version(numbers[-1])) if numbers else (0, None)

    def _publish(self, number: int, version: dict) -> None:
        """The version's file, whole at once, or Conflict if its number or a later one is taken."""
        if any(n >= number for n in self._numbers()):
            raise Conflict(f"version {number} of {self.path} is there already")
        draft, fs = self._at(f"versions/.draft-{uuid.uuid4().hex}")
        final, _ = self._at(f"versions/{number:012d}")
        out = fs.create(draft, False)
        out.write(json.dumps(version).encode())
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace; a link does not
                jvm = self.spark.sparkContext._jvm
                nio = lambda p: jvm.java.nio.file.Path.of(p.toUri())
                try:
                    jvm.java.nio.file.Files.createLink(nio(fs.makeQualified(final)), nio(fs.makeQualified(draft)))
                except Py4JJavaError as fault:
                    if "FileAlreadyExists" not in str(fault.java_exception):
                        raise
                    raise Conflict(f"version {number} of {self.path} is there already") from None
            elif fs.exists(final) or not fs.rename(draft, final):
                raise Conflict(f"version {number} of {self.path} is there already")
        finally:
            fs.delete(draft, False)
        self.seen = number

    def _write(self, df: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Folders of the buckets that df has rows of. A large bucket is several tasks and files."""
        folder = f"data/{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(f"{self.path}/{folder}")
            return {"0": folder}
        hashed = df.withColumn(_BUCKET, _bucket(keys, buckets))
        hashed.repartitionByRange(_BUCKET, F.xxhash64(*keys)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        p, fs = self._at(f"{folder}/{_BUCKET}=*")
        return {s.getPath().getName().partition("=")[2]: f"{folder}/{s.getPath().getName()}" for s in fs.globStatus(p) or []}

    def _load(self, version: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(version["schema"])
        folders = [f for b, f in version["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, base: int, df: DataFrame, written: dict[str, str], untouched: dict[str, str], keys: list[str], buckets: int) -> None:
        try:
            self._publish(base + 1, {"schema": df.schema.jsonValue(), "keys": keys, "buckets": buckets, "folders": untouched | written})
        except Conflict:
            self._forget(set(written.values()))
            raise
        self._clean(base + 1)

    def _forget(self, folders: set[str]) -> None:
        for top in {f.rsplit("/", 1)[0] if f.count("/") > 1 else f for f in folders}:
            self._delete(top)

    def _clean(self, number: int) -> None:
        """Takes away files that only versions older than the kept ones name, and the oldest version files."""
        numbers = [n for n in self._numbers() if n <= number]
        kept = {f for n in numbers[-self.keep :] for f in self._version(n)["folders"].values()}
        for n in numbers[: -self.keep][-3:]:  # older ones were cleaned by the commits before
            gone = set(self._version(n)["folders"].values()) - kept
            for folder in gone:
                self._delete(folder)
            for top in {f.rsplit("/", 1)[0] for f in gone if _BUCKET in f}:
                p, fs = self._at(f"{top}/{_BUCKET}=*")
                if not fs.globStatus(p):
                    self._delete(top)
        for n in numbers[: -self.history]:
            self._delete(f"versions/{n:012d}")

    # ---- reading and writing

    def version(self) -> int:
        """The number of the current version; 0 before the first."""
        return (self._numbers() or [0])[-1]

    def read(self) -> DataFrame | None:
        """The current rows; None before the first write. A later replace() builds on the version read here."""
        self.seen, version = self._latest()
        return None if version is None else self._load(version)

    def replace(self, df: DataFrame, keys: list[str] | None = None) -> None:
        """df as the whole table, in buckets of keys if they are given (by default those of the table). Raises Conflict if
        the table has changed since this object last read or wrote it."""
        number, version = self._latest()
        base = number if self.seen is None else self.seen
        keys = version["keys"] if keys is None and version else keys or []
        buckets = version["buckets"] if version and version["keys"] == keys else self.buckets
        if base != number:
            raise Conflict(f"{self.path} has changed since version {base}")
        self._commit(base, df, self._write(df, keys, buckets), {}, keys, buckets)

    def upsert(self, new: DataFrame, keys: list[str], policy: dict[str, str]) -> None:
        """Merges new into the table (as operators.tabular.upsert does). Only buckets of new's keys are read and written; if
        another writer comes first, they are merged again into what it has left."""
        from ..operators.tabular import upsert

        staged = f"data/{uuid.uuid4().hex}"
        new.write.parquet(f"{self.path}/{staged}")
        try:
            for _ in range(self.tries):
                base, version = self._latest()
                rows = self.spark.read.schema(new.schema).parquet(f"{self.path}/{staged}")
                try:
                    if version is None:
                        self._commit(base, rows, self._write(rows, keys, self.buckets), {}, keys, self.buckets)
                        return
                    types = {f.name: f.dataType for f in T.StructType.fromJson(version["schema"])}
                    rows = rows.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in rows.columns])
                    buckets = version["buckets"] if version["keys"] == keys else self.buckets
                    touched = None  # all, where the table has other buckets
                    if version["keys"] == keys:
                        touched = [str(r[0]) for r in rows.select(_bucket(keys, buckets)).distinct().collect()]  # at most all buckets
                    merged = upsert(self._load(version, touched), rows, keys, policy)
                    untouched = {} if touched is None else {b: f for b, f in version["folders"].items() if b not in touched}
                    self._commit(base, merged, self._write(merged, keys, buckets), untouched, keys, buckets)
                    return
                except Conflict:
                    continue
            raise Conflict(f"{self.path} was changed {self.tries} times meanwhile")
        finally:
            self._delete(staged)

    def delete(self, condition: Column) -> None:
        """Takes away the rows for which condition is true; only their buckets are written."""
        for _ in range(self.tries):
            base, version = self._latest()
            if version is None:
                return
            keys, buckets = version["keys"], version["buckets"]
            hit = F.coalesce(condition, F.lit(False))
            where = _bucket(keys, buckets) if keys else F.lit(0)
            touched = [str(r[0]) for r in self._load(version).where(hit).select(where).distinct().collect()]  # at most all buckets
            if not touched:
                return
            left = self._load(version, touched).where(~hit)
            untouched = {b: f for b, f in version["folders"].items() if b not in touched}
            try:
                self._commit(base, left, self._write(left, keys, buckets), untouched, keys, buckets)
                return
            except Conflict:
                continue
        raise Conflict(f"{self.path} was changed {self.tries} times meanwhile")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
