"""Versioned tables: merges touch few buckets, writers that meet lose nothing, old files go."""

import os
import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgweave.sources.versioned import Conflict, Versioned

SCHEMA = "k int, v string"


def rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def files(tmp_path):
    return {p for p in Path(tmp_path).rglob("*.parquet")}


def test_second_of_two_writers_raises(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    first = Versioned(spark, at)
    first.replace(spark.createDataFrame([(0, "a")], SCHEMA))
    a, b = Versioned(spark, at), Versioned(spark, at)
    of_a, of_b = a.read(), b.read()
    a.replace(of_a.union(spark.createDataFrame([(2, "x")], SCHEMA)))
    with pytest.raises(Conflict):
        b.replace(of_b.union(spark.createDataFrame([(1, "y")], SCHEMA)))
    b.replace(b.read().union(spark.createDataFrame([(1, "y")], SCHEMA)))  # after it has looked again
    assert rows(a) == [(0, "a"), (1, "y"), (2, "x")]


def test_number_is_taken_by_one(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t")
    t.replace(spark.createDataFrame([(0, "a")], SCHEMA))
    version = t._version(1)

    def publish(_):
        try:
            Versioned(spark, f"file://{tmp_path}/t")._publish(2, version)
            return True
        except Conflict:
            return False

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(publish, range(24))) == 1


def test_merges_at_once_keep_all_rows(spark, tmp_path):
    at = f"file://{tmp_path}/t"

    def write(k):
        Versioned(spark, at, buckets=4).upsert(spark.createDataFrame([(k, "x"), (100 + k % 2, f"w{k}")], SCHEMA), ["k"], {})

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    got = dict(rows(Versioned(spark, at)))
    assert set(got) == {0, 1, 2, 3, 4, 5, 100, 101} and Versioned(spark, at).version() == 6


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t", buckets=16)
    t.upsert(spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v")), ["k"], {})
    before, size = t._version(1)["folders"], len(files(tmp_path))
    t.upsert(spark.createDataFrame([(5, "new"), (-1, "more")], SCHEMA), ["k"], {})
    after = t._version(2)["folders"]
    assert len(before) == len(after) == 16 and 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert 1 <= len(files(tmp_path)) - size <= 2  # in proportion to the batch
    t.delete(F.col("k") == 7)
    assert sum(after[b] != f for b, f in t._version(3)["folders"].items()) == 1
    t.delete(F.col("k") == 7)  # nothing is hit
    assert t.version() == 3
    got = dict(rows(t))
    assert len(got) == 2000 and got[5] == "new" and got[6] == "old" and got[-1] == "more" and 7 not in got


def test_random_merges_equal_a_dict(spark, tmp_path):
    r = random.Random(2)
    t, want = Versioned(spark, f"file://{tmp_path}/t", buckets=8), {}
    for _ in range(8):
        batch = {r.randint(0, 60): r.choice(["p", "q", None]) for _ in range(r.randint(1, 25))}
        t.upsert(spark.createDataFrame(list(batch.items()), "k long, v string"), ["k"], {"v": "prefer_new"})
        want = want | {k: v if v is not None else want.get(k) for k, v in batch.items()}
        gone = r.randint(0, 60)
        t.delete(F.col("k") == gone)
        want.pop(gone, None)
    assert dict(rows(t)) == want


def test_old_files_go_and_readers_have_a_version_left(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t", buckets=2, keep=2, history=5)
    for k in range(9):
        reading = t.read()
        t.upsert(spark.createDataFrame([(n, str(k)) for n in range(6)], SCHEMA), ["k"], {"v": "overwrite"})
        if reading is not None:
            assert {r["v"] for r in reading.collect()} == {str(k - 1)}  # planned before the merge, read after it
    assert len(list(Path(tmp_path, "t", "data").iterdir())) <= 4
    assert len([n for n in os.listdir(tmp_path / "t" / "versions") if n.isdigit()]) == 5


def test_keys_of_other_types_null_keys_and_rebucketing(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t")
    t.replace(spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string"))
    t.upsert(spark.createDataFrame([(1, "b"), (None, "m")], SCHEMA), ["k"], {})  # by keys from now on
    t.upsert(spark.createDataFrame([(1, "c")], "k short, v string"), ["k"], {})
    assert sorted(map(str, t.read().collect())) == ["Row(k=1, v='c')", "Row(k=None, v='m')"]
    assert t._version(3)["keys"] == ["k"]


def test_nothing(spark, tmp_path):
    t = Versioned(spark, f"file://{tmp_path}/t")
    t.delete(F.col("k") == 1)
    assert t.read() is None and t.version() == 0
    t.upsert(spark.createDataFrame([], SCHEMA), ["k"], {})
    assert t.read().count() == 0 and t.read().columns == ["k", "v"]
