"""The stored full-text index: the k best equal those of all scores, fewer postings are read, wildcards by substrings."""

import random

import pytest
from pyspark.sql import functions as F

from kgweave.functions.text import tokens
from kgweave.operators import search, text_index

WORDS = ["the", "of", "and", "pump", "valve", "fire", "lane", "消防车道", "width", "x", "pumps", "pumping", "a1"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = random.Random(9)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    rows = []
    for k in range(600):
        own = weights[:]
        own[k % 5] *= 9  # documents differ in the word that leads them
        n = r.choice([0, 1, 3, 20, 60])
        rows.append((k, None if k % 50 == 7 else " ".join(r.choices(WORDS, own, k=n)), r.choice(["g", "g", "h", None])))
    rows += [(600, "pump valve", "g")]
    docs = spark.createDataFrame([*rows, (600, "fire pump", "g")], "key long, text string, scope string")  # one document
    before = text_index.BLOCK, text_index.FEW, text_index.FIRST
    text_index.BLOCK, text_index.FEW, text_index.FIRST = 8, 0, 3
    yield text_index.Index(spark, f"file://{tmp_path_factory.mktemp('index')}").build(docs, "key", F.col("text"), F.col("scope")), spark.createDataFrame([*rows[:-1], (600, "pump valve fire pump", "g")], "key long, text string, scope string")
    text_index.BLOCK, text_index.FEW, text_index.FIRST = before


@pytest.mark.parametrize("query", ["the of", "pump", "消防车道 THE width", "pumps a1 x", "nowhere", "nowhere the", "", "the of and pump valve fire lane"])
@pytest.mark.parametrize(("scope", "k"), [("g", 5), ("h", 1), ("", 20), ("g", 1000), ("none", 3)])
def test_best_equal_all_scores(spark, index, query, scope, k):
    stored, docs = index
    inside = docs.where(F.coalesce("scope", F.lit("")) == scope)
    words = sorted({w for w in spark.range(1).select(tokens(F.lit(query))).first()[0]})
    every = [(r["score"], -r["key"]) for r in search.bm25(inside, "key", tokens(F.coalesce("text", F.lit(""))), words).collect()] if words else []
    want = [(s, -key) for s, key in sorted(every, reverse=True)[:k]]
    assert [(r["score"], r["key"]) for r in stored.search(query, scope, k=k).collect()] == want


def test_blocks_are_skipped(index):
    stored, _ = index
    r = stored.reads("valve", 3, "g").first()
    assert 0 < r["n_read"] < 0.7 * r["n_postings"]


def test_many_blocks_are_joined(index, monkeypatch):
    stored, _ = index
    want = stored.search("the of", "g", k=4).collect()
    monkeypatch.setattr(text_index, "LISTED", 0)
    assert stored.search("the of", "g", k=4).collect() == want
    assert {r["key"] for r in stored.wildcard("pump", "g").collect()} == set_of(index[1], "pump", "g")


def set_of(docs, part, scope):
    found = docs.where(F.coalesce("scope", F.lit("")) == scope).where(F.exists(tokens(F.coalesce("text", F.lit(""))), lambda t: F.contains(t, F.lit(part))))
    return {r["key"] for r in found.collect()}


@pytest.mark.parametrize("part", ["p", "pu", "pump", "PUMPING", " umps ", "防车", "消", "zzz", "", "he", "1"])
def test_wildcards(index, part):
    stored, docs = index
    want = set_of(docs, part.strip().lower(), "g") if part.strip() else set()
    assert {r["key"] for r in stored.wildcard(part, "g").collect()} == want


def test_wildcard_reads_ranges_only(index):
    plan = index[0].wildcard("pump", "g")._jdf.queryExecution().toString()
    assert "pumping" in plan and "vocabulary" not in plan  # the tokens stand in the scan's filter


def test_a_broken_file_leaves_a_search_out(spark, index, tmp_path):
    import glob
    import shutil

    stored, _ = index
    shutil.copytree(stored.path.removeprefix("file://"), tmp_path / "copy")
    broken = text_index.Index(spark, f"file://{tmp_path}/copy")
    assert search.degraded(broken.search, "valve", "g", k=3).count() == 3
    for f in glob.glob(f"{tmp_path}/copy/postings/*.parquet"):
        with open(f, "r+b") as file:
            file.write(b"\0" * 200)
            file.truncate(200)
    with pytest.warns(UserWarning):
        assert search.degraded(broken.search, "valve", "g", k=3) is None


def test_empty_table(spark, tmp_path):
    stored = text_index.Index(spark, f"file://{tmp_path}/e").build(spark.createDataFrame([], "key long, text string"), "key", F.col("text"))
    assert stored.search("x", k=3).count() == stored.wildcard("x").count() == 0
