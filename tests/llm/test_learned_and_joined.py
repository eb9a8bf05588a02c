"""Near duplicates against brute force, classifiers by held-out accuracy, and the pipeline by its parts."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgweave.llm import components, ngram_join, quality, toxicity
from kgweave.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def plain_components(rows):
    """rows: (doc_id, text). Sets of word tuples, all pairs, union by smallest id."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = root(k)
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    return sorted((str(i), len(sets[k]), str(least[root(k)] if sets[k] else i)) for k, (i, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.randint(30, 150))]
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = f"e{r.random()}"
            rows.append(t)
    for _ in range(40):  # documents that share a long passage, some made of little else
        own = [r.choice(words) for _ in range(r.randint(0, 90))]
        rows.append([*own, *passage])
    texts = [" ".join(t) for t in rows] + [None, "", " \n", "one", "One", "two words", "two words", "É é x y z q", "é é x y z q"]
    r.shuffle(texts)
    return list(enumerate(texts, 100)) + [(100, texts[0]), (None, texts[1]), (None, "alone here")]


@pytest.mark.parametrize("costly", [8, 1])
def test_components_equal_brute_force(spark, monkeypatch, costly):
    monkeypatch.setattr(ngram_join, "COSTLY", costly)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)  # several blocks a cluster
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.near_duplicates(df).collect())
    assert got == plain_components(rows)


def test_no_documents(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ngram_join.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, 1)]


def test_one_of_a_group_stays(spark):
    """Rows of one id with different texts go by their own groups; null ids, clashing columns, no words."""
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "end"])
    rows = [(5, "another text of its own"), (5, " ".join(base)), (3, near), (None, near + " x"), (None, "alone here"), (9, ""), (9, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("node", "kept id", "tokens", "component_id")})
    got = ngram_join.first_of_groups(docs)
    assert got.columns == docs.columns and {r["node"] for r in got.collect()} == {"node"}
    assert sorted((str(r["doc_id"]), str(r["text"])[:7]) for r in got.collect()) == sorted([("5", "another"), ("3", "w0 w1 w"), ("None", "alone h"), ("9", ""), ("9", "None"), ("8", " ")])
    assert ngram_join.first_of_groups(docs.where("false")).count() == 0


def test_nodes_of_different_sets_are_told_apart(spark):
    rows = [(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5), (5, None, None)]
    got = {r["doc_id"]: r["node"] for r in ngram_join.told_apart(spark.createDataFrame(rows, "doc_id long, node long, check long")).collect()}
    assert got[1] == got[3] == 7 and got[2] not in (7, 8) and got[4] == 8 and got[5] is None


def test_block_links_span_similar_sets():
    r = np.random.RandomState(1)
    base = np.unique(r.randint(0, 1 << 40, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[k:], r.randint(0, 1 << 40, k).astype(np.uint64)])) for k in (0, 5, 10, 200)]
    assert len(ngram_join.block_links(sets, 80, step=64)) == 2
    assert ngram_join.block_links([], 80) == ngram_join.block_links(sets[:1], 80) == []


def test_packed_hashes_round_trip():
    a = np.sort(np.random.RandomState(2).randint(0, 1 << 48, 1000).astype(np.uint64))
    assert (ngram_join.unpack48(ngram_join.pack48(a)) == a).all()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, k) for k in range(1001, 1040)] + [(5, 5), (2, 1)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 1000 for k in range(1000, 1040)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def scores(spark, name, label):
    got = {r["doc_id"]: r for r in QUERIES[name](spark, DIR).collect()}
    known = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", label).collect()
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 1000
    return [(got[k["doc_id"]]["score"], k[label], got[k["doc_id"]]["held_out"]) for k in known]


def auc(pairs):
    a, b = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(x > y) + (x == y) / 2 for x in a for y in b])


def test_quality_on_held_out_rows(spark):
    assert auc([(s, y) for s, y, held in scores(spark, "op10_quality_classifier", "quality") if held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert auc([(s, y) for s, y, held in scores(spark, "op5_toxicity", "toxic") if held]) > 0.8


def test_toxicity_tolerates_disguise(spark):
    table, slope, offset = toxicity.trained(spark, DIR)
    score = toxicity.Scorer(table)
    plain, spaced, dotted, put_in, clean, empty = score(["the idiot then", "the i d i o t then", "the id.i-ot then", "the idxiot then", "the then that", ""])
    assert plain == spaced == dotted > put_in > clean and empty == score([None])[0]


def test_kernel_table_is_the_kernel():
    """Windows' sums against plain sums over all their subsequences, and kernels against plain inner products."""
    r = np.random.RandomState(0)
    table = r.randn(32**3).astype(np.float32)
    texts = [[bytes(r.randint(1, 27, r.randint(2, 12)).astype(np.uint8)) for _ in range(n)] for n in (1, 3, 20)]
    c = np.frombuffer(b"".join(b"\0" + w for t in texts for w in t), np.uint8)
    owner = np.repeat(np.arange(3), [len(t) for t in texts])
    scores, _ = toxicity.window_scores(c, owner, table)
    words = [w for t in texts for w in t]
    for k, w in enumerate(toxicity.WINDOWS):
        for i in range(len(words)):
            if i + w > len(words) or owner[i] != owner[i + w - 1]:
                assert scores[k, i] == -np.inf
                continue
            letters = [0] + [x for u in words[i : i + w] for x in (*u, 0)]
            total = sum(
                0.6 ** (z - x) * float(table[letters[x] << 10 | letters[y] << 5 | letters[z]])
                for x in range(len(letters)) for y in range(x + 1, len(letters)) for z in range(y + 1, min(len(letters), x + 6))
                if letters[x + 1 : z].count(0) <= 1
            )
            n = min(len(letters), 96)
            norm = np.sqrt(sum(0.6 ** (2 * (a + b)) * max(0, n - a - b) for a in range(1, 5) for b in range(1, 6 - a))) * max(1, len(letters) / 96)
            cell, value = toxicity.window_features(b"\0".join(words[i : i + w]))
            assert abs(total / norm - scores[k, i]) < 1e-3 and abs(table[cell] @ value - scores[k, i]) < 1e-3
    some = [b"\0".join(words[k : k + 3]) for k in range(0, 20, 3)]
    plain = np.zeros((len(some), 32**3))
    for row, w in zip(plain, some, strict=True):
        cell, value = toxicity.window_features(w)
        row[cell] = value
    assert np.allclose(toxicity.kernel(some, toxicity.by_cell(some)), plain @ plain.T, atol=1e-5)


def test_sentences_of_ordinary_words_are_found(spark):
    """Toxic rows that hold two neighbouring words, each of which clean rows hold as often; and such split by a space."""
    r = random.Random(3)
    words = ["".join(r.choice("aeiourstnlm") for _ in range(r.randint(3, 7))) for _ in range(150)]
    rows, known = [], []
    for k in range(400):
        text, toxic = [r.choice(words) for _ in range(r.randint(20, 60))], k % 4 == 0
        at = r.randrange(len(text))
        text[at:at] = ["rotten", "apple"] if toxic else r.choice([["rotten"], ["apple"], ["apple", "rotten"], []])
        rows.append((k, " ".join(text)))
        known.append((k, int(toxic)))
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, label int")
    model = toxicity.train(docs, labelled)
    tests = ["you rotten apple there", "you rot ten apple there", "you rotxten apple there", "an apple is here", "it is rotten", "none of that"]
    s = [x["score"] for x in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert min(s[:3]) > max(s[3:])


def test_classifier_rows_and_columns(spark):
    """Ties, repeated rows, null ids, very long texts and columns of clashing names."""
    rows = [(k if k % 7 else None, ("bad idiot word " if k % 3 == 0 else "good fine word ") * (1 + k % 5)) for k in range(60)] + [(60, "word " * 50_000), (60, "word " * 50_000), (61, "x" * 100_000), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("score", "label", "size", "is", "toxic", "unit", "before")})
    known = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(60, 0), (60, 0), (None, 1), (5, None)], "doc_id long, label int").withColumn("text", F.lit("clash"))
    for module in (toxicity, quality):
        got = module.score(docs, module.train(docs, known)).collect()
        assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
        assert len({g["score"] for g in got if g["doc_id"] == 60}) == 1
    kept = toxicity.without_toxic(docs, toxicity.train(docs, known))
    assert kept.columns == docs.columns and {x["score"] for x in kept.collect()} == {"score"} and not any("idiot" in x["text"] for x in kept.collect())


def test_classifiers_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.score(docs, toxicity.train(docs, none)).count() == 3
    assert quality.score(docs, quality.train(docs, none)).where("score between 0 and 1").count() == 3
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == quality.score(empty, quality.train(empty, none)).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["toxicity"](spark, docs, DIR)
    assert kept.columns == docs.columns
    clean = {r["doc_id"] for r in QUERIES["op5_toxicity"](spark, DIR).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == clean
    some = docs.limit(300)
    unique = stages["exact dedup"](spark, some, DIR)
    assert unique.columns == docs.columns and unique.count() <= 300
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    firsts = {i for i, _, c in plain_components(rows) if i == c}
    assert {str(r["doc_id"]) for r in stages["n-gram Jaccard join"](spark, some, DIR).collect()} == firsts
    mixed = stages["mixing sources to target weights"](spark, some, DIR)
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = stages["best-fit packing"](spark, some, DIR)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == 300
