"""Findings of the reviewer's third round on growth: each test fails on the code before."""

import random

from pyspark.sql import functions as F

from kgweave.operators import traversal

EDGES = "uuid string, src string, dst string, rel string, fact string"


def _graph(spark, seed):
    r = random.Random(seed)
    name = lambda: f"n{r.randint(0, 25)}"
    edges = [(f"e{r.randint(0, 99):02}" if k % 17 else None, name(), name(), r.choice(["MENTIONS", "OWNS", "", None]), r.choice(["Fact a", "fact A!", "b", "", None])) for k in range(60)]
    edges += [("lost", "n1", None, "OWNS", None), ("lost", None, "n2", "OWNS", "x")]
    roots = [(f"n{k}", ord_) for k, ord_ in zip(r.sample(range(26), 9), r.sample(range(100), 9), strict=True)] + [("nowhere", -1)]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, "root string, ord int").withColumn("score", F.col("ord") / 7)


def test_facts_of_first_edges_are_those_of_all(spark, tmp_path):
    """an edge has at most three rows, whatever number of roots meets it, and the facts are the same."""
    nodes = spark.createDataFrame([(f"n{k}", f"N {k % 20}", f"s{k}", f"d{k}" if k % 3 else None, k, None) for k in range(0, 26, 2)], "uuid string, name string, summary string, source string, page int, boxes array<array<double>>")
    for seed, depth in ((1, 2), (2, 1), (3, 3), (4, 0)):
        edges, roots = _graph(spark, seed)
        _, met = traversal.from_roots(traversal.Adjacency(spark, f"file://{tmp_path}/{seed}").build(edges), roots, depth)
        few = traversal.first_edges(edges, roots, depth)
        assert few.groupBy("src", "dst", "rel", "fact").count().agg(F.max("count")).first()[0] <= 3
        for only in (None, ["OWNS"]):
            want, got = (sorted(traversal.facts(e, nodes, roots, only).collect(), key=str) for e in (met, few))
            assert want and got == want


def test_nodes_are_found_without_edges(spark, tmp_path):
    """equal hops are stored once, and nodes are those of the whole search."""
    edges, roots = _graph(spark, 5)
    edges = edges.union(edges.where("dst IS NOT NULL"))
    whole = traversal.Adjacency(spark, f"file://{tmp_path}/whole").build(edges)
    bare = traversal.Adjacency(spark, f"file://{tmp_path}/bare").build(traversal.hops_of(edges), ("out",))
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().count()
    assert spark.read.parquet(f"{bare.path}/out").select(F.explode("edges")).count() == pairs
    for depth in (0, 2, 3):
        want, _ = traversal.from_roots(whole, roots, depth)
        assert sorted(traversal.nodes_from_roots(bare, roots, depth).collect()) == sorted(want.collect())


def test_sentences_are_chunked_in_batches(spark):
    """sentences of a null key stay, keys that go over batches are chunked whole, and vectors are shuffled once."""
    from pyspark.sql import Window as W

    from kgweave.functions.vectors import cosine
    from kgweave.operators import chunking

    r = random.Random(10)
    rows = [(k, i, "x" * r.randint(0, 60), None if r.random() < 0.05 else [r.choice([0.0, r.random()]) for _ in range(r.choice([3, 3, 3, 2, 0]))]) for k in (None, "a", "b", "c") for i in range({"b": 1, "c": 40}.get(k, 15))]
    df = spark.createDataFrame(rows, "key string, at int, text string, v array<float>")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        found = chunking.semantic_chunks(df, ["key"], "at", "text", "v", 50)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        got = {(x["key"], x["at"]): (x["likeness"], x["bound"], x["chars"], x["chunk"]) for x in found.collect()}
    finally:
        spark.conf.set(size, before)
    assert len(got) == len(rows)
    w = W.partitionBy("key").orderBy("at")
    like = df.withColumn("like", F.when(F.row_number().over(w) > 1, cosine(F.lag("v").over(w), F.col("v")))).withColumn("bound", F.percentile("like", F.lit(0.2)).over(W.partitionBy("key")))
    groups = {}
    for x in like.orderBy("at").collect():
        chunk, total = groups.get(x["key"], (0, 0))
        n = len(x["text"])
        if x["at"] and ((x["like"] < x["bound"] and total > 40) or total + n > 100):
            chunk, total = chunk + 1, 0
        groups[x["key"]] = chunk, total + n
        assert got[x["key"], x["at"]] == (x["like"], x["bound"], n, chunk)


def test_trigrams_are_hashed_once(monkeypatch):
    """equal trigrams aren't hashed again, and pieces of any length give the same vectors."""
    import hashlib

    from kgweave import plugins

    texts, calls, real = ["abcabc " * 300, "", None, " cab", "É😀x"], [], hashlib.blake2b
    monkeypatch.setattr(plugins.hashlib, "blake2b", lambda *a, **k: calls.append(a) or real(*a, **k))
    want = plugins.hashed_embedding(texts)
    assert len(calls) < 20
    monkeypatch.setattr(plugins, "PIECE", 5)
    assert plugins.hashed_embedding(texts) == want and want[1] == [0.0] * 64 and abs(sum(x * x for x in want[4]) - 1) < 1e-12


def test_reach_from_many_roots(spark):
    """An edge without a target leads nowhere, and what nodes share is put together for each root."""
    from kgweave.operators import graph

    r = random.Random(11)
    edges = [(r.randint(0, 30), r.randint(0, 30)) for _ in range(60)] + [(3, None), (None, 4)]
    starts = [*range(0, 31, 2), 4, 99]
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in starts], "root long")
    for depth, either in ((0, False), (1, True), (2, True), (3, False), (4, False)):
        want = set()
        for root in starts:
            seen = front = {root}
            for k in range(1, depth + 1):
                met = {b for a, b in edges if a in front} | ({a for a, b in edges if b in front} if either and k == 1 else set())
                front = met - seen - {None}
                seen = seen | front
                want |= {(root, n, k) for n in front}
        got = [tuple(x) for x in graph.reach(e, s, depth, either).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_layout_log_is_compressed(spark, tmp_path, monkeypatch):
    """the page log of layout_rows is written compressed."""
    from kgweave.plans import catalogue, stored_queries

    monkeypatch.setattr(stored_queries, "shared_path", lambda spark, tag: f"file://{tmp_path}/{tag}")
    catalogue.QUERIES["layout_rows"](spark, "/root/testdata/sf0.001")
    files = list(tmp_path.glob("layout/part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
