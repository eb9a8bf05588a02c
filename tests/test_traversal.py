"""Search from roots along stored adjacency lists against a plain breadth-first walk."""

import random

import pytest
from pyspark.sql import functions as F

from kgweave.operators import traversal

EDGES = "uuid string, src string, dst string, rel string, fact string"


def walk(edges, root, depth):
    hops, front, met = {root: 0}, [root], {}
    for k in range(depth + 1):
        for e in edges:
            if e[1] is not None and e[2] is not None and (e[1] in front or (k == 0 and e[2] == root)):
                met.setdefault(e, k)
        new = {e[2] for e in edges if e[1] in front and e[2] is not None} - set(hops)
        if k < depth:
            hops |= {n: k + 1 for n in new}
        front = new
    return hops, met


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_walks(spark, tmp_path, monkeypatch, depth):
    monkeypatch.setattr(traversal, "PIECE", 4)  # the hub has many lists
    r = random.Random(depth)
    name = lambda: f"n{r.randint(0, 30)}"
    edges = [(f"e{k}", name(), name(), "R", None) for k in range(40)] + [(f"h{k}", "n0", name(), "R", "f") for k in range(40)] + [("loop", "n3", "n3", None, None), ("lost", "n1", None, "R", None), ("e0", None, "n2", "R", None)]
    df = spark.createDataFrame(edges, EDGES)
    graph = traversal.Adjacency(spark, f"file://{tmp_path}/g").build(df)
    roots = spark.createDataFrame([("n0",), ("n3",), ("n3",), ("n7",), ("nowhere",)], "root string")
    nodes, met = traversal.from_roots(graph, roots, depth)
    got, got_edges = {}, {}
    for x in nodes.collect():
        assert (x["root"], x["node"]) not in got
        got[x["root"], x["node"]] = x["hops"]
    for x in met.collect():
        got_edges[x["root"], (x["uuid"], x["src"], x["dst"], x["rel"], x["fact"])] = x["hops"]
    want, want_edges = {}, {}
    for root in ("n0", "n3", "n7", "nowhere"):
        h, m = walk(edges, root, depth)
        want |= {(root, n): k for n, k in h.items()}
        want_edges |= {(root, e): k for e, k in m.items()}
    assert got == want and got_edges == want_edges
    lists = spark.read.parquet(f"{graph.path}/out").where("node = 'n0'").select(F.size("edges").alias("n")).collect()
    assert len(lists) > 5 and sum(x["n"] for x in lists) >= 40


def test_a_round_reads_its_nodes_folders(spark, tmp_path):
    df = spark.createDataFrame([(f"e{k}", f"n{k}", f"n{k + 1}", "R", None) for k in range(200)], EDGES)
    graph = traversal.Adjacency(spark, f"file://{tmp_path}/g").build(df)
    front = spark.createDataFrame([("r", "n5", 0)], "root string, node string, hops int")
    found = graph.around(front)
    assert [x["other"] for x in found.collect()] == ["n6"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_facts_are_told_once(spark):
    edges = spark.createDataFrame([("a", "e1", "x", "y", "R", "Same fact!", 0), ("b", "e2", "x", "z", "R", "same FACT", 0), ("a", "e3", "a", "t", "MENTIONS", None, 0), ("a", "e4", "t", "a", "MENTIONS", "", 0), ("a", "e5", "a", "u", "", None, 0), ("a", "e6", "a", "u", "OWNS", None, 1)], "root string, uuid string, src string, dst string, rel string, fact string, hops int")
    nodes = spark.createDataFrame([("t", "Topic", "sum", None, 4, []), ("u", "U", None, "doc", None, [[7.0, 1.0, 2.0, 3.0, 4.0]]), ("a", "A", "s", "root doc", 2, None)], "uuid string, name string, summary string, source string, page int, boxes array<array<double>>")
    roots = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.9)], "root string, ord int, score double")
    got = {x["text"]: (x["root"], x["uuid"], x["source"], x["page"], x["box"], x["original"]) for x in traversal.facts(edges, nodes, roots).collect()}
    assert got == {
        "Same fact!": ("a", "e1", "root doc", 2, None, ""), "提及: Topic": ("a", "e3", "root doc", 4, None, "sum"), "[OWNS] U": ("a", "e6", "doc", 7, [1.0, 2.0, 3.0, 4.0], ""),
    }
    assert {x["text"] for x in traversal.facts(edges, nodes, roots, ["OWNS"]).collect()} == {"Same fact!", "[OWNS] U"}
