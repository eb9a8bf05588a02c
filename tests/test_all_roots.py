"""Queries over all roots against brute force in plain Python."""

from collections import defaultdict

import pyarrow.parquet as pq

from kgweave.plans import catalogue

DIR = "/root/testdata/sf0.001"


def read(name, *columns):
    t = pq.read_table(f"{DIR}/{name}.parquet", columns=list(columns))
    return list(zip(*[t[c].to_pylist() for c in columns]))


def found(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalogue.QUERIES[name](spark, DIR).collect())


def test_topics_and_two_hops(spark):
    items, orders = read("lineitem", "l_suppkey", "l_partkey", "l_orderkey"), {o for (o,) in read("orders", "o_orderkey")}
    suppliers = {s for (s,) in read("supplier", "s_suppkey")}
    assert found(spark, "topic_entities_distinct", "topic", "entity") == sorted({(s, p) for s, p, _ in items if s in suppliers})
    paths = defaultdict(set)
    for s, p, o in items:
        if o in orders:
            paths[p].add((s, o))
    want = sorted((p, len({s for s, _ in paths[p]}), len(paths[p])) for (p,) in read("part", "p_partkey"))
    assert found(spark, "path_two_hop", "root", "n_topics", "n_clauses") == want


def test_traversal(spark):
    hop = defaultdict(set)
    for table, a, b, near, far in (("orders", "o_orderkey", "o_custkey", "order", "customer"), ("lineitem", "l_orderkey", "l_partkey", "order", "part"), ("customer", "c_custkey", "c_nationkey", "customer", "nation"), ("nation", "n_nationkey", "n_regionkey", "nation", "region")):
        for x, y in read(table, a, b):
            hop[f"{near}:{x}"].add(f"{far}:{y}")
    want = []
    for (o,) in set(read("orders", "o_orderkey")):
        seen, front = {f"order:{o}"}, {f"order:{o}"}
        for k in (1, 2, 3):
            front = {y for x in front for y in hop[x]} - seen
            seen |= front
            want += [(f"order:{o}", y, k) for y in front]
    assert found(spark, "bounded_traversal", "root", "node", "hops") == sorted(want)


def test_path_search(spark):
    facts = {o: "".join(c for c in f"{p} {c}" if c.isascii() and (c.isalnum() or c == "_")).lower() for o, p, c in read("orders", "o_orderkey", "o_orderpriority", "o_custkey")}
    best = {}
    for p, s, o in set(read("lineitem", "l_partkey", "l_suppkey", "l_orderkey")):
        if o in facts:
            best[facts[o]] = min(best.get(facts[o], (9,)), (p % 2, p, s, o))
    count = defaultdict(int)
    for t, p, _, _ in best.values():
        count[t, p] += 1
    want = [p for t in (0, 1) for _, p in sorted((-n, p) for (u, p), n in count.items() if u == t)[:10]]
    assert sorted(r[0] for r in found(spark, "batch_path_search", "root")) == sorted(want)
