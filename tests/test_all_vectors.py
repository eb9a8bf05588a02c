"""Searches with all query vectors against brute force and the searches with one."""

import numpy as np
import pyarrow.parquet as pq

from kgweave.operators import search
from kgweave.plans import catalogue

DIR = "/root/testdata/sf0.001"


def rows(spark, name, *columns, query=None):
    got = catalogue.QUERIES[name](spark, DIR)
    return sorted(tuple(r[c] for c in columns) for r in (got if query is None else got.where(f"query = {query}")).collect())


def test_every_query_vector_is_scored(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query int, q array<double>")
    assert sorted((r["query"], r["id"], r["score"]) for r in search.vector_scores(df, "v", q).collect()) == [(7, 1, 1.0), (7, 2, 0.0), (8, 1, 0.0), (8, 2, 1.0)]


def test_all_queries(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet").sort_by("vec_id")
    ids, v = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = []
    for i in (i for i, k in enumerate(ids) if k % 100 == 0):
        score = np.round(v @ v[i], 9)
        want += [(ids[i], ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))[:10]]
    assert len({q for q, _ in want}) > 1 and rows(spark, "vector_topk", "query", "vec_id") == sorted(want)
    for name in ("vector_threshold", "vector_topk_by_label", "hybrid_topk", "hybrid_boost"):
        assert {q for (q,) in rows(spark, name, "query")} == {q for q, _ in want}
