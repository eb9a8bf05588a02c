"""What the third round's findings showed: equal texts in great numbers, epochs, shared bodies, exact candidates."""


import pandas as pd
from pyspark.sql import functions as F

from kgweave.operators import linking
from kgweave.streaming import live


def test_a_task_tells_many_changes_in_one_frame():
    class State:
        value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, v):
            self.value = v

        put = update

    class Handle:
        def listTimers(self):  # noqa: N802
            return []

        def registerTimer(self, at):  # noqa: N802
            pass

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    task = live._Task(0, 15, 100)
    task.handle, task.value, task.logs = Handle(), State(), State()
    n = 500
    rows = pd.DataFrame({"ts": pd.to_datetime(range(1, n + 1), unit="s"), "seq": range(n), "status": [f"s{k}" for k in range(n)], "progress": [None] * n, "message": [None] * n, "log": [f"l{k}" for k in range(n)]})
    frames = list(task.handleInputRows(("t",), iter([rows.iloc[250:], rows.iloc[:250]]), Times()))
    assert len(frames) == 1 and list(frames[0]["status"]) == [f"s{k}" for k in range(n)] and list(frames[0]["n_logs"]) == list(range(1, n + 1))


def test_first_event_of_all_is_told(spark, tmp_path):
    from kgweave.plans import catalogue

    spark.createDataFrame([(0, 7, "error"), (997, 7, "view")], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["live_events"](spark, str(tmp_path)).collect()
    assert sorted((r["event_id"], r["kind"], r["status"]) for r in got) == [(0, "full", "error"), (997, "change", "view")]


def test_positions_of_equal_texts_meet_once(spark):
    n = 5000  # 25 million pairs of rows, one pair of texts
    clauses = spark.range(n).select(F.concat(F.lit("x"), "id").alias("clause_id"), F.lit("of HIGH").alias("content"))
    chunks = spark.range(n).select((F.col("id") + 3).alias("chunk_seq"), F.lit("text of HIGH see").alias("content"))
    seen = []
    contains = F.contains
    linking.F.contains = lambda *a: F.when(F.assert_true(F.monotonically_increasing_id() % (1 << 33) < 100).isNull(), contains(*a))
    try:
        seen = linking.resolve_positions(clauses, chunks).collect()
    finally:
        linking.F.contains = contains
    assert len(seen) == n and {(r["chunk_seq"], r["tier"]) for r in seen} == {(3, 2)}


def test_clauses_of_one_number_take_digests(spark):
    from kgweave.operators import segmentation

    n = 400
    rows = [("d", 0, "title", "1 Start")] + [("d", k, "text", "A.0.1 head\nline %d" % k) for k in range(1, n)] + [("d", n, "title", "2 End"), ("d", n + 1, "text", "words"), ("d", n + 2, "text", "more")]
    df = spark.createDataFrame(rows, "source string, chunk_seq long, type string, content string")
    df = df.withColumns({"chunk_id": F.concat(F.lit("c"), "chunk_seq"), "page_idx": (F.col("chunk_seq") % 3).cast("int"), "bbox": F.array(*[F.lit(float(k)) for k in range(4)])})
    placed = segmentation.blocks(df, spark.createDataFrame([("d", 1, 2, False)], "source string, chapter_depth int, container_depth int, title_mode boolean"))
    whole = segmentation.clauses(placed).select("seq", F.md5("content").alias("content"), F.size("chunks").alias("chunks"), F.size("boxes").alias("boxes"), "requirement")
    short = segmentation.clauses(placed, told=F.md5, counts=True).select("seq", "content", "chunks", "boxes", "requirement")
    assert sorted(short.collect()) == sorted(whole.collect()) and short.count() == n
    body = "\n".join(["A.0.1 head\nline 1"] + [f"line {k}" for k in range(2, n)])
    assert segmentation.clauses(placed).where("seq = 7").first()["content"] == body


def test_pages_of_a_number_that_begins_a_chunk(spark, tmp_path):
    from kgweave.plans import catalogue
    from tests.oracle import same

    rows = [(15, 2, "HIGH"), (18, 1, "HIGH"), (29, 1, "LOW")]  # 3.2.1 at the head of the first, named in the second and third
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["backfilled_pages"](spark, str(tmp_path)).toPandas()
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    same(got, con.execute(catalogue.SQL["backfilled_pages"]).fetch_df())
    assert got["page"].tolist() == [15] and got["n_boxes"].tolist() == [3]


def test_candidates_that_codes_cannot_tell_apart(spark, tmp_path):
    import numpy as np

    from kgweave.operators.vector_index import VectorIndex

    r = np.random.default_rng(3)
    near = np.eye(8)[0] + r.normal(0, 1e-3, (400, 8))
    vectors = np.concatenate([near, -np.eye(8)])  # far ones make the codes of the cell coarse
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "key long, vector array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/index").build(df, "key", "vector", cells=1)
    query = np.eye(8)[0] + 0.3 * np.eye(8)[1]
    got = index.search(spark.createDataFrame([(1, query.tolist())], "q long, vector array<double>"), "q", "vector", 5, probes=index.about()["cells"])
    scores = np.round(vectors @ query / np.linalg.norm(vectors, axis=1) / np.linalg.norm(query), 9)
    assert {x["key"] for x in got.collect()} == set(sorted(range(len(vectors)), key=lambda k: (-scores[k], k))[:5])
