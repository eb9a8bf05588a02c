"""Sources, sinks and streams over files."""

import json

from pyspark.sql import functions as F

from kgweave.operators.graph import build_document_graph
from kgweave.sources import readers, versioned, writers
from kgweave.streaming import pipelines, state
from tests.test_operators import CLAUSES, clauses

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_page_log_skips_bad_lines_and_keeps_the_last(spark, tmp_path):
    page = lambda n, t: json.dumps({"source": "s", "page_num": n, "md_content": t, "middle_json": {"pdf_info": [{"page_idx": 0, "page_size": [10, 20], "preproc_blocks": [{"type": "title", "bbox": [0, 0, 1, 1], "lines": [{"bbox": [], "spans": [{"content": t}, {"content": "!"}]}]}, {"type": "table", "bbox": [0, 2, 1, 3], "lines": [], "blocks": [{"type": "table_caption", "lines": [{"spans": [{"content": "cap"}]}]}, {"type": "table_body", "lines": [{"spans": [{"html": "<t/>"}]}]}]}]}]}})
    (tmp_path / "log.jsonl").write_text("\n".join([page(2, "two"), "{broken", "", page(1, "old"), page(1, "one")]))
    pages = readers.parsed_pages(spark, str(tmp_path))
    assert readers.assembled(pages).first()["text"] == "one\n\ntwo"
    rows = readers.layout_chunks(pages).orderBy("chunk_seq").collect()
    assert [(r["chunk_seq"], r["type"], r["content"], r["page_idx"]) for r in rows] == [(0, "title", "one!", 0), (1, "table", "cap", 0), (2, "title", "two!", 1), (3, "table", "cap", 1)]
    assert rows[1]["table_content"] == "<t/>"


def test_json_records_skip_corrupt_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"project_id": "p", "name": "n", "deleted": False}))
    (tmp_path / "b.json").write_text("{nope")
    assert [r["project_id"] for r in readers.json_records(spark, str(tmp_path), readers.PROJECTS).collect()] == ["p"]


def test_json_array_keeps_order(spark, tmp_path):
    (tmp_path / "chunks.json").write_text(json.dumps([{"content": "b"}, {"content": "a"}]))
    assert [tuple(r) for r in readers.json_array(spark, str(tmp_path / "chunks.json"), "content: STRING").orderBy("chunk_seq").collect()] == [(0, "b"), (1, "a")]


def test_texts_in_unknown_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("泵".encode("gb18030"))
    (tmp_path / "b.md").write_bytes("é".encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in readers.texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "泵", "b.md": "é"}
    assert readers.listing(spark, str(tmp_path)).count() == 1
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert files.where(readers.is_pdf(F.col("content"))).count() == 1
    assert files.where(readers.accepted(F.col("path"))).count() == 1


def test_versioned_table(spark, tmp_path):
    t = versioned.Versioned(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"], {"v": "overwrite"})
    t.delete(F.col("k") == 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [(2, "c"), (3, "d")]


def test_csv_has_no_line_ends(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([(1, "a\nb")], "k int, v string"), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first()["v"] == "a b"


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/event[s].parquet")
    out = state.windowed(stream, "ts", "1 hour", ["event_type"], late="1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("kgweave_windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("kgweave_windows").select("start", "event_type", "n")
    want = state.windowed(events, "ts", "1 hour", ["event_type"]).select(F.col("start").cast("timestamp"), "event_type", "n")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_stream_ingest_is_idempotent(spark, tmp_path):
    clauses(spark).write.json(str(tmp_path / "in"))
    nodes, edges = (versioned.Versioned(spark, f"file://{tmp_path}/{n}") for n in ("nodes", "edges"))
    for k in range(2):  # the second run handles the same files again, under another checkpoint
        stream = pipelines.source(spark, str(tmp_path / "in"), CLAUSES)
        pipelines.ingest_clauses(stream, str(tmp_path / f"cp{k}"), "g", nodes, edges).awaitTermination()
    n, e = build_document_graph(clauses(spark), "g")
    kept = edges._latest()[1]["folders"]
    pipelines.merge_clauses(clauses(spark).limit(1), "g", nodes, edges)
    assert sum(kept.get(b) != f for b, f in edges._latest()[1]["folders"].items()) < len(kept)  # touched buckets only
    assert nodes.read().count() == n.count() and edges.read().count() == e.count()


def test_task_snapshots(spark, tmp_path):
    rows = [("t", "2024-01-01 00:00:00", "running", 10, "m", "l1", None), ("t", "2024-01-01 00:01:00", None, 50, None, "l2", None), ("t", "2024-01-01 00:02:00", "completed", None, None, None, None)]
    spark.createDataFrame(rows, "task_id string, ts string, status string, progress int, message string, log string, error string").write.json(str(tmp_path / "in"))
    stream = pipelines.source(spark, str(tmp_path / "in"), pipelines.EVENTS)
    q = state.task_snapshots(stream).writeStream.outputMode("update").format("memory").queryName("kgweave_tasks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("kgweave_tasks").orderBy(F.desc("updated_at")).first()
    assert (last["status"], last["progress"], last["message"], list(last["logs"])) == ("completed", 50, "m", ["l1", "l2"])


def test_latest_and_changes(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("a", 3, None, 5)], "k string, at int, s string, p int")
    assert [tuple(r) for r in state.latest(df, ["k"], "at", ["s", "p"]).collect()] == [("a", "x", 5, 3)]
    assert [r["at"] for r in state.changes(df, ["k"], "at", ["s", "p"]).orderBy("at").collect()] == [1, 2]
