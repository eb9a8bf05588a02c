"""The live stream of tasks through restarts against the batch form of the same."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kgweave.streaming import live, pipelines, state

EVENTS = "task_id string, ts timestamp, seq long, status string, progress int, message string, log string"
START = datetime(2024, 1, 1)


def events(seed=4, n=160):
    r = random.Random(seed)
    rows, ended = [], set()
    for k in range(n):
        task = f"t{r.randint(0, 9)}"
        status = r.choice([None, "running", "running", "running", "pending", "completed" if k > 60 else None])
        progress = r.choice([None, 10, 10, 50])
        rows.append((task, START + timedelta(seconds=5 * k), k, status, progress, r.choice([None, "m", "n"]), f"line {k}" if k % 3 else None))
    rows.append(("last", START + timedelta(days=3), n, "running", None, None, None))  # moves the watermark on
    return rows


def run(spark, tmp_path, parts, since, **kw):
    source = tmp_path / "in"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.json(str(source / f"part{k}"))
        stream = pipelines.source(spark, f"{source}/*", EVENTS)
        # each round is a new query on the old checkpoint, as after a restart
        live.run_live(spark, live.live_tasks(stream, since, **kw), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_stream_through_restarts_equals_batch(spark, tmp_path):
    rows, since = events(), START + timedelta(seconds=300)
    got = run(spark, tmp_path, [rows[:40], rows[40:110], rows[110:]], since, late="1 second").where("kind <> 'alive'")
    batch = spark.createDataFrame(rows, EVENTS)
    fields = ["status", "progress", "message"]
    want = state.state_then_changes(batch.withColumn("at", F.col("seq")), ["task_id"], "at", fields, 60)
    key = lambda r: tuple(map(str, r))
    a = sorted(((r["task_id"], r["kind"] == "full", r["status"], r["progress"], r["message"]) for r in got.collect()), key=key)
    b = sorted(((r["task_id"], r["full"], r["status"], r["progress"], r["message"]) for r in want.collect()), key=key)
    assert a == b and any(x[1] for x in a)


def test_signs_of_life_ring_of_lines_and_forgetting(spark, tmp_path):
    talk = [("t", START + timedelta(milliseconds=k), k, "running" if k == 0 else None, None, None, f"l{k}") for k in range(live.LOG_ROWS + 50)]
    clock = lambda s, k: ("clock", START + timedelta(seconds=s), k, "running", s, None, None)
    parts = [talk + [clock(20, 1)], [clock(60, 2)], [clock(300, 3)], [("t", START + timedelta(seconds=400), 0, None, 5, None, None), clock(401, 4)]]
    got = run(spark, tmp_path, parts, START - timedelta(seconds=1), late="1 second", alive=15, forgotten=100)
    mine = [(r["kind"], r["n_logs"], r["last_log"]) for r in got.where("task_id = 't'").orderBy("ts").collect()]
    changes = [x for x in mine if x[0] == "change"]
    assert changes[0] == ("change", 1, "l0") and changes[1] == ("change", 2, "l1")  # the status goes away: a change; the rest repeat
    alive = [x for x in mine if x[0] == "alive"]
    assert 1 <= len(alive) <= 3 and all(x[1:] == (live.LOG_ROWS, f"l{live.LOG_ROWS + 49}") for x in alive)
    assert changes[-1] == ("change", 0, None)  # forgotten after 100 seconds: it begins anew
