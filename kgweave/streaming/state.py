"""State over time: windows, latest snapshots by field, eviction; the same expressions batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, keys: list[str], slide: str | None = None, late: str | None = None, value: str = "value") -> DataFrame:
    """start, keys, n and total per window; with `late` a watermark (streams need a zoned timestamp)."""
    if late:
        df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def latest(df: DataFrame, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """The last value of each field that isn't null, by time: an update that leaves a field out keeps it."""
    return df.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(at))).alias(f) for f in fields], F.max(at).alias(at))


def evict(df: DataFrame, status: str, updated: str, now, hours: int, final: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """Without rows in a final status that were last changed over so many hours ago."""
    old = F.col(updated) < now - F.make_interval(hours=F.lit(hours))
    return df.where(~(F.col(status).isin(*final) & old))


def changes(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Rows that differ from their key's row before in any field."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_mark", F.xxhash64(*fields)).withColumn("_before", F.lag("_mark").over(w))
    return marked.where(~F.col("_before").eqNullSafe(F.col("_mark"))).drop("_mark", "_before")


SNAPSHOT = "task_id string, status string, progress int, message string, logs array<string>, updated_at timestamp"
_STATE = "status string, progress int, message string, logs array<string>, updated_at timestamp"
LOG_ROWS = 1000


def task_snapshots(events: DataFrame, hours: int = 24) -> DataFrame:
    """Streaming snapshots of tasks (task_id, ts, status, progress, message, log): null fields keep what was
    there, the last LOG_ROWS log lines stay, and a task without news for so many hours of watermark goes."""
    import pandas as pd

    def update(key: tuple, batches: Iterator, state) -> Iterator:
        if state.hasTimedOut:
            state.remove()
            return
        status, progress, message, logs, at = state.get if state.exists else (None, None, None, [], None)
        logs = list(logs or [])
        rows = pd.concat(list(batches)).sort_values("ts")
        for r in rows.itertuples():
            status = status if r.status is None else r.status
            progress = progress if pd.isna(r.progress) else int(r.progress)
            message = message if r.message is None else r.message
            if r.log is not None:
                logs = [*logs, r.log][-LOG_ROWS:]
            at = r.ts if at is None or r.ts > at else at
        state.update((status, progress, message, logs, at))
        state.setTimeoutTimestamp(max(int(at.timestamp() * 1000) + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "progress": pd.array([progress], dtype="Int32"), "message": [message], "logs": [logs], "updated_at": [at]})

    return events.withWatermark("ts", "10 minutes").groupBy("task_id").applyInPandasWithState(update, SNAPSHOT, _STATE, "update", "EventTimeTimeout")


def resume_windows(chunks: DataFrame, order: str, size: int = 12, most: int = 150, done: int = -1) -> DataFrame:
    """Chunks of the discovery windows that are left: `size` neighbours each, of the first `most` chunks of a source (the
    feature is a look at a document's beginning), after window number `done`."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("source").orderBy(order)) - 1
    rows = chunks.withColumn("_place", place).where(F.col("_place") < most)
    return rows.withColumn("window", F.floor(F.col("_place") / size)).where(F.col("window") > done).drop("_place")


#: Pipelines that run at once.
RUNNING = 2


def next_runs(pipelines: DataFrame, at_once: int = RUNNING) -> DataFrame:
    """pipeline_id of the waiting pipelines that may start now, first come first served: as many as at_once leaves.

    pipelines: pipeline_id, status (pending, running or a final one), created_at. The queue is the status table itself,
    so a restart finds it as it was."""
    from pyspark.sql import Window as W

    waiting = pipelines.where("status = 'pending'").select("pipeline_id", "created_at").orderBy("created_at", "pipeline_id").limit(at_once)
    waiting = waiting.withColumn("_place", F.row_number().over(W.orderBy("created_at", "pipeline_id")))  # at_once rows
    free = pipelines.agg((F.lit(at_once) - F.count_if(F.col("status") == "running")).alias("_free"))  # one row
    return waiting.crossJoin(F.broadcast(free)).where("_place <= _free").select("pipeline_id")


def recovered(pipelines: DataFrame) -> DataFrame:
    """The status table after a restart: what ran when it stopped waits again; stages that were completed stay so."""
    reset = F.transform("stages", lambda s: F.when(s["status"].endswith("processing"), s.withField("status", F.lit("pending"))).otherwise(s))
    return pipelines.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status"))).withColumn("stages", reset)


def left_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose keys aren't among the finished ones: what a rerun from a checkpoint still has to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def state_then_changes(events: DataFrame, keys: list[str], order: str, fields: list[str], since) -> DataFrame:
    """What a subscriber that comes at a time is told: each key's latest state then, marked full, and after it each row
    that changes something, in order; a key's rows end with its first final status."""
    from pyspark.sql import Window as W

    first = latest(events.where(F.col(order) <= since), keys, order, fields).withColumn("full", F.lit(True))
    after = changes(events, keys, order, fields).where(F.col(order) > since).select(*keys, *fields, order).withColumn("full", F.lit(False))
    rows = first.select(*keys, *fields, order, "full").unionByName(after)
    over = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("status").isin("completed", "failed").cast("int")).over(over), F.lit(0))
    return rows.withColumn("_ended", ended).where("_ended = 0").drop("_ended")
