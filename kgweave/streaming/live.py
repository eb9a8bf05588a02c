"""A live stream of tasks for those who subscribe: the state as it was when they came, then what changes.

Each task is a stateful processor with three kinds of state: a value (what its fields are and what was told), a list
(its last lines of log) and timers. The full state goes out once the time of subscription has passed, by the task's
next event or by a timer; then each event that changes something goes out; a timer sends a sign of life where nothing
comes; after a final status nothing goes out, and what wasn't heard of for the time to live is forgotten. The state is
in the checkpoint, so a restart goes on where it stopped."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Final statuses and lines of log that a task keeps.
FINAL, LOG_ROWS = ("completed", "failed"), 1000
#: Rows that a task tells at once: what comes out is made by columns, not row by row.
TOLD_ROWS = 10_000
#: Seconds after which a sign of life goes out, and after which a task is forgotten.
ALIVE, FORGOTTEN = 15, 24 * 3600
LIVE = "task_id string, kind string, ts timestamp, status string, progress int, message string, n_logs int, last_log string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VALUE = T.StructType([T.StructField(n, k) for n, k in (("status", T.StringType()), ("progress", T.IntegerType()), ("message", T.StringType()), ("at", T.LongType()), ("raw_status", T.StringType()), ("raw_progress", T.IntegerType()), ("raw_message", T.StringType()), ("heard", T.BooleanType()), ("told", T.BooleanType()), ("ended", T.BooleanType()))])


def _millis(at: datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


class _Task(StatefulProcessor):
    def __init__(self, since: int, alive: int, forgotten: int):
        self.since, self.alive, self.forgotten = since, alive * 1000, forgotten * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fields", _VALUE)
        self.logs = handle.getListState("logs", T.StructType([T.StructField("line", T.StringType())]))

    def _frame(self, key, told: list[tuple]):
        """Rows to tell of a task: (kind, at, (status, progress, message), lines of log, the last)."""
        import pandas as pd

        kinds, at, fields, n, last = zip(*told, strict=True)
        status, progress, message = zip(*fields, strict=True)
        return pd.DataFrame({"task_id": [key[0]] * len(told), "kind": kinds, "ts": pd.to_datetime(at, unit="ms"), "status": status, "progress": pd.array(progress, dtype="Int32"), "message": message, "n_logs": pd.array(n, dtype="Int32"), "last_log": last})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802
        import numpy as np
        import pandas as pd

        batch = pd.concat(list(rows))
        at_us, seq = batch["ts"].to_numpy().astype("datetime64[us]").astype("i8"), batch["seq"].to_numpy()
        order = np.lexsort((seq, at_us))

        def column(name: str) -> list:
            values = batch[name].to_numpy(dtype=object)[order]
            values[pd.isna(values)] = None
            return values.tolist()

        known = self.value.get()
        status, progress, message, at, raw_status, raw_progress, raw_message, heard, told, ended = known or (None, None, None, None, None, None, None, False, False, False)
        logs = deque((r[0] for r in self.logs.get()) if known and self.logs.exists() else (), maxlen=LOG_ROWS)
        out: list[tuple] = []
        tell = lambda kind, at, fields: out.append((kind, at, fields, len(logs), logs[-1] if logs else None))
        said = False
        for now, new_status, new_progress, new_message, line in zip((at_us[order] // 1000).tolist(), *map(column, ("status", "progress", "message", "log")), strict=True):
            raw = (new_status, None if new_progress is None else int(new_progress), new_message)
            if now > self.since and not told:
                told = True
                if heard and not ended:
                    tell("full", at, (status, progress, message))
                    ended = status in FINAL
            changed = not heard or raw != (raw_status, raw_progress, raw_message)
            raw_status, raw_progress, raw_message = raw
            status, progress, message = (new if new is not None else old for new, old in zip(raw, (status, progress, message), strict=True))
            if line is not None:
                logs.append(line)
                said = True
            heard, at = True, now
            if now > self.since and changed and not ended:
                tell("change", now, raw)
                ended = raw[0] in FINAL
            if len(out) == TOLD_ROWS:
                yield self._frame(key, out)
                out.clear()
        if out:
            yield self._frame(key, out)
        self.value.update((status, progress, message, at, raw_status, raw_progress, raw_message, heard, told, ended))
        if said:
            self.logs.put([(line,) for line in logs])
        self._wake(at, timerValues.getCurrentWatermarkInMs(), told, ended, bool(known))

    def _wake(self, at: int, watermark: int, told: bool, ended: bool, known: bool = True) -> None:
        """One timer: for the full state, the next sign of life, or the end. A task that wasn't known has none yet."""
        for timer in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(timer)
        when = self.since if not told else at + self.forgotten if ended else min(max(at, watermark) + self.alive, at + self.forgotten)
        self.handle.registerTimer(max(when, watermark + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802
        status, progress, message, at, *raw, heard, told, ended = self.value.get()
        logs = [r[0] for r in self.logs.get()] if self.logs.exists() else []
        watermark = timerValues.getCurrentWatermarkInMs()
        if not told:
            told = True
            yield self._frame(key, [("full", at, (status, progress, message), len(logs), logs[-1] if logs else None)])
            ended = status in FINAL
        elif watermark >= at + self.forgotten:
            self.value.clear()
            self.logs.clear()
            return
        elif not ended:
            yield self._frame(key, [("alive", watermark, (None, None, None), len(logs), logs[-1] if logs else None)])
        self.value.update((status, progress, message, at, *raw, heard, told, ended))
        self._wake(at, watermark, told, ended)


def live_tasks(events: DataFrame, since: datetime, late: str = "10 seconds", alive: int = ALIVE, forgotten: int = FORGOTTEN) -> DataFrame:
    """LIVE rows of a stream of events (task_id, ts, seq, status, progress, message, log) for who subscribed at `since`.

    kind: full (the task's state then, fields that events left out kept), change (an event that differs from the task's
    one before it) or alive. Events of one task at one time go by seq; events later than the watermark are lost."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers of a local session don't find this package
    columns = events.select("task_id", "ts", "seq", "status", "progress", "message", "log")
    return columns.withWatermark("ts", late).groupBy("task_id").transformWithStateInPandas(_Task(_millis(since), alive, forgotten), LIVE, "Append", "EventTime")


def run_live(spark: SparkSession, out: DataFrame, path: str, checkpoint: str):
    """Handles what is there now and appends it to a Parquet table; a rerun goes on from the checkpoint. Timers and lists
    need the state store that keeps them on disk, which this session then uses."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
