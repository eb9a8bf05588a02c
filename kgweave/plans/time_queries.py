"""As-of joins, windows over time, sessions and latest state over events; batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tabular
from ..streaming import state
from .catalogue import query, table


@query("""WITH v AS (SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'view') WHERE k = 1)
SELECT p.event_id, p.ts, v.ts AS asof_ts, v.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark, d):
    e = table(spark, d, "events")
    left, right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").select("user_id", "ts", "event_id")
    return tabular.asof_join(left, right, ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "ts", "asof_ts", "asof_event_id")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session""")
def islands_sessions(spark, d):
    s = tabular.sessions(table(spark, d, "events"), ["user_id"], "ts", 1800, ["event_id"])
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return state.windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"]).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i AS start FROM events, range(0, 2) r(i)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL""")
def sliding_window(spark, d):
    return state.windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"], slide="30 minutes").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def late_dedup(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return tabular.keep_one(e, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) FILTER (WHERE value > 50) AS progress, max(ts) AS updated_at FROM events GROUP BY user_id""")
def stateful_snapshot(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), F.when(F.col("value") > 50, F.col("value")).alias("progress"))
    return state.latest(e, ["user_id"], "at", ["status", "progress"]).select("user_id", "status", "progress", F.col("at.ts").alias("updated_at"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS ms, strftime(ts, '%H:%M:%S') AS clock FROM events WHERE event_type = 'purchase'")
def durations(spark, d):
    t = table(spark, d, "events").where("event_type = 'purchase'")
    return t.select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-01-01").cast("timestamp"))).alias("ms"), F.date_format("ts", "HH:mm:ss").alias("clock"))
