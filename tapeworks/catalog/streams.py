"""Streaming jobs run to the end of the available input, next to the batch SQL answer.

In append mode a window appears once the watermark (latest event time minus the allowed lateness) passes its
end; the SQL keeps exactly those windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import to_ns
from ..streaming import jobs
from . import query
from .data import fixed, sql, table
from .regimes import hysteresis_sql

COLS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def events(spark, sf):
    """The events table as a stream of files."""
    table(spark, sf, "events")
    e = spark.readStream.schema(COLS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("event_time"), F.upper("event_type").alias("symbol"),
        F.floor(F.col("value") * 100.0 + 0.5).cast("double").alias("price"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("size"), F.col("event_id").alias("seq"))


TK = """tk AS (SELECT upper(event_type) AS symbol, ts, floor(value * 100.0 + 0.5) AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS size, event_id, user_id, value FROM events),
wm AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM tk)"""


def ns(df, *cols):
    """Window bounds as epoch nanoseconds."""
    return fixed(df.withColumns({c: to_ns(c) for c in cols}))


@query("q01_stream_bars", sql(TK, "", """SELECT symbol, epoch_us(b) * 1000 AS start, open, high, low, close, volume FROM (SELECT symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS b, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, CAST(sum(size) AS BIGINT) AS volume FROM tk GROUP BY 1, 2) WHERE b + INTERVAL 30 MINUTE <= (SELECT w FROM wm)"""))
def bars(spark, sf):
    return ns(jobs.run_available(jobs.resample_stream(events(spark, sf))), "start")


@query("q02_sliding_vwap", sql(TK, "vwap", """SELECT symbol, epoch_us(b) * 1000 AS start, volume, pv / nullif(volume, 0) AS vwap FROM (SELECT symbol, b, CAST(sum(size) AS BIGINT) AS volume, sum(price * size) AS pv FROM (
  SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM tk) GROUP BY 1, 2) WHERE b + INTERVAL 2 HOUR <= (SELECT w FROM wm)"""))
def vwap(spark, sf):
    return ns(jobs.run_available(jobs.sliding_vwap(events(spark, sf))), "start")


@query("q03_stream_hysteresis", sql("RECURSIVE " + TK + """,
dec AS (SELECT symbol AS k, epoch_us(ts) * 1000 AS ts, CASE WHEN value > 40 THEN 'STRESS' WHEN value > 20 THEN 'BULL' WHEN value < 3 THEN 'BEAR' ELSE 'SIDEWAYS' END AS rg, CAST(0.6 AS DOUBLE) AS cf,
  row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i FROM tk),
""" + hysteresis_sql(), "confidence", "SELECT k AS symbol, ts, org AS regime, ocf AS confidence, ocn AS persistence_count FROM st WHERE i > 0"))
def hysteresis(spark, sf):
    e = events(spark, sf)
    v = F.col("value")
    regime = F.when(v > 40, "STRESS").when(v > 20, "BULL").when(v < 3, "BEAR").otherwise("SIDEWAYS")
    d = e.select("symbol", to_ns("event_time").alias("ts"), "seq", regime.alias("regime"), F.lit(0.6).alias("confidence"))
    return fixed(jobs.run_available(jobs.hysteresis_stream(d)))


@query("q04_stream_cooldown", sql(TK, "", """SELECT symbol, t AS ts FROM (SELECT symbol, epoch_us(ts) * 1000 AS t, list_reduce(list_concat([0::BIGINT], list(epoch_us(ts) * 1000) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  lambda a, x: CASE WHEN x - a >= 7200000000000 THEN x ELSE a END) AS kept FROM tk WHERE size > 60) WHERE kept = t"""))
def cooldown(spark, sf):
    s = events(spark, sf).where("size > 60").select("symbol", to_ns("event_time").alias("ts"))
    return jobs.run_available(jobs.cooldown_stream(s, 120))


@query("q04_stream_bars_held", sql(TK, "", """SELECT symbol, epoch_us(ts) * 1000 AS ts, CAST(list_reduce(list_concat([0], list(CASE WHEN size > 70 THEN 1 ELSE 0 END + CASE WHEN size < 20 THEN 2 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  lambda h, c: CASE WHEN h > 0 THEN CASE WHEN c >= 2 OR h + 1 >= 6 THEN 0 ELSE h + 1 END WHEN c % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bars_held FROM tk"""))
def held(spark, sf):
    r = events(spark, sf).select("symbol", to_ns("event_time").alias("ts"), "seq", (F.col("size") > 70).alias("enter"), (F.col("size") < 20).alias("leave"))
    return jobs.run_available(jobs.bars_held_stream(r, 6))


@query("q05_stream_monitoring", sql(TK, "avg_latency_ms", """SELECT symbol AS model_id, epoch_us(b) * 1000 AS start, requests, avg_latency_ms, max_latency_ms, avg_latency_ms > 30 AS alert FROM (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*) AS requests,
  avg(value) AS avg_latency_ms, max(value) AS max_latency_ms FROM tk GROUP BY 1, 2) WHERE b + INTERVAL 1 HOUR <= (SELECT w FROM wm)"""))
def monitoring(spark, sf):
    log = events(spark, sf).select(F.col("symbol").alias("model_id"), "event_time", F.col("value").alias("latency_ms"))
    return ns(jobs.run_available(jobs.monitor_stream(log, max_latency=30.0)), "start")


@query("q06_stream_join", sql(TK, "", """SELECT p.user_id AS key, p.event_id AS prediction_id, a.event_id AS actual_id, p.value AS prediction, a.value AS actual FROM tk p JOIN tk a ON p.user_id = a.user_id AND a.ts >= p.ts AND a.ts <= p.ts + INTERVAL 2 HOUR
  WHERE p.symbol = 'VIEW' AND a.symbol = 'PURCHASE'"""))
def joined(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "event_time", "value", "symbol")
    return jobs.run_available(jobs.match_actuals(e.where("symbol = 'VIEW'").drop("symbol"), e.where("symbol = 'PURCHASE'").drop("symbol")))


@query("q07_stream_sessions", sql(TK, "", """SELECT symbol, epoch_us(min(ts)) * 1000 AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) * 1000 AS "end", count(*) AS ticks, CAST(sum(size) AS BIGINT) AS volume FROM (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS g FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM tk)) GROUP BY symbol, g HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT w FROM wm)"""))
def sessions(spark, sf):
    return ns(jobs.run_available(jobs.session_stream(events(spark, sf))), "start", "end")


@query("q08_stream_dedupe", sql(TK, "", "SELECT DISTINCT symbol, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) * 1000 AS ts FROM tk"))
def dedupe(spark, sf):
    e = events(spark, sf).select("symbol", to_ns(F.date_trunc("hour", "event_time")).alias("ts"), "event_time")
    return jobs.run_available(jobs.dedupe_stream(e, ["symbol", "ts"])).select("symbol", "ts")
