"""Rolling features over prices that are no whole cents: unit prices of line items as they divide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import to_ns
from ..operators import drift, features_core
from ..operators.series import split_series
from . import query
from .core import TR, WINDOW
from .data import BARS_L, WEEK_NS, bars_from_ticks, fixed, roll, sql, table

BARS_F = BARS_L.replace("floor(l_extendedprice / l_quantity * 100.0 + 0.5) AS price", "l_extendedprice / l_quantity / 7.0 AS price")


def bars_f(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), to_ns("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 7.0).alias("price"), F.col("l_quantity").cast("long").alias("size"),
        "l_orderkey", "l_linenumber", "l_partkey")
    return bars_from_ticks(li, WEEK_NS, tie=("l_orderkey", "l_linenumber", "l_partkey", "price", "size"))


@query("e01_vwap_fractional", sql(BARS_F, "f__ta__vwap_20", f"""SELECT symbol, ts, CASE WHEN sum(volume) OVER {roll(20)} > 0
  THEN sum(close * volume) OVER {roll(20)} / sum(volume) OVER {roll(20)} ELSE close END AS f__ta__vwap_20 FROM bars"""))
def vwap(spark, sf):
    f = split_series(bars_f(spark, sf), lookback=20)
    return fixed(features_core.add_vwap(f, {"f__ta__vwap_20": 20}).finish().select("symbol", "ts", "f__ta__vwap_20"))


@query("e03_atr_fractional", sql(BARS_F, "f__vol__atr_14", f"""SELECT symbol, ts, avg(tr) OVER {roll(14)} AS f__vol__atr_14
  FROM (SELECT *, {TR} AS tr FROM bars {WINDOW})"""))
def atr(spark, sf):
    f = split_series(bars_f(spark, sf), lookback=15)
    return fixed(features_core.add_atr(f, {"f__vol__atr_14": 14}).finish().select("symbol", "ts", "f__vol__atr_14"))


@query("p02_rolling_errors_fractional", sql(BARS_F, "rolling_mse rolling_mae", f"""SELECT symbol, ts, avg((open - close) ** 2) OVER {roll(30)} AS rolling_mse,
  avg(abs(open - close)) OVER {roll(30)} AS rolling_mae FROM bars QUALIFY count(*) OVER {roll(30)} >= 30"""))
def rolling(spark, sf):
    f = split_series(bars_f(spark, sf), lookback=30)
    return fixed(drift.rolling_errors(f, "open", "close").select("symbol", "ts", "rolling_mse", "rolling_mae"))
