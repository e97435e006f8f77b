"""Anchored volume-weighted prices.

Everything here restarts each local session, so windows are per (symbol, session date): one day of one
symbol is the largest partition, whatever the length of the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathcols import div, flag
from ..functions.timecols import FIRST_HOUR_END, MARKET_TZ, MINUTE_NS, PREMARKET_OPEN, SESSION_OPEN, market_time, to_ns


def session_anchors(bars: DataFrame) -> DataFrame:
    """Local session date and the ns of 09:30, 04:00 and 10:30, counted from local midnight."""
    df = bars.withColumn("_mt", market_time("ts"))
    df = df.withColumns({"session_date": F.to_date("_mt"), "_mid": to_ns(F.to_utc_timestamp(F.date_trunc("day", "_mt"), MARKET_TZ))})
    at = lambda minute: F.col("_mid") + F.lit(minute * MINUTE_NS).cast("long")
    return df.withColumns({
        "session_start_ns": at(SESSION_OPEN), "premarket_start_ns": at(PREMARKET_OPEN), "first_hour_ns": at(FIRST_HOUR_END),
    }).drop("_mt", "_mid")


def _session():
    return Window.partitionBy("symbol", "session_date").orderBy("ts")


def _cum(x: Column) -> Column:
    return F.sum(x).over(_session().rowsBetween(Window.unboundedPreceding, 0))


def _hold(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(_session().rowsBetween(Window.unboundedPreceding, 0))


def prior_session_extremes(bars: DataFrame) -> DataFrame:
    """High and low of the symbol's previous session, one row per (symbol, session)."""
    daily = bars.groupBy("symbol", "session_date").agg(F.max("high").alias("_dh"), F.min("low").alias("_dl"))
    w = Window.partitionBy("symbol").orderBy("session_date")
    return daily.select("symbol", "session_date", F.lag("_dh").over(w).alias("_ph"), F.lag("_dl").over(w).alias("_pl"))


def avwap_pack(bars: DataFrame) -> DataFrame:
    """Session, premarket, first-hour and previous-extreme anchored prices."""
    pv, vol, ts = F.col("close") * F.col("volume"), F.col("volume"), F.col("ts")
    df = session_anchors(bars)
    df = df.join(prior_session_extremes(df), ["symbol", "session_date"], "left")
    pre = ts < F.col("session_start_ns")
    hour1 = (ts >= F.col("session_start_ns")) & (ts <= F.col("first_hour_ns"))
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol", "session_date"))
    df = df.withColumns(
        {
            "_i": F.row_number().over(_session()) - 1,
            "_n": size,
            "_cpv": _cum(pv), "_cv": _cum(vol),
            "_ppv": _cum(F.when(pre, pv)), "_pv": _cum(F.when(pre, vol)),
            "_hpv": _cum(F.when(hour1, pv)), "_hv": _cum(F.when(hour1, vol)),
        }
    )
    # A touch starts a new anchor whose price is the touching bar's close, held for the rest of the
    # session.  The first session has no previous extreme and anchors at its fifth bar.
    waited = F.col("_i") >= F.least(F.lit(6), F.col("_n") - 1)
    opening = F.col("_i") == F.least(F.lit(4), F.col("_n") - 1)
    at_high = flag((F.col("high") >= F.col("_ph")) & waited) | (F.col("_ph").isNull() & opening)
    at_low = flag((F.col("low") <= F.col("_pl")) & waited) | (F.col("_pl").isNull() & opening)
    premarket = F.when(pre & (F.col("_pv") > 0), F.col("_ppv") / F.nullif(F.col("_pv"), F.lit(0)))
    first_hour = div(F.col("_hpv"), F.col("_hv"))
    df = df.withColumns({
        "_pm": premarket, "_fh": F.when(hour1, first_hour),
        "_th": at_high, "_tl": at_low,
    })
    hold_anchor = lambda touch: _hold(
        F.when(F.col(touch), F.when(vol > 0, F.struct(F.col("close").alias("v"))).otherwise(
            F.struct(F.lit(None).cast("double").alias("v"))))
    )["v"]
    df = df.withColumns(
        {
            "f__anchor__session_avwap": F.when(F.col("_cv") > 0, F.col("_cpv") / F.nullif(F.col("_cv"), F.lit(0)))
            .otherwise(F.col("close")),
            "f__anchor__premarket_avwap": F.coalesce(_hold(F.col("_pm")), F.col("close")),
            "f__anchor__first_hour_avwap": F.when(
                hour1 | (ts > F.col("first_hour_ns")), F.coalesce(_held_first_hour(hour1), F.col("close"))
            ).otherwise(F.col("close")),
            "f__anchor__prev_high_avwap": hold_anchor("_th"),
            "f__anchor__prev_low_avwap": hold_anchor("_tl"),
        }
    )
    return df.drop("_i", "_n", "_cpv", "_cv", "_ppv", "_pv", "_hpv", "_hv", "_ph", "_pl", "_pm", "_fh", "_th", "_tl")


def _held_first_hour(hour1: Column) -> Column:
    """Running value inside the first hour, its last value afterwards."""
    return _hold(F.when(hour1, F.struct(F.col("_fh").alias("v"))))["v"]
