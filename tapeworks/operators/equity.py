"""Equity curves: returns, volatility, drawdowns and their durations, per run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import div, flag, pct_change
from .series import Frame, split_series


def with_drawdown(f: Frame, equity: str = "equity") -> Frame:
    """Running maximum and relative distance below it."""
    f = f.running({"peak": ("max", F.col(equity))})
    return f.with_cols(drawdown=div(F.col(equity) - F.col("peak"), F.col("peak")))


def drawdown_runs(f: Frame) -> Frame:
    """Length of the current stretch below the peak: rows since the last row at the peak."""
    at_peak = ~flag(F.col("drawdown") < 0)
    f = f.running({"_pos": ("count", F.lit(1))})
    f = f.running({"_peak_pos": ("last", F.when(at_peak, F.col("_pos")))})
    return f.with_cols(drawdown_length=F.col("_pos") - F.coalesce("_peak_pos", F.lit(0))).drop("_pos", "_peak_pos")


def drawdown_table(curve: DataFrame, keys: tuple[str, ...] = ("run_id",), equity: str = "equity", max_rows: int | None = None) -> DataFrame:
    return drawdown_runs(with_drawdown(split_series(curve, keys, max_rows=max_rows), equity)).finish()


def equity_metrics(curve: DataFrame, keys: tuple[str, ...] = ("run_id",), equity: str = "equity", risk_free: float = 0.02,
                   max_rows: int | None = None) -> DataFrame:
    """Total and annualised return, annualised volatility, Sharpe over the risk-free rate, worst drawdown."""
    f = split_series(curve, keys, lookback=1, max_rows=max_rows)
    f = f.with_cols(_r=pct_change(F.col(equity), f.lag(equity)))
    df = drawdown_runs(with_drawdown(f, equity)).finish()
    g = df.groupBy(*keys).agg(
        F.min_by(equity, "ts").alias("initial_equity"), F.max_by(equity, "ts").alias("final_equity"), F.count(F.lit(1)).alias("bars"),
        F.stddev_samp("_r").alias("_sd"), F.min("drawdown").alias("max_drawdown"), F.max("drawdown_length").alias("max_drawdown_duration"))
    growth = div(F.col("final_equity"), F.col("initial_equity"))
    g = g.withColumns({"total_return": growth - 1, "annualized_return": F.pow(growth, F.lit(252.0) / F.col("bars")) - 1,
                       "volatility": F.col("_sd") * math.sqrt(252)})
    return g.withColumn("sharpe", div(F.col("annualized_return") - risk_free, F.col("volatility"))).drop("_sd")
