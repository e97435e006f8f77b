"""Forward-looking labels.  Every label at t uses only rows after t (plus volatility known at t)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mathcols import clip, div, flag
from ..functions.timecols import MINUTE_NS, SESSION_CLOSE, SESSION_OPEN, market_minute, session_date
from .features_core import add_atr
from .jumps import first_crossing, next_true
from .quantiles import exact_percentiles
from .series import Frame, ensure_checkpoint_dir, look_ahead, rows_within, settle, split_series


def forward_return(f: Frame, n: int, price: str = "close", out: str = "forward_return") -> Frame:
    nxt = f.lead(price, n)
    return f.with_cols(**{out: div(nxt - F.col(price), F.col(price))})


@dataclass(frozen=True)
class FirstHitConfig:
    """Settings of the tri-class label; the defaults are fixed values."""

    horizon_minutes: int = 30
    atr_window: int = 14
    multiplier: float = 1.0
    min_atr: float = 0.01
    atr_return_min: float = 1e-4
    atr_return_max: float = 0.05
    stop_multiplier: float | None = None
    min_r_multiple: float = 1.0
    target_buffer: float = 0.0
    max_threshold: float | None = None
    min_after_open: int | None = None
    max_before_close: int | None = None


def session_allowed(cfg: FirstHitConfig) -> Column:
    if cfg.min_after_open is None and cfg.max_before_close is None:
        return F.lit(True)
    m = market_minute("ts")
    return (m >= SESSION_OPEN + (cfg.min_after_open or 0)) & (m <= SESSION_CLOSE - (cfg.max_before_close or 0))


def _threshold(cfg: FirstHitConfig, mult: Column) -> Column:
    t = F.col("_atr_ret") * F.greatest(mult, F.lit(1e-6))
    if cfg.stop_multiplier is not None:
        t = F.greatest(t, F.col("_atr_ret") * cfg.stop_multiplier * max(cfg.min_r_multiple, 1.0) + max(cfg.target_buffer, 0.0))
        if cfg.max_threshold is not None:
            t = F.least(t, F.lit(cfg.max_threshold))
    return t


def _with_atr_return(f: Frame, cfg: FirstHitConfig) -> Frame:
    f = add_atr(f, {"_atr": cfg.atr_window})
    floor_atr = max(cfg.min_atr, 1e-6)
    fallback = F.greatest(F.lit(floor_atr) / F.greatest(F.col("close"), F.lit(1e-6)), F.lit(1e-6))
    ret = F.greatest(F.col("_atr"), F.lit(floor_atr)) / F.greatest(F.col("close"), F.lit(1e-6))
    lo = max(cfg.atr_return_min, 1e-6)
    return f.with_cols(_fallback=fallback, _atr_ret=F.greatest(
        clip(F.greatest(ret, fallback), lo, max(cfg.atr_return_max, lo + 1e-6)), fallback))


def _frame(bars: DataFrame, cfg: FirstHitConfig, max_rows: int | None) -> Frame:
    horizon = cfg.horizon_minutes * MINUTE_NS
    return split_series(bars, lookback=cfg.atr_window + 2, lookahead=lambda: rows_within(bars, ["symbol"], "ts", horizon), max_rows=max_rows)


def first_hit_labels(bars: DataFrame, cfg: FirstHitConfig | None = None, multipliers: DataFrame | None = None,
                     max_rows: int | None = None) -> DataFrame:
    """Label +1/-1 for the side whose volatility threshold is reached first within the horizon, else 0.

    ``multipliers`` (symbol, long_mult, short_mult) overrides the common multiplier.
    """
    cfg = cfg or FirstHitConfig()
    f = _with_atr_return(_frame(bars, cfg, max_rows), cfg)
    if multipliers is not None:
        f = Frame(f.df.join(multipliers.select("symbol", "long_mult", "short_mult"), "symbol", "left"), f.keys, f.order, f.split)
        long_m, short_m = (F.coalesce(c, F.lit(cfg.multiplier)) for c in ("long_mult", "short_mult"))
    else:
        long_m = short_m = F.lit(cfg.multiplier)
    f = f.with_cols(threshold_long=_threshold(cfg, long_m), threshold_short=_threshold(cfg, short_m))
    # Thresholds are compared as returns, exactly as stated, not as price levels; a return rises with its price, so that of a stretch's highest
    # price says whether any price of the stretch reaches the threshold.
    f = look_ahead(f.with_cols(_close=F.col("close").cast("double")), cfg.horizon_minutes * MINUTE_NS, ["_close", "threshold_long", "threshold_short"],
                   _first_side, {"_side": T.LongType()})
    f = f.with_cols(label=F.when(flag(F.col("close") > 0) & session_allowed(cfg), F.col("_side")).otherwise(F.lit(0)).cast("int"))
    return f.drop("_side", "_close", "_atr_ret", "_fallback", "_atr").finish()


def _first_side(time: np.ndarray, columns: list[np.ndarray], until: np.ndarray) -> list[np.ndarray]:
    """1 or -1 by the threshold that a later price within the horizon reaches first (the upper one where both are), else 0."""
    price, upper, lower = columns
    with np.errstate(all="ignore"):
        base = np.where(price == 0, np.nan, price)

        def crosses(i: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
            return ((high - price[i]) / base[i] >= upper[i]) | ((low - price[i]) / base[i] <= -lower[i])

        at = first_crossing(price, until, crosses)
        reached = at < until
        move = (price[np.where(reached, at, 0)] - price) / base
        side = np.where(move >= upper, 1, np.where(move <= -lower, -1, 0))
    return [np.where(reached, side, 0)]


def volatility_multipliers(bars: DataFrame, cfg: FirstHitConfig, target_move: float = 0.0075, price_q: float = 0.5,
                           atr_q: float = 0.7, mix: float = 0.6, lo: float = 1e-4, hi: float = 0.12,
                           max_rows: int | None = None) -> DataFrame:
    """Per symbol: base^(1-mix) * (target * price quantile / ATR quantile)^mix, within bounds."""
    f = split_series(bars, lookback=cfg.atr_window + 2, max_rows=max_rows)
    df = add_atr(f, {"_atr": cfg.atr_window}).finish().where((F.col("close") > 0) & (F.col("_atr") > 0))
    q = exact_percentiles(df, ["symbol"], "close", {"close_ref": price_q}).join(
        exact_percentiles(df, ["symbol"], "_atr", {"atr_ref": atr_q}), "symbol")
    mix = min(max(mix, 0.0), 1.0)
    raw = F.lit(target_move) * F.col("close_ref") / F.col("atr_ref")
    return q.withColumn("multiplier", clip(F.lit(cfg.multiplier ** (1.0 - mix)) * F.pow(raw, F.lit(mix)), lo, hi))


def balance_multipliers(bars: DataFrame, cfg: FirstHitConfig, passes: int = 6, step: float = 0.12, tolerance: float = 0.25,
                        target_ratio: float = 1.0, min_directional: int = 40, lo: float = 0.002, hi: float = 0.08,
                        growth: float = 0.5, start: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Adjust each symbol's long and short multipliers until its label counts balance (a few passes).

    A pass is one labelling job followed by an aggregation to one row per symbol; only that small table is
    carried (checkpointed) to the next pass.
    """
    ensure_checkpoint_dir(bars.sparkSession)
    step, growth = max(0.0, min(step, 0.9)), max(0.0, min(growth, 1.5))
    base = F.lit(max(cfg.multiplier, 1e-6))
    mult = start if start is not None else bars.select("symbol").distinct().select(
        "symbol", base.alias("long_mult"), base.alias("short_mult"))
    mult = settle(mult.select("symbol", "long_mult", "short_mult").withColumn("done", F.lit(False)))
    lm, sm = F.col("long_mult"), F.col("short_mult")
    grow = 1.0 + step * max(growth, 0.1)
    for _ in range(passes):
        counts = first_hit_labels(bars, cfg, mult, max_rows).groupBy("symbol").agg(
            F.sum((F.col("label") == 1).cast("long")).alias("n_long"), F.sum((F.col("label") == -1).cast("long")).alias("n_short"))
        j = mult.join(counts, "symbol", "left").na.fill(0, ["n_long", "n_short"])
        nl, ns = F.col("n_long"), F.col("n_short")
        few = nl + ns < max(min_directional, 1)
        ratio = F.when(ns > 0, nl / F.nullif(ns, F.lit(0)))
        balanced = ~few & flag(F.abs(ratio - target_ratio) <= tolerance)
        shrink_l, shrink_s = F.greatest(lm * (1 - step), F.lit(lo)), F.greatest(sm * (1 - step), F.lit(lo))
        few_scale = max(1.0 - step, 0.05)
        more_long = ratio < target_ratio
        new_l = (F.when(few, F.greatest(lm * few_scale, F.lit(lo))).when(ns == 0, lm).when(nl == 0, shrink_l)
                 .when(more_long, shrink_l).otherwise(F.least(lm * grow, F.lit(hi))))
        new_s = (F.when(few, F.greatest(sm * few_scale, F.lit(lo))).when(ns == 0, shrink_s).when(nl == 0, sm)
                 .when(more_long, F.least(sm * grow, F.lit(hi))).otherwise(shrink_s))
        stop = F.col("done") | balanced
        mult = settle(j.select("symbol", F.when(stop, lm).otherwise(new_l).alias("long_mult"),
                               F.when(stop, sm).otherwise(new_s).alias("short_mult"), stop.alias("done")))
        if mult.where(~F.col("done")).limit(1).count() == 0:
            break
    return mult


def majority_label(labels: DataFrame) -> DataFrame:
    """One label per timestamp by vote of the symbols; a tie for the lead gives 0."""
    counts = labels.groupBy("ts", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ts")
    top = counts.withColumns({"_max": F.max("n").over(w)}).where(F.col("n") == F.col("_max"))
    return top.groupBy("ts").agg(
        F.when(F.count(F.lit(1)) == 1, F.first("label")).otherwise(F.lit(0)).alias("label"), F.max("n").alias("votes"))


def big_move_labels(f: Frame, n: int, atr: str, k: float, floor: float, atr_is_return: bool = False) -> Frame:
    """Whether the n-bar return beats max(k * ATR return, floor), and its direction."""
    f = forward_return(f, n)
    ret, price = F.col("forward_return"), F.col("close")
    atr_ret = F.col(atr) if atr_is_return else div(F.col(atr), price)
    cut = F.when(atr_ret.isNotNull(), F.greatest(atr_ret * k, F.lit(floor)))
    f = f.with_cols(big_move_threshold=cut)
    big = flag(F.abs(ret) >= F.col("big_move_threshold"))
    return f.with_cols(big_move=big.cast("int"), direction=F.when(big, F.signum(ret).cast("int")).otherwise(F.lit(0)))


def shortest_horizon(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    """Multi-horizon labels combine to the label of the shortest horizon."""
    return df.withColumn("label", F.col(columns[min(columns)]))


def vwap_exits(bars: DataFrame, vwap: str, min_deviation_pct: float = 0.5, horizon_minutes: int = 50,
               max_per_day: int = 2, position_value: float = 2000.0,
               max_rows: int | None = None) -> DataFrame:
    """Trades from deviations: enter at the close, leave at the first later close back at its VWAP.

    Within ``horizon_minutes``; otherwise at the last bar of the horizon (timeout).  Long entries of a day
    come before its short ones and together they are capped per day over all symbols.
    """
    horizon = horizon_minutes * MINUTE_NS
    f = split_series(bars, lookahead=lambda: rows_within(bars, ["symbol"], "ts", horizon), max_rows=max_rows)
    dev = div(F.col("close") - F.col(vwap), F.col(vwap))
    f = f.with_cols(vwap_deviation_pct=F.abs(dev) * 100, direction=F.when(dev < 0, "LONG").when(dev > 0, "SHORT"),
                    _side=F.signum(dev), _price=F.col("close").cast("double"), _vwap=F.col(vwap).cast("double"))
    f = look_ahead(f, horizon, ["_price", "_vwap", "_side"], _first_return,
                   {"_exit_ts": T.LongType(), "_exit_px": T.DoubleType(), "_returned": T.DoubleType()})
    df = f.finish().where(
        F.col("direction").isNotNull() & (F.col("vwap_deviation_pct") >= min_deviation_pct) & F.col("_exit_ts").isNotNull())
    day = Window.partitionBy("date").orderBy("direction", "ts", "symbol")
    df = df.withColumn("date", session_date("ts")).withColumn("_rn", F.row_number().over(day)).where(F.col("_rn") <= max_per_day)
    qty = F.greatest(F.floor(F.lit(position_value) / F.col("close") / 100) * 100, F.lit(100))
    exit_px = F.col("_exit_px")
    pnl = F.when(F.col("direction") == "LONG", exit_px - F.col("close")).otherwise(F.col("close") - exit_px) * qty
    return df.select(
        "date", "symbol", "direction", F.col("ts").alias("entry_ts"), F.col("_exit_ts").alias("exit_ts"),
        F.col("close").alias("entry_price"), exit_px.alias("exit_price"), qty.cast("long").alias("quantity"), pnl.alias("pnl"),
        (pnl / position_value * 100).alias("pnl_pct"),
        F.floor((F.col("_exit_ts") - F.col("ts")) / MINUTE_NS).cast("long").alias("duration_minutes"),
        F.when(pnl > 0, "WIN").otherwise("LOSS").alias("result"),
        F.when(F.col("_returned") > 0, "vwap_target").otherwise("timeout").alias("exit_reason"), "vwap_deviation_pct")


def _first_return(time: np.ndarray, columns: list[np.ndarray], until: np.ndarray) -> list[np.ndarray]:
    """Time and price of the first later row back at its VWAP within the horizon, else of the horizon's last row, and whether it came back (1)."""
    price, vwap, side = columns
    rows = np.arange(len(price))
    # a long position waits for a price at or above its VWAP, a short one for a price at or below
    back = np.where(side < 0, next_true(price >= vwap)[1:], next_true(price <= vwap)[1:])
    returned = back < until
    at = np.where(returned, back, until - 1)
    later = at > rows
    at = np.where(later, at, 0)
    when = np.ma.array(time[at], mask=~later) if len(at) else time
    return [when, np.where(later, price[at], np.nan), (returned & later).astype(float)]


def deviation_counts(bars: DataFrame, vwap: str, min_deviation_pct: float = 0.5) -> DataFrame:
    """Bars, long and short deviation signals per symbol."""
    dev = div(F.col("close") - F.col(vwap), F.col(vwap)) * 100
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.sum(flag(dev <= -min_deviation_pct).cast("long")).alias("long_signals"),
        F.sum(flag(dev >= min_deviation_pct).cast("long")).alias("short_signals"))
