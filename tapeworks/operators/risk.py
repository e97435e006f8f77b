"""Sizing, stops, exposure and risk scores as column operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathcols import clip, div
from .joins import with_grid
from .screen import latest_rows
from .series import split_series

# Fixed values: (risk multiplier, ATR multiplier) per regime.
REGIME_RISK = {"BULL": (1.0, 1.0), "BEAR": (0.8, 1.2), "SIDEWAYS": (0.9, 1.1), "STRESS": (0.3, 1.5), "OFF": (1.0, 1.0)}
# Fixed values: (risk mode, share of risk taken off) per regime.
REGIME_MODE = {"BULL": ("normal", 0.0), "BEAR": ("conservative", 0.2), "SIDEWAYS": ("neutral", 0.1), "STRESS": ("stress", 0.7)}


def _by_regime(regime: Column, table: dict, i: int, default) -> Column:
    out = F.lit(default)
    for name, values in table.items():
        out = F.when(regime == name, F.lit(values[i])).otherwise(out)
    return out


def atr_quantity(price: Column, atr: Column, equity: float, frac: float = 0.02, mult: float = 1.0, regime: Column | None = None) -> Column:
    """Shares such that one ATR stop loses ``frac`` of equity; NULL where it cannot be sized.

    Capped by what equity buys and at least 1.  A regime scales both factors within fixed clamps.
    """
    f, m = F.lit(float(frac)), F.lit(float(mult))
    if regime is not None:
        f = clip(f * _by_regime(regime, REGIME_RISK, 0, 1.0), 0.001, 0.1)
        m = clip(m * _by_regime(regime, REGIME_RISK, 1, 1.0), 0.5, 3.0)
    afford = F.floor(F.lit(equity) / F.nullif(price, F.lit(0.0)))
    qty = F.greatest(F.least(F.floor(f * equity / F.nullif(atr * m, F.lit(0.0))), afford), F.lit(1))
    return F.when((atr > 0) & (price > 0) & (afford > 0), qty).cast("long")


def stop_and_target(df: DataFrame, mult: float = 1.0, price: str = "close", atr: str = "atr", hint: str | None = None) -> DataFrame:
    stop = F.col(price) - F.col(atr) * mult
    return df.withColumns({
        "stop_price": F.coalesce(F.nullif(F.col(hint), F.lit(0.0)), stop) if hint else stop, "target_price": F.col(price) + F.col(atr) * mult})


def regime_context(df: DataFrame) -> DataFrame:
    """Rejection flag, risk mode and reduction by regime."""
    r = F.col("regime")
    return df.withColumns({"rejected": r == "STRESS", "risk_mode": _by_regime(r, REGIME_MODE, 0, "normal"),
                           "risk_reduction": _by_regime(r, REGIME_MODE, 1, 0.0)})


def risk_levels(df: DataFrame, stop_multiple: float = 1.0, reward: float = 1.5, min_stop: float = 0.0005, max_stop: float = 0.05,
                price: str = "close", atr: str = "atr", side: str = "side") -> DataFrame:
    """Stop and target distances within percentage clamps; NULL without a positive price and ATR."""
    p, a = F.col(price), F.col(atr)
    stop = F.when((p > 0) & (a > 0), F.least(F.greatest(a * stop_multiple, p * min_stop), p * max_stop))
    sign = F.when(F.col(side) == "long", 1).otherwise(-1)
    target = stop * max(reward, 1.0)
    return df.withColumns({
        "stop_pct": stop / F.nullif(p, F.lit(0.0)), "take_profit_pct": target / F.nullif(p, F.lit(0.0)), "risk_stop_price": p - stop * sign,
        "risk_target_price": p + target * sign, "expected_r": F.when(stop.isNotNull(), F.lit(float(reward)))})


def trailing_stops(path: DataFrame, initial_multiple: float = 2.0, trail_multiple: float = 1.5, activation: float = 1.0) -> DataFrame:
    """Stop along each trade's bars (trade_id, ts, side, price, atr, entry_price).

    Starts at the initial stop; once the profit reached ``activation`` ATRs it follows the best price and
    never loosens.  Windows run over one trade.
    """
    w = Window.partitionBy("trade_id").orderBy("ts")
    hist = w.rowsBetween(Window.unboundedPreceding, 0)
    long = F.col("side") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    # Mirrored prices make a short trade look like a long one.
    df = path.withColumns({"_p": F.col("price") * sign, "_e": F.col("entry_price") * sign, "_i": F.row_number().over(w)})
    df = df.withColumns({
        "_best": F.max("_p").over(hist), "_first": F.first("_e").over(hist) - F.first("atr").over(hist) * initial_multiple,
        "_on": F.max(F.when(F.col("_i") > 1, div(F.col("_p") - F.col("_e"), F.col("atr")) >= activation).otherwise(F.lit(False))).over(hist)})
    df = df.withColumn("_cand", F.when(F.col("_on"), F.col("_best") - F.col("atr") * trail_multiple))
    return df.withColumn("stop", F.greatest(F.col("_first"), F.max("_cand").over(hist)) * sign).drop("_p", "_e", "_i", "_best", "_first", "_on", "_cand")


def position_sizes(df: DataFrame, method: str, max_size: float = 1000.0, account: float = 100_000.0, tolerance: float = 0.02) -> DataFrame:
    """Size from signal strength by one of four methods, capped."""
    s, vol, conf = F.abs("signal_strength"), F.col("volatility"), F.col("confidence")
    if method == "fixed":
        size = s * (max_size * 0.5)
    elif method == "volatility":
        size = s * max_size * (F.lit(0.02) / F.greatest(vol, F.lit(0.01)))
    elif method == "kelly":
        loss = vol * 1.5
        frac = div(conf * (s * vol * 2) - (1 - conf) * loss, loss)
        size = F.coalesce(clip(frac, 0.0, 0.25), F.lit(0.0)) * max_size
    elif method == "risk_parity":
        size = F.lit(account * tolerance / 10) / F.nullif(vol * math.sqrt(252), F.lit(0.0)) * s
    else:
        raise ValueError(f"unknown sizing method: {method}")
    cap = min(max_size, account * tolerance)
    return df.withColumns({"size": F.least(size, F.lit(cap)), "was_capped": size > cap})


def exposures(positions: DataFrame, capital: float, by: list[str] | None = None) -> DataFrame:
    """Long, short, gross, net, leverage and concentration of size * price."""
    e = F.col("size") * F.col("price")
    g = positions.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(F.when(F.col("size") > 0, e)), F.lit(0.0)).alias("long_exposure"),
        F.coalesce(F.sum(F.when(F.col("size") < 0, F.abs(e))), F.lit(0.0)).alias("short_exposure"), F.max(F.abs(e)).alias("max_position"))
    gross = F.col("long_exposure") + F.col("short_exposure")
    return g.withColumns({"gross_exposure": gross, "net_exposure": F.col("long_exposure") - F.col("short_exposure"),
                          "leverage": gross / capital, "concentration": F.col("max_position") / capital})


def limit_alerts(values: DataFrame, limits: dict[str, float], warning: float = 0.8, critical: float = 0.95) -> DataFrame:
    """(limit, value) rows against limits: utilisation and severity, only those at warning or above."""
    limit = F.lit(None).cast("double")
    for name, v in limits.items():
        limit = F.when(F.col("limit_name") == name, F.lit(float(v))).otherwise(limit)
    df = values.withColumn("limit_value", limit).where(F.col("limit_value") > 0)
    df = df.withColumn("utilization", F.col("current_value") / F.col("limit_value"))
    sev = F.when(F.col("utilization") >= critical, "critical").when(F.col("utilization") >= warning, "warning")
    return df.withColumn("severity", sev).where(F.col("severity").isNotNull())


def price_scenarios(positions: DataFrame, changes: dict[str, float]) -> DataFrame:
    """Net exposure under each relative price change (the change factors out of the sum)."""
    total = positions.agg(F.sum(F.col("size") * F.col("price")).alias("_t"))
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(c)).alias("change")) for n, c in changes.items()])
    return total.select(F.inline(rows), "_t").select("scenario", (F.col("_t") * (1 + F.col("change"))).alias("exposure"))


def risk_level(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.6, "medium").when(score < 0.8, "high").otherwise("critical")


def position_risk(positions: DataFrame) -> DataFrame:
    """Volatility proxy, value at risk, drawdown and weighted risk score of each position."""
    size, entry, cur = F.col("size"), F.col("entry_price"), F.col("current_price")
    move = (cur - entry) / entry
    df = positions.withColumns({"_value": size * cur, "volatility": F.abs(cur - entry) / entry * math.sqrt(252)})
    df = df.withColumns({
        "var_95": F.abs(F.col("_value") * F.col("volatility") * 1.65), "var_99": F.abs(F.col("_value") * F.col("volatility") * 2.33),
        "max_drawdown": F.abs(F.least(move * 100, F.lit(0.0)))})
    cap = lambda x: F.least(F.lit(1.0), x)
    ratio = F.when(F.col("_value") > 0, cap(F.col("var_95") / F.nullif(F.col("_value"), F.lit(0.0)))).otherwise(F.lit(0.0))
    # No model attached means liquidity 0.3, correlation 0 and model risk 0.5.
    score = (cap(F.col("volatility") * 10) * 0.3 + ratio * 0.2 + cap(F.col("max_drawdown") / 10) * 0.15
             + cap(F.abs(size) / 10000) * 0.1 + F.lit(0.1 * 0.3 + 0.05 * 0.5))
    return df.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score"))).drop("_value")


def portfolio_risk(risks: DataFrame) -> DataFrame:
    g = risks.agg(F.sum("var_95").alias("var_95"), F.sum("var_99").alias("var_99"), F.avg("volatility").alias("volatility"),
                  F.max("max_drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("positions"))
    cap = lambda x: F.least(F.lit(1.0), x)
    score = (cap(F.col("volatility") * 10) * 0.3 + cap(F.col("var_95") / 100000) * 0.2 + cap(F.col("max_drawdown") / 10) * 0.15
             + cap(F.col("positions") * 0.1) * 0.15 + F.lit(0.1 * 0.3))
    return g.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score")))


def limit_violations(df: DataFrame, limits: list[tuple[str, str, str, float]]) -> DataFrame:
    """Rows breaking (name, metric, operator, threshold) limits, one output row per broken limit."""
    ops = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    hits = F.array_compact(F.array(*[
        F.when(ops[op](F.col(metric), F.lit(float(th))), F.struct(
            F.lit(name).alias("limit_name"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"), F.lit(float(th)).alias("threshold")))
        for name, metric, op, th in limits]))
    return df.select("*", F.inline(hits))


def size_from_range(signals: DataFrame, bars: DataFrame, equity: float = 1_000_000.0, frac: float = 0.02, mult: float = 1.0, n: int = 14,
                    max_rows: int | None = None) -> DataFrame:
    """Sizes from the latest n-bar high-low range of the symbol; symbols with fewer bars are dropped."""
    f = split_series(bars, lookback=n, max_rows=max_rows)
    rng = f.agg(F.max, "high", n) - f.agg(F.min, "low", n)
    last = latest_rows(f.with_cols(atr=rng).finish().select("symbol", "ts", "atr")).select("symbol", "atr").where(F.col("atr") > 0)
    df = signals.join(last, "symbol").withColumn("qty", atr_quantity(F.col("close"), F.col("atr"), equity, frac, mult))
    return df.where(F.col("qty").isNotNull()).withColumn("risk_frac", F.lit(float(frac)))


def adjust_prediction(df: DataFrame, factor: float = 0.5, max_score: float = 0.8) -> DataFrame:
    """Risk score raised for extreme, volatile or illiquid cases; prediction shrunk; blocking reasons."""
    p, s = F.abs("prediction"), F.col("risk_score")
    s = F.when(p > 2.0, F.least(s * 1.2, F.lit(1.0))).when(p < 0.1, s * 0.9).otherwise(s)
    s = F.when(F.col("volatility") > 0.3, F.least(s * 1.1, F.lit(1.0))).otherwise(s)
    s = F.when(F.col("liquidity") < 0.3, F.least(s * 1.15, F.lit(1.0))).otherwise(s)
    df = df.withColumn("adjusted_score", s)
    a = F.col("adjusted_score")
    reasons = F.array_compact(F.array(
        F.when(a > max_score, F.lit("risk_score")), F.when(F.col("exposure") > F.col("exposure_limit"), F.lit("exposure")),
        F.when(a >= 0.8, F.lit("critical_level"))))
    return df.withColumns({
        "risk_level": risk_level(a), "adjusted_prediction": F.col("prediction") * F.greatest(1.0 - a * factor, F.lit(0.1)),
        "size_multiplier": F.when(a < 0.3, 1.0).when(a < 0.6, 0.75).when(a < 0.8, 0.5).otherwise(0.1), "block_reasons": reasons})


def sizing_grid(df: DataFrame, grid: dict[str, list], equity: float) -> DataFrame:
    """Quantity of every row under every (frac, mult) combination; a price of zero sets no bound by equity."""
    g = with_grid(df, grid)
    risk = F.floor(F.col("frac") * equity / F.nullif(F.col("atr") * F.col("mult"), F.lit(0.0)))
    return g.withColumn("qty", F.greatest(F.least(risk, F.floor(div(F.lit(equity), F.col("close")))), F.lit(1)).cast("long"))
