"""Round trips from fills, prediction evaluation, trade statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathcols import div, flag
from ..functions.timecols import DAY_NS, MINUTE_NS, idiv
from .joins import attach_one_row
from .quantiles import exact_percentiles, kth_largest, order_statistics
from .series import affine_recurrence, split_series

YEAR = math.sqrt(252)


def round_trips(fills: DataFrame, keys: Iterable[str] = ("symbol",), order: Iterable[str] = ("ts", "order_id"),
                max_rows: int | None = None) -> DataFrame:
    """Pair each closing fill with the open one: an opposite fill closes, a same-side fill replaces.

    No per-row loop is needed.  In a maximal run of one side the last fill is the open position, unless the
    run is a single fill that closed the previous one; so whether a run ends open only depends on its
    length and, through a chain of single-fill runs, on parity since the last longer run.
    """
    keys, order = tuple(keys), tuple(order)
    cols = [c for c in ("order_id", "symbol", "price", "quantity", "commission", "reason") if c in fills.columns and c not in keys]
    rows = fills.where(F.col("quantity") > 0).withColumn("side", F.upper("side"))
    f = split_series(rows, keys, order, lookback=1, max_rows=max_rows)
    f = f.with_cols(_new=F.when(flag(f.lag("side") == F.col("side")), 0).otherwise(1))
    df = f.running({"_run": ("sum", F.col("_new"))}).finish()
    pos, fill = F.struct(*order), F.struct("ts", *[c for c in cols])
    runs = df.groupBy(*keys, "_run", "side").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("ts"), F.min_by(fill, pos).alias("_head"), F.max_by(fill, pos).alias("_tail"))
    r = split_series(runs, keys, ("ts", "_run"), lookback=1, max_rows=max_rows)
    r = r.running({"_long": ("last", F.when(F.col("_n") >= 2, F.col("_run")))}, inclusive=False)
    prior = F.col("_run") - 1
    # Open at the start: the previous run ended open.
    odd = F.pmod(prior - F.coalesce(F.col("_long"), F.lit(0)), F.lit(2)) == 1
    open_before = F.when(F.col("_long").isNull(), (prior >= 1) & odd).otherwise((prior == F.col("_long")) | ~odd)
    r = r.with_cols(_entry=r.lag("_tail"), _entry_side=r.lag("side"), _open=open_before)
    t = r.finish().where(F.col("_open") & F.col("_entry").isNotNull())
    e, x = F.col("_entry"), F.col("_head")
    qty = F.least(e["quantity"], x["quantity"])
    sign = F.when(F.col("_entry_side") == "BUY", 1).otherwise(-1)
    gross = (x["price"] - e["price"]) * sign * qty
    fees = (e["commission"] + x["commission"]) if "commission" in cols else F.lit(0.0)
    out = {
        "direction": F.when(F.col("_entry_side") == "BUY", "LONG").otherwise("SHORT"),
        "entry_ts": e["ts"], "exit_ts": x["ts"], "entry_price": e["price"], "exit_price": x["price"], "qty": qty,
        "gross_pnl": gross, "fees": fees, "net_pnl": gross - fees, "duration_minutes": (x["ts"] - e["ts"]) / MINUTE_NS,
    }
    if "order_id" in cols:
        out |= {"entry_order_id": e["order_id"], "exit_order_id": x["order_id"]}
    if "reason" in cols:
        out |= {"entry_reason": e["reason"], "exit_reason": x["reason"]}
    return t.select(*keys, *[c.alias(n) for n, c in out.items()])


def pairing_metrics(fills: DataFrame, key: str = "run_id") -> DataFrame:
    """Metrics of sequentially paired fills per run, all symbols in one sequence."""
    trips = round_trips(fills, (key,))
    g = trips.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("gross_pnl").alias("_gross"), F.avg((F.col("gross_pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("duration_minutes").alias("avg_duration_minutes"))
    f = fills.groupBy(key).agg(F.sum("commission").alias("fees_total"), F.countDistinct(idiv(F.col("ts"), DAY_NS)).alias("_days"))
    net = F.col("_gross") - F.col("fees_total")
    return f.join(g, key, "left").select(
        key, F.coalesce("trades", F.lit(0)).alias("trades"), "fees_total", net.alias("total_pnl"), "win_rate",
        (net / F.col("trades")).alias("avg_r"), (F.col("trades") / F.col("_days")).alias("trades_per_day"), "avg_duration_minutes")


def average_cost_trips(fills: DataFrame, keys: Iterable[str] = ("symbol",), order: Iterable[str] = ("ts", "order_id"),
                       max_rows: int | None = None) -> DataFrame:
    """Long-only sales against the average cost of the position; sales beyond it are cut, without it ignored.

    The position is the running signed quantity, reflected at zero.  The cost follows
    cost = factor * cost + purchase, an affine recurrence whose factors are known from the position.
    """
    keys, order = tuple(keys), tuple(order)
    buy = F.upper("side") == "BUY"
    df = fills.select(*keys, *order, buy.alias("_buy"), F.col("quantity").cast("double").alias("_q"),
                      F.col("total_cost").cast("double").alias("_c"))
    f = split_series(df, keys, order, max_rows=max_rows)
    f = f.with_cols(_d=F.when(F.col("_buy"), F.col("_q")).otherwise(-F.col("_q")))
    f = f.running({"_s": ("sum", F.col("_d"))}).running({"_low": ("min", F.col("_s"))})
    after = F.col("_s") - F.least(F.col("_low"), F.lit(0.0))
    # Before this row: undo the step, and the reflection as it stood one row earlier.
    f = f.with_cols(_after=after).running({"_before": ("last", after)}, inclusive=False)
    before = F.coalesce("_before", F.lit(0.0))
    sold = F.when(~F.col("_buy"), F.least(F.col("_q"), before)).otherwise(F.lit(0.0))
    f = f.with_cols(_held=before, _sold=sold)
    keep = F.when(F.col("_buy"), F.lit(1.0)).when(F.col("_held") > 0, 1.0 - F.col("_sold") / F.col("_held")).otherwise(F.lit(1.0))
    f = f.with_cols(_a=keep, _b=F.when(F.col("_buy"), F.col("_c")).otherwise(F.lit(0.0)))
    f = affine_recurrence(f, "_a", "_b", "_cost")
    f = f.running({"_basis": ("last", F.col("_cost"))}, inclusive=False)
    sales = f.finish().where(~F.col("_buy") & (F.col("_held") > 0))
    return sales.select(*keys, *order, F.col("_sold").alias("quantity"),
                        (F.col("_c") - F.coalesce("_basis", F.lit(0.0)) / F.col("_held") * F.col("_sold")).alias("pnl"))


def trade_statistics(trades: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Counts, averages, extremes, profit factor of a ``pnl`` column."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    df = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count(win).alias("winning_trades"), F.count(loss).alias("losing_trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl").alias("avg_trade_pnl"), F.sum("pnl").alias("total_pnl"),
        F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.max(win).alias("largest_win"), F.min(loss).alias("largest_loss"),
        F.sum(win).alias("_w"), F.sum(loss).alias("_l"))
    return df.withColumn("profit_factor", div(F.col("_w"), F.abs("_l"))).drop("_w", "_l")


# --- evaluation of predictions ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    """Which scored predictions become trades: all above thresholds, or the best ``top_k`` of each day."""

    top_k: int | None = None
    min_prob: float = 0.0
    min_edge: float | None = None
    min_score: float | None = None
    score: str = "trade_score"


def select_trades(scored: DataFrame, s: Selection) -> DataFrame:
    df = scored.where(F.col("trade_prob") >= s.min_prob)
    if s.min_edge is not None:
        df = df.where(F.col("edge_margin") >= s.min_edge)
    if s.min_score is not None:
        df = df.where(F.col("trade_score") >= s.min_score)
    df = df.withColumn("trade_day", idiv(F.col("ts"), DAY_NS))
    if s.top_k is None:
        return df
    w = Window.partitionBy("trade_day").orderBy(F.col(s.score).desc(), "ts", "symbol")
    return df.withColumn("rank_within_day", F.row_number().over(w)).where(F.col("rank_within_day") <= s.top_k)


def trade_returns(selected: DataFrame, realised: DataFrame, cost: float = 0.0) -> DataFrame:
    """Join realised returns and take costs off."""
    df = selected.join(realised.select("symbol", "ts", "realized_return"), ["symbol", "ts"])
    gross = F.col("trade_direction") * F.col("realized_return")
    return df.withColumns({"gross_return": gross, "net_return": gross - cost})


def daily_pnl(trades: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    return trades.groupBy(*by, "trade_day").agg(F.sum("net_return").alias("daily_pnl"), F.count(F.lit(1)).alias("trades"))


def return_metrics(trades: DataFrame) -> DataFrame:
    """One row: counts, win rate, mean and median, Sharpe, Sortino and additive drawdown of daily pnl.

    Days are few, so their order statistics run on the daily table.
    """
    daily = daily_pnl(trades)
    w = Window.partitionBy(F.lit(0)).orderBy("trade_day").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_e", F.sum("daily_pnl").over(w)).withColumn("_dd", F.col("_e") - F.max("_e").over(w))
    neg = F.when(F.col("daily_pnl") < 0, F.col("daily_pnl"))
    zero = F.lit(0.0)
    d = curve.agg(
        F.avg("daily_pnl").alias("avg_daily_pnl"),
        F.coalesce(div(F.avg("daily_pnl"), F.stddev_pop("daily_pnl")) * YEAR, zero).alias("sharpe"),
        F.coalesce(div(F.avg("daily_pnl"), F.stddev_pop(neg)) * YEAR, zero).alias("sortino"), F.min("_dd").alias("max_drawdown"))
    t = trades.agg(
        F.count(F.lit(1)).alias("total_trades"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"),
        F.avg("net_return").alias("avg_return"))
    return attach_one_row(attach_one_row(t, exact_percentiles(trades, [], "net_return", {"median_return": 0.5})), d)


def direction_precision(df: DataFrame, prob: str, direction: int, per_day: int) -> DataFrame:
    """Precision among the k most probable rows, k = days * per_day: hit rate, base rate, lift, lowest probability."""
    days = df.agg(F.countDistinct(idiv(F.col("ts"), DAY_NS)).alias("days"), F.count(F.lit(1)).alias("n"),
                  F.avg((F.col("label") == direction).cast("double")).alias("base_rate"))
    # k is a global count, so the cut is an order statistic plus the ties at the cut, not a full sort.
    sized = days.select("days", "n", "base_rate", F.greatest(F.lit(1), F.least(F.col("n"), F.col("days") * per_day)).alias("k"))
    k = sized.first()["k"]
    cut = order_statistics(df, [], prob, {"min_prob": lambda total: (total - F.lit(k)).cast("double")})
    tagged = attach_one_row(df, cut)
    hit = (F.col("label") == direction).cast("long")
    above, at = F.col(prob) > F.col("min_prob"), F.col(prob) == F.col("min_prob")
    # Ties at the cut enter by (ts, symbol); only they are ranked.
    ties = tagged.where(at).select("ts", "symbol", hit.alias("h"))
    n_above = tagged.agg(F.sum(above.cast("long")).alias("a"), F.sum(F.when(above, hit)).alias("ah"), F.max("min_prob").alias("min_prob"))
    room = k - n_above.first()["a"]
    chosen = ties.orderBy("ts", "symbol").limit(room).agg(F.coalesce(F.sum("h"), F.lit(0)).alias("th"))
    out = attach_one_row(attach_one_row(sized, n_above), chosen)
    rate = (F.coalesce(F.col("ah"), F.lit(0)) + F.col("th")) / F.col("k")
    return out.select(F.lit(direction).alias("direction"), "days", "k", "base_rate", rate.alias("hit_rate"),
                      div(rate, F.col("base_rate")).alias("lift"), "min_prob")


# --- return distributions per policy -----------------------------------------------------------------------


def tail_risk(trades: DataFrame, key: str = "policy_id", ret: str = "return_pct") -> DataFrame:
    """Value at risk as order statistic, mean of the tail, skewness and kurtosis with the sample deviation."""
    at = lambda c: (lambda total: F.floor(total * F.lit(round(1 - c, 10))).cast("double"))
    var = order_statistics(trades, [key], ret, {"var_95": at(0.95), "var_99": at(0.99)})
    m = trades.groupBy(key).agg(F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), F.count(F.lit(1)).alias("trades"))
    # One row per policy on the right.
    j = trades.join(var.join(m, key), key)
    z = div(F.col(ret) - F.col("_m"), F.col("_s"))
    return j.groupBy(key).agg(
        F.max("trades").alias("trades"), F.max("_s").alias("volatility"), F.max("var_95").alias("var_95"), F.max("var_99").alias("var_99"),
        F.avg(F.when(F.col(ret) <= F.col("var_95"), F.col(ret))).alias("cvar_95"),
        F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.avg(z * z * z), F.lit(0.0))).otherwise(0.0).alias("skewness"),
        F.when(F.count(F.lit(1)) >= 4, F.coalesce(F.avg(z * z * z * z) - 3, F.lit(0.0))).otherwise(0.0).alias("kurtosis"))


def policy_drawdown(trades: DataFrame, key: str = "policy_id", ret: str = "return_pct", order: Iterable[str] = ("ts", "order_id"),
                    max_rows: int | None = None) -> DataFrame:
    """Largest (peak - value) / peak of the running return sum; a zero peak counts as no drawdown."""
    f = split_series(trades, (key,), tuple(order), max_rows=max_rows).running({"_v": ("sum", F.col(ret))})
    f = f.running({"_p": ("max", F.col("_v"))})
    dd = F.when(F.col("_p") != 0, (F.col("_p") - F.col("_v")) / F.nullif(F.col("_p"), F.lit(0.0))).otherwise(F.lit(0.0))
    return f.finish().groupBy(key).agg(F.greatest(F.max(dd), F.lit(0.0)).alias("max_drawdown"))


def policy_performance(trades: DataFrame, key: str = "policy_id") -> DataFrame:
    """Pnl and return summary per policy (or policy and regime)."""
    by = [key] if isinstance(key, str) else list(key)
    g = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("avg_win"), F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("avg_loss"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("_w"), F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("_l"),
        F.avg("return_pct").alias("avg_return"), F.stddev_samp("return_pct").alias("_s"))
    return g.withColumns({
        "profit_factor": div(F.col("_w"), F.abs("_l")), "sharpe": div(F.col("avg_return") * 252, F.col("_s") * YEAR)}).drop("_w", "_l", "_s")


def bounded(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def rank_policies(perf: DataFrame, key: str = "policy_id") -> DataFrame:
    """Composite score 0.4 success + 0.3 Sharpe + 0.2 win rate + 0.1 return, ranked (one row per policy)."""
    score = (F.col("success_rate") * 0.4 + bounded(F.col("sharpe"), 0, 2) / 2.0 * 0.3 + bounded(F.col("win_rate"), 0, 1) * 0.2
             + bounded(F.col("avg_return") * 100, -1, 1) * 0.1)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), key)
    return perf.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def threshold_policy(train: DataFrame, val: DataFrame, per_day: float, min_gap: float, target_r: float, cost_bps: float) -> DataFrame:
    """Probability thresholds that give ``per_day`` trades on the training fold, judged on the validation fold.

    ``train`` and ``val`` carry ``fold``; the thresholds are the k-th largest probabilities per fold.  ``train`` is read several times: rows that are
    costly to derive should be stored first.
    """
    day = idiv(F.col("ts"), DAY_NS)
    days = train.groupBy("fold").agg(F.countDistinct(day).alias("days")).collect()  # one row per fold
    k = F.lit(1)
    for row in days:
        k = F.when(F.col("fold") == row["fold"], F.lit(max(1, math.floor(row["days"] * per_day)))).otherwise(k)
    th = kth_largest(train, ["fold"], "prob_long", k, "th_long").join(kth_largest(train, ["fold"], "prob_short", k, "th_short"), "fold")
    v = val.join(F.broadcast(th), "fold")
    gap = F.abs(F.col("prob_long") - F.col("prob_short")) >= min_gap
    direction = F.when((F.col("prob_short") >= F.col("th_short")) & gap, -1).when((F.col("prob_long") >= F.col("th_long")) & gap, 1).otherwise(0)
    v = v.withColumn("_dir", direction)
    traded = F.col("_dir") != 0
    c = cost_bps / 10000.0
    r = F.when(traded, F.when(F.col("_dir") == F.col("label"), target_r - c).otherwise(-(1.0 + c)))
    g = v.groupBy("fold").agg(
        F.max("th_long").alias("prob_long"), F.max("th_short").alias("prob_short"), F.count(r).alias("trades"),
        (F.count(r) / F.greatest(F.countDistinct(day), F.lit(1))).alias("trades_per_day"),
        F.avg(F.when(traded, (F.col("_dir") == F.col("label")).cast("double"))).alias("win_rate"), F.avg(r).alias("avg_r"), F.stddev_pop(r).alias("_sd"))
    return g.withColumn("sharpe_proxy", F.when(F.col("_sd") > 1e-9, F.col("avg_r") / F.col("_sd"))).drop("_sd")
