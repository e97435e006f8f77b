"""Round trips, evaluation, equity and experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mathcols import pct_change
from ..functions.probability import score_predictions
from ..functions.timecols import to_ns
from ..operators import equity, experiments, regime, trades
from ..operators.series import split_series, stored
from . import query
from .data import BARS_E, bars_e, fixed, sql, table
from .labelling import CFG, PREDS, first_hit_sql, predictions

FILLS = """fl AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderpriority AS run_id, epoch_us(o_orderdate) * 1000 AS ts, o_orderkey AS order_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, floor(o_totalprice) % 3000 + 100 AS price, CAST(1 + o_orderkey % 3 AS BIGINT) AS quantity, 1.0::DOUBLE AS commission FROM orders)"""


def fills(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderpriority").alias("run_id"), to_ns("o_orderdate").alias("ts"), k.alias("order_id"),
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.floor("o_totalprice").cast("double") % 3000.0 + 100.0).alias("price"),
        (F.lit(1) + k % 3).alias("quantity"), F.lit(1.0).alias("commission"))


def trips_sql(key: str) -> str:
    return FILLS + f""",
st AS (SELECT *, list_reduce(list_concat([0], list(CASE WHEN side = 'BUY' THEN 1 ELSE 2 END) OVER (PARTITION BY {key} ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING)),
  lambda s, x: CASE WHEN s = 0 THEN x WHEN s = x THEN x ELSE 0 END) AS state FROM fl),
pv AS (SELECT *, lag(state) OVER w AS ps, lag(side) OVER w AS pside, lag(ts) OVER w AS pts, lag(price) OVER w AS pprice, lag(quantity) OVER w AS pq, lag(commission) OVER w AS pc, lag(order_id) OVER w AS poid
  FROM st WINDOW w AS (PARTITION BY {key} ORDER BY ts, order_id)),
rt AS (SELECT {key}, CASE WHEN pside = 'BUY' THEN 'LONG' ELSE 'SHORT' END AS direction, pts AS entry_ts, ts AS exit_ts, pprice AS entry_price, price AS exit_price, least(pq, quantity) AS qty,
  (price - pprice) * CASE WHEN pside = 'BUY' THEN 1 ELSE -1 END * least(pq, quantity) AS gross_pnl, pc + commission AS fees, (price - pprice) * CASE WHEN pside = 'BUY' THEN 1 ELSE -1 END * least(pq, quantity) - pc - commission AS net_pnl,
  (ts - pts) / 60000000000.0::DOUBLE AS duration_minutes, poid AS entry_order_id, order_id AS exit_order_id FROM pv WHERE ps > 0 AND state = 0)"""


@query("m03_round_trips", sql(trips_sql("symbol"), "", "SELECT * FROM rt"))
def round_trips(spark, sf):
    return fixed(trades.round_trips(fills(spark, sf)))


@query("m15_round_trips_per_run", sql(trips_sql("run_id"), "", "SELECT run_id, direction, count(*) AS trades, CAST(sum(qty) AS BIGINT) AS qty, sum(gross_pnl) AS gross_pnl FROM rt GROUP BY 1, 2"))
def run_trips(spark, sf):
    t = trades.round_trips(fills(spark, sf), ("run_id",))
    return t.groupBy("run_id", "direction").agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").alias("qty"), F.sum("gross_pnl").alias("gross_pnl"))


@query("m04_pairing_metrics", sql(trips_sql("run_id"), "total_pnl win_rate avg_r trades_per_day avg_duration_minutes", """SELECT run_id, n AS trades, fees_total, gross - fees_total AS total_pnl, win_rate, (gross - fees_total) / n AS avg_r,
  n / CAST(days AS DOUBLE) AS trades_per_day, avg_duration_minutes FROM (SELECT run_id, count(*) AS n, sum(gross_pnl) AS gross, avg(CASE WHEN gross_pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(duration_minutes) AS avg_duration_minutes FROM rt GROUP BY 1)
  JOIN (SELECT run_id, sum(commission) AS fees_total, count(DISTINCT ts // 86400000000000) AS days FROM fl GROUP BY 1) USING (run_id)"""))
def pairing(spark, sf):
    return fixed(trades.pairing_metrics(fills(spark, sf)))


AVG_COST = FILLS + """,
ac AS (SELECT *, list_reduce(list_concat([{'p': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'b': 0, 'q': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'pnl': NULL::DOUBLE, 'sq': NULL::DOUBLE}],
  list({'p': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'b': CASE WHEN side = 'BUY' THEN 1 ELSE 0 END, 'q': quantity::DOUBLE, 'v': price * quantity, 'pnl': NULL::DOUBLE, 'sq': NULL::DOUBLE}) OVER (PARTITION BY symbol ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING)),
  lambda s, x: CASE WHEN x.b = 1 THEN {'p': s.p + x.q, 'c': s.c + x.v, 'b': 1, 'q': x.q, 'v': x.v, 'pnl': NULL::DOUBLE, 'sq': NULL::DOUBLE}
  WHEN s.p > 0 THEN {'p': s.p - least(x.q, s.p), 'c': s.c - s.c / s.p * least(x.q, s.p), 'b': 0, 'q': x.q, 'v': x.v, 'pnl': x.v - s.c / s.p * least(x.q, s.p), 'sq': least(x.q, s.p)}
  ELSE {'p': s.p, 'c': s.c, 'b': 0, 'q': x.q, 'v': x.v, 'pnl': NULL::DOUBLE, 'sq': NULL::DOUBLE} END) AS s FROM fl),
sales AS (SELECT symbol, ts, order_id, s.sq AS quantity, s.pnl AS pnl FROM ac WHERE s.sq IS NOT NULL)"""


def sales(spark, sf):
    return trades.average_cost_trips(fills(spark, sf).withColumn("total_cost", F.col("price") * F.col("quantity")))


@query("m05_average_cost_trips", sql(AVG_COST, "quantity pnl", "SELECT * FROM sales"))
def average_cost(spark, sf):
    return fixed(sales(spark, sf))


STATS = """count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) AS avg_trade_pnl,
  sum(pnl) AS total_pnl, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss, max(pnl) FILTER (pnl > 0) AS largest_win, min(pnl) FILTER (pnl < 0) AS largest_loss,
  sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor"""
TRADES = """tr AS (SELECT o_orderpriority AS run_id, o_orderstatus AS regime, CAST(o_custkey AS VARCHAR) AS symbol, epoch_us(o_orderdate) * 1000 AS ts, o_orderkey AS order_id,
  floor(o_totalprice * 100) % 20001 - 9000 AS pnl, (floor(o_totalprice * 100) % 20001 - 9000) / 100000.0::DOUBLE AS return_pct, (floor(o_totalprice * 100) % 20001 - 9000) / 1000.0::DOUBLE AS r_multiple FROM orders)"""


def trade_rows(spark, sf):
    p = (F.floor(F.col("o_totalprice") * 100).cast("double") % 20001.0) - 9000.0
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("regime"), F.col("o_custkey").cast("string").alias("symbol"),
        to_ns("o_orderdate").alias("ts"), F.col("o_orderkey").alias("order_id"), p.alias("pnl"), (p / 100000.0).alias("return_pct"), (p / 1000.0).alias("r_multiple"))


@query("m05_m11_trade_statistics", sql(TRADES, "win_rate avg_trade_pnl avg_win avg_loss profit_factor", f"SELECT run_id, {STATS} FROM tr GROUP BY 1"))
def statistics(spark, sf):
    return fixed(trades.trade_statistics(trade_rows(spark, sf), ["run_id"]))


EVAL = PREDS + """, fr AS (SELECT symbol, ts, (lead(close, 2) OVER (PARTITION BY symbol ORDER BY ts) - close) / close AS rr FROM bars),
sp AS (SELECT *, greatest(prob_long, prob_short) AS tp, CASE WHEN greatest(prob_long, prob_short) <= 0 THEN 0 WHEN prob_long >= prob_short THEN 1 ELSE -1 END AS dir, greatest(prob_long, prob_short) - greatest(prob_neutral, 0) AS em FROM preds),
sl AS (SELECT *, row_number() OVER (PARTITION BY ts // 86400000000000 ORDER BY tp * em DESC, ts, symbol) AS rk FROM sp WHERE tp >= 0.3 QUALIFY rk <= 10),
ev AS (SELECT sl.symbol, sl.ts, sl.ts // 86400000000000 AS trade_day, rk AS rank_within_day, dir * rr AS gross_return, dir * rr - 0.001::DOUBLE AS net_return FROM sl JOIN fr ON sl.symbol = fr.symbol AND sl.ts = fr.ts WHERE rr IS NOT NULL)"""


def evaluated(spark, sf):
    b = bars_e(spark, sf)
    f = split_series(b, lookahead=2)
    realised = f.with_cols(realized_return=pct_change(f.lead("close", 2), F.col("close"))).finish().where("realized_return is not null")
    sel = trades.select_trades(score_predictions(predictions(b)), trades.Selection(top_k=10, min_prob=0.3))
    return trades.trade_returns(sel, realised, 0.001)


@query("f07_m01_selected_trades", sql(BARS_E + ",\n" + EVAL, "gross_return net_return", "SELECT * FROM ev"))
def selected(spark, sf):
    return fixed(evaluated(spark, sf).select("symbol", "ts", "trade_day", "rank_within_day", "gross_return", "net_return"))


@query("m01_daily_pnl", sql(BARS_E + ",\n" + EVAL, "daily_pnl", "SELECT trade_day, sum(net_return) AS daily_pnl, count(*) AS trades FROM ev GROUP BY 1"))
def daily(spark, sf):
    return fixed(trades.daily_pnl(evaluated(spark, sf)))


@query("m02_return_metrics", sql(BARS_E + ",\n" + EVAL, "win_rate avg_return median_return avg_daily_pnl sharpe sortino max_drawdown", """SELECT total_trades, win_rate, avg_return, median_return, avg_daily_pnl, sharpe, sortino, max_drawdown FROM
  (SELECT count(*) AS total_trades, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(net_return) AS avg_return, quantile_cont(net_return, 0.5) AS median_return FROM ev) a,
  (SELECT avg(p) AS avg_daily_pnl, coalesce(avg(p) / nullif(stddev_pop(p), 0) * sqrt(252), 0) AS sharpe, coalesce(avg(p) / nullif(stddev_pop(p) FILTER (p < 0), 0) * sqrt(252), 0) AS sortino, min(e - m) AS max_drawdown FROM
  (SELECT p, e, max(e) OVER (ORDER BY d) AS m FROM (SELECT trade_day AS d, sum(net_return) AS p, sum(sum(net_return)) OVER (ORDER BY trade_day) AS e FROM ev GROUP BY 1))) b"""))
def metrics(spark, sf):
    return fixed(trades.return_metrics(evaluated(spark, sf)))


def labelled(spark, sf):
    """Predictions with their labels, stored: both sides of the join read the bars, and every pass that looks for a threshold reads the rows."""
    from ..operators.labels import first_hit_labels

    b = stored(bars_e(spark, sf))
    return stored(predictions(b).join(first_hit_labels(b, CFG).select("symbol", "ts", "label"), ["symbol", "ts"])
                  .select("symbol", "ts", "prob_long", "prob_short", "label"))


@query("f08_direction_precision", sql(BARS_E + ",\n" + PREDS + ",\n" + first_hit_sql("0.9", "0.9"), "base_rate hit_rate lift min_prob", """SELECT CAST(1 AS BIGINT) AS direction, days, k, base AS base_rate, hit AS hit_rate, hit / base AS lift, min_prob FROM (
  SELECT any_value(days) AS days, any_value(k) AS k, any_value(base) AS base, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS hit, min(prob_long) AS min_prob FROM (SELECT *, row_number() OVER (ORDER BY prob_long DESC, ts, symbol) AS rn FROM
  (SELECT p.symbol, p.ts, prob_long, label, (SELECT count(DISTINCT ts // 86400000000000) FROM preds) AS days, 3 * (SELECT count(DISTINCT ts // 86400000000000) FROM preds) AS k, (SELECT avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) FROM lab) AS base
  FROM preds p JOIN lab USING (symbol, ts))) WHERE rn <= k)"""))
def precision(spark, sf):
    return fixed(trades.direction_precision(labelled(spark, sf), "prob_long", 1, 3))


@query("m12_tail_risk", sql(TRADES, "volatility var_95 var_99 cvar_95 skewness kurtosis", """SELECT policy_id, trades, volatility, var_95, var_99, avg(r) FILTER (r <= var_95) AS cvar_95, avg(power((r - m) / volatility, 3)) AS skewness, avg(power((r - m) / volatility, 4)) - 3 AS kurtosis FROM
  (SELECT run_id AS policy_id, return_pct AS r, count(*) OVER w AS trades, stddev_samp(return_pct) OVER w AS volatility, avg(return_pct) OVER w AS m FROM tr WINDOW w AS (PARTITION BY run_id)) JOIN
  (SELECT run_id AS policy_id, l[CAST(floor(len(l) * 0.05) AS INT) + 1] AS var_95, l[CAST(floor(len(l) * 0.01) AS INT) + 1] AS var_99 FROM (SELECT run_id, list_sort(list(return_pct)) AS l FROM tr GROUP BY 1)) USING (policy_id) GROUP BY ALL"""))
def tail(spark, sf):
    return fixed(trades.tail_risk(trade_rows(spark, sf).withColumnRenamed("run_id", "policy_id")))


@query("m12_policy_drawdown", sql(TRADES, "max_drawdown", """SELECT policy_id, greatest(max(CASE WHEN p <> 0 THEN (p - v) / p ELSE 0 END), 0) AS max_drawdown FROM (SELECT policy_id, v, max(v) OVER (PARTITION BY policy_id ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING) AS p FROM
  (SELECT run_id AS policy_id, ts, order_id, sum(r_multiple * 1000) OVER (PARTITION BY run_id ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING) AS v FROM tr)) GROUP BY 1"""))
def drawdown(spark, sf):
    return fixed(trades.policy_drawdown(trade_rows(spark, sf).withColumnRenamed("run_id", "policy_id"), ret="pnl"))


PERF = TRADES + """, pf AS (SELECT run_id AS policy_id, count(*) AS trades, sum(pnl) AS total_pnl, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss,
  avg(return_pct) AS avg_return, sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor, avg(return_pct) * 252 / (stddev_samp(return_pct) * sqrt(252)) AS sharpe FROM tr GROUP BY 1)"""
PERF_COLS = "win_rate avg_win avg_loss avg_return profit_factor sharpe"


@query("m12_policy_performance", sql(PERF, PERF_COLS, "SELECT * FROM pf"))
def performance(spark, sf):
    return fixed(trades.policy_performance(trade_rows(spark, sf).withColumnRenamed("run_id", "policy_id")))


@query("m13_policy_ranking", sql(PERF, "score", """SELECT policy_id, score, row_number() OVER (ORDER BY score DESC, policy_id) AS rank FROM (SELECT policy_id, 0.4 * win_rate + 0.3 * least(greatest(sharpe, 0), 2) / 2 + 0.2 * least(greatest(win_rate, 0), 1)
  + 0.1 * least(greatest(avg_return * 100, -1), 1) AS score FROM pf)"""))
def ranking(spark, sf):
    p = trades.policy_performance(trade_rows(spark, sf).withColumnRenamed("run_id", "policy_id")).withColumn("success_rate", F.col("win_rate"))
    return fixed(trades.rank_policies(p).select("policy_id", "score", "rank"))


@query("f09_n11_threshold_policy", sql(BARS_E + ",\n" + PREDS + ",\n" + first_hit_sql("0.9", "0.9"), "prob_long prob_short trades_per_day win_rate avg_r sharpe_proxy", """SELECT fold, tl AS prob_long, th AS prob_short, count(r) AS trades, count(r) / CAST(greatest(count(DISTINCT d), 1) AS DOUBLE) AS trades_per_day, avg(win) AS win_rate, avg(r) AS avg_r,
  CASE WHEN stddev_pop(r) > 1e-9 THEN avg(r) / stddev_pop(r) END AS sharpe_proxy FROM (SELECT *, CASE WHEN dir <> 0 THEN CASE WHEN dir = label THEN 1.0 ELSE 0.0 END END AS win, CASE WHEN dir <> 0 THEN CASE WHEN dir = label THEN 1.5::DOUBLE - 0.0005::DOUBLE ELSE -(1.0::DOUBLE + 0.0005::DOUBLE) END END AS r FROM (
  SELECT f.fold, v.ts // 86400000000000 AS d, v.label, tl, th, CASE WHEN abs(prob_long - prob_short) >= 0.05 AND prob_short >= th THEN -1 WHEN abs(prob_long - prob_short) >= 0.05 AND prob_long >= tl THEN 1 ELSE 0 END AS dir
  FROM (SELECT p.symbol, p.ts, prob_long, prob_short, label FROM preds p JOIN lab USING (symbol, ts)) v JOIN (SELECT fold, vf, vt, list_reverse_sort(pl)[k] AS tl, list_reverse_sort(ps)[k] AS th FROM (
  SELECT fold, vf, vt, list(prob_long) AS pl, list(prob_short) AS ps, greatest(1, CAST(floor(count(DISTINCT ts // 86400000000000) * 4.0) AS INT)) AS k FROM preds JOIN (VALUES (1, 19723, 19732, 19733, 19739), (2, 19723, 19739, 19740, 19752)) g(fold, tf, tt, vf, vt)
  ON ts // 86400000000000 BETWEEN tf AND tt GROUP BY 1, 2, 3)) f ON v.ts // 86400000000000 BETWEEN f.vf AND f.vt)) GROUP BY 1, 2, 3""")
  .replace("SELECT fold, tl", "SELECT CAST(fold AS BIGINT) AS fold, tl"))
def threshold_policy(spark, sf):
    from ..operators.datasets import fold_rows

    df = labelled(spark, sf)
    folds = [{"fold": 1, "train_from": 19723, "train_to": 19732, "val_from": 19733, "val_to": 19739},
             {"fold": 2, "train_from": 19723, "train_to": 19739, "val_from": 19740, "val_to": 19752}]
    rows = fold_rows(df, folds)
    return fixed(trades.threshold_policy(rows.where("role = 'train'"), rows.where("role = 'val'"), 4.0, 0.05, 1.5, 5.0))


# --- equity ------------------------------------------------------------------------------------------------

EQUITY = TRADES + """, eq AS (SELECT run_id, ts, 1e8 + sum(p) OVER (PARTITION BY run_id ORDER BY ts) AS equity FROM (SELECT run_id, ts, sum(pnl) * 100 AS p FROM tr GROUP BY 1, 2)),
dd AS (SELECT *, (equity - peak) / peak AS drawdown, lag(equity) OVER (PARTITION BY run_id ORDER BY ts) AS pe, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS rn FROM (SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY ts) AS peak FROM eq)),
dl AS (SELECT *, rn - coalesce(max(CASE WHEN drawdown < 0 THEN NULL ELSE rn END) OVER (PARTITION BY run_id ORDER BY ts), 0) AS drawdown_length FROM dd),
em AS (SELECT *, total_return + 1 AS g, (annualized_return - 0.02) / nullif(volatility, 0) AS sharpe FROM (SELECT run_id, arg_min(equity, ts) AS initial_equity, arg_max(equity, ts) AS final_equity, count(*) AS bars, min(drawdown) AS max_drawdown, max(drawdown_length) AS max_drawdown_duration,
  arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, power(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1 AS annualized_return, stddev_samp((equity - pe) / pe) * sqrt(252) AS volatility FROM dl GROUP BY 1))"""


def curve(spark, sf):
    d = trade_rows(spark, sf).groupBy("run_id", "ts").agg((F.sum("pnl") * 100).alias("p"))
    f = split_series(d, ["run_id"]).running({"_c": ("sum", F.col("p"))})
    return f.finish().select("run_id", "ts", (F.lit(1e8) + F.col("_c")).alias("equity"))


@query("e45_e46_drawdown_table", sql(EQUITY, "drawdown", "SELECT run_id, ts, equity, peak, drawdown, drawdown_length FROM dl"))
def drawdowns(spark, sf):
    return fixed(equity.drawdown_table(curve(spark, sf)))


EM = "run_id, initial_equity, final_equity, bars, max_drawdown, max_drawdown_duration, total_return, annualized_return, volatility, sharpe"


@query("m06_equity_metrics", sql(EQUITY, "max_drawdown total_return annualized_return volatility sharpe", f"SELECT {EM} FROM em"))
def equity_metrics(spark, sf):
    return fixed(equity.equity_metrics(curve(spark, sf)))


SUMMARY = EQUITY + f""", sm AS (SELECT run_id, trade_count, avg_trade_pnl, win_rate, total_pnl, median_r_multiple, {EM.replace('run_id, ', '')} FROM (SELECT run_id, count(*) AS trade_count, avg(pnl) AS avg_trade_pnl, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  sum(pnl) AS total_pnl, quantile_cont(r_multiple, 0.5) AS median_r_multiple FROM tr GROUP BY 1) JOIN em USING (run_id)),
lg AS (UNPIVOT (SELECT run_id, total_return, sharpe, max_drawdown, win_rate FROM sm) ON total_return, sharpe, max_drawdown, win_rate INTO NAME metric VALUE value)"""
METRICS = ["total_return", "sharpe", "max_drawdown", "win_rate"]
RUNS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def summary(spark, sf):
    return experiments.run_summary(trade_rows(spark, sf), curve(spark, sf))


@query("m07_run_summary", sql(SUMMARY, "avg_trade_pnl win_rate median_r_multiple max_drawdown total_return annualized_return volatility sharpe", "SELECT * FROM sm"))
def run_summary(spark, sf):
    return fixed(summary(spark, sf))


@query("m08_comparison_table", sql(SUMMARY, " ".join(f'"{r}"' for r in RUNS if " " not in r), "SELECT metric, " + ", ".join(
    f"max(value) FILTER (run_id = '{r}') AS \"{r}\"" for r in RUNS if " " not in r) + " FROM lg GROUP BY 1"))
def comparison(spark, sf):
    return fixed(experiments.comparison_table(summary(spark, sf), "run_id", METRICS, [r for r in RUNS if " " not in r]))


@query("m08_baseline_difference", sql(SUMMARY, "value difference pct_difference", """SELECT l.run_id, l.metric, l.value, CASE WHEN l.run_id = '1-URGENT' THEN 0.0 ELSE l.value - b.value END AS difference,
  CASE WHEN l.run_id = '1-URGENT' THEN 0.0 ELSE l.value / b.value - 1 END AS pct_difference FROM lg l JOIN lg b ON l.metric = b.metric AND b.run_id = '1-URGENT'"""))
def differences(spark, sf):
    return fixed(experiments.baseline_difference(summary(spark, sf), "run_id", METRICS, "1-URGENT"))


@query("f10_leaderboard", sql(SUMMARY, "sharpe", "SELECT run_id, sharpe, row_number() OVER (ORDER BY sharpe DESC, run_id) AS rank, row_number() OVER (ORDER BY sharpe DESC, run_id) = 1 AS winner FROM sm"))
def leaderboard(spark, sf):
    return fixed(experiments.leaderboard(summary(spark, sf).select("run_id", "sharpe"), "run_id", "sharpe"))


@query("f11_variant_ranking", sql(SUMMARY, "score", "SELECT run_id, score, rank() OVER (ORDER BY score DESC) AS rank FROM (SELECT run_id, 0.3 * total_return + 0.3 * sharpe - 0.2 * max_drawdown + 0.2 * win_rate AS score FROM sm)"))
def variants(spark, sf):
    return fixed(experiments.variant_ranking(summary(spark, sf)).select("run_id", "score", "rank"))


@query("m10_significance", sql(SUMMARY, "best_value worst_value improvement_pct", """SELECT metric, max(value) AS best_value, min(value) AS worst_value, arg_max(run_id, value) AS best_variant, arg_min(run_id, value) AS worst_variant,
  (max(value) - min(value)) / abs(min(value)) * 100 AS improvement_pct FROM lg GROUP BY 1 HAVING max(value) > 0 AND max(value) <> min(value)"""))
def significance(spark, sf):
    return fixed(experiments.significance(summary(spark, sf), "run_id", METRICS))


@query("d21_run_statistics", sql(SUMMARY, "mean median max min std", """SELECT metric, count(*) AS runs, avg(value) AS mean, quantile_cont(value, 0.5) AS median, max(value) AS max, min(value) AS min, stddev_samp(value) AS std,
  count(*) FILTER (value > 0) AS positive_runs FROM lg GROUP BY 1""".replace("AS max,", 'AS "max",').replace("AS min,", 'AS "min",')).replace("max AS max", '"max" AS "max"'))
def run_statistics(spark, sf):
    return fixed(experiments.run_statistics(summary(spark, sf).select("run_id", *METRICS), METRICS))


@query("m14_extreme_runs", sql(SUMMARY, "", """SELECT 'best' AS kind, rank, run_id FROM (SELECT run_id, row_number() OVER (ORDER BY total_return DESC, run_id) AS rank FROM sm) WHERE rank <= 2 UNION ALL
  SELECT 'worst', rank, run_id FROM (SELECT run_id, row_number() OVER (ORDER BY total_return, run_id) AS rank FROM sm) WHERE rank <= 2 UNION ALL
  SELECT 'most_active', rank, run_id FROM (SELECT run_id, row_number() OVER (ORDER BY trade_count DESC, run_id) AS rank FROM sm) WHERE rank <= 2"""))
def extremes(spark, sf):
    return fixed(experiments.extreme_runs(summary(spark, sf), "run_id", "total_return", "trade_count", 2))


HASHED = TRADES + """, rh AS (SELECT run_id || '-' || regime AS run, regime AS experiment, CAST(count(*) % 3 AS VARCHAR) AS bars_hash, regime AS features_hash, CAST(sum(order_id) % 5 AS BIGINT) AS seed, count(*) AS trades FROM tr GROUP BY run_id, regime)"""


def hashed(spark, sf):
    g = trade_rows(spark, sf).groupBy("run_id", "regime").agg(F.count(F.lit(1)).alias("trades"), (F.sum("order_id") % 5).alias("seed"))
    return g.select(F.concat_ws("-", "run_id", "regime").alias("run"), F.col("regime").alias("experiment"), (F.col("trades") % 3).cast("string").alias("bars_hash"),
                    F.col("regime").alias("features_hash"), "seed", "trades")


@query("d22_hash_statistics", sql(HASHED, "", "SELECT bars_hash, features_hash, count(*) AS runs, count(DISTINCT seed) AS seeds FROM rh GROUP BY 1, 2"))
def hash_statistics(spark, sf):
    return experiments.hash_statistics(hashed(spark, sf), ["bars_hash", "features_hash"])


@query("m09_fairness", sql(HASHED, "", """SELECT experiment, count(*) AS runs, NOT (count(*) < 2 OR count(DISTINCT bars_hash) > 1 OR count(DISTINCT features_hash) > 1) AS is_fair,
  array_to_string(list_filter([CASE WHEN count(*) < 2 THEN 'insufficient_variants' END, CASE WHEN count(DISTINCT bars_hash) > 1 THEN 'mismatch_bars_hash' END, CASE WHEN count(DISTINCT features_hash) > 1 THEN 'mismatch_features_hash' END], lambda x: x IS NOT NULL), ',') AS violations,
  array_to_string(list_filter([CASE WHEN count(DISTINCT trades) = 1 AND max(trades) > 0 AND count(*) > 1 THEN 'identical_trade_counts_across_variants' END, CASE WHEN max(trades) > 10 * min(trades) THEN 'extreme_trade_count_difference' END], lambda x: x IS NOT NULL), ',') AS warnings
  FROM rh GROUP BY 1"""))
def fairness(spark, sf):
    f = experiments.fairness(hashed(spark, sf), "run", "experiment", ["bars_hash", "features_hash"], "trades")
    return f.withColumns({"violations": F.concat_ws(",", "violations"), "warnings": F.concat_ws(",", "warnings")})


SWEEP = """sw AS (SELECT CAST(l_discount * 100 AS INT) / 100.0::DOUBLE AS slippage, CAST(l_tax * 100 AS INT) / 100.0::DOUBLE AS commission, avg(l_extendedprice / l_quantity) AS sharpe, avg(l_quantity) AS trades FROM lineitem GROUP BY 1, 2)"""


def sweep(spark, sf):
    r = lambda c: F.round(F.col(c) * 100).cast("int") / 100.0
    return table(spark, sf, "lineitem").groupBy(r("l_discount").alias("slippage"), r("l_tax").alias("commission")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("sharpe"), F.avg("l_quantity").alias("trades"))


@query("d23_d24_sweep_summary", sql(SWEEP, "low high mean std best_slippage corr_slippage slope_slippage best_commission corr_commission slope_commission corr_sharpe_trades", """SELECT count(*) AS combinations, min(sharpe) AS low, max(sharpe) AS high, avg(sharpe) AS mean,
  stddev_samp(sharpe) AS std, arg_max(slippage, sharpe) AS best_slippage, corr(sharpe, slippage) AS corr_slippage, regr_slope(sharpe, slippage) AS slope_slippage, arg_max(commission, sharpe) AS best_commission, corr(sharpe, commission) AS corr_commission,
  regr_slope(sharpe, commission) AS slope_commission, corr(sharpe, trades) AS corr_sharpe_trades FROM sw"""))
def sweep_summary(spark, sf):
    return fixed(experiments.sweep_summary(sweep(spark, sf), "sharpe", ["slippage", "commission"], ["sharpe", "trades"]))


@query("d24_cost_impact", sql(SWEEP, "mean_metric correlation", "SELECT slippage, m AS mean_metric, corr(slippage, m) OVER () AS correlation FROM (SELECT slippage, avg(sharpe) AS m FROM sw GROUP BY 1)"))
def cost_impact(spark, sf):
    return fixed(experiments.cost_impact(sweep(spark, sf), "sharpe", "slippage"))


@query("d17_value_counts", sql("", "", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority"))))
def counts(spark, sf):
    return experiments.value_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("l12_fold_aggregate", sql(TRADES, "mean std min max slope stability".replace("min max", '"min" "max"'), """SELECT metric, count(*) AS folds, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS "min", max(value) AS "max", regr_slope(value, fold) AS slope, 1 / (1 + stddev_pop(value)) AS stability
  FROM (SELECT run_id AS metric, CAST(ts // 31536000000000000 AS DOUBLE) AS fold, avg(pnl) AS value FROM tr GROUP BY 1, 2) GROUP BY 1"""))
def folds(spark, sf):
    from ..functions.timecols import idiv

    t = trade_rows(spark, sf).groupBy(F.col("run_id").alias("metric"), idiv(F.col("ts"), 31_536_000_000_000_000).alias("fold")).agg(F.avg("pnl").alias("value"))
    return fixed(experiments.fold_aggregate(t))


@query("i16_regime_comparison", sql(TRADES, "total_return_change sharpe_change max_drawdown_change trades_change", """SELECT a.run, a.tr - b.tr AS total_return_change, a.sh - b.sh AS sharpe_change, a.md - b.md AS max_drawdown_change, a.n - b.n AS trades_change FROM
  (SELECT run_id AS run, sum(return_pct) AS tr, avg(return_pct) / stddev_samp(return_pct) AS sh, min(return_pct) AS md, CAST(count(*) AS DOUBLE) AS n FROM tr WHERE regime <> 'P' GROUP BY 1) a
  JOIN (SELECT run_id AS run, sum(return_pct) AS tr, avg(return_pct) / stddev_samp(return_pct) AS sh, min(return_pct) AS md, CAST(count(*) AS DOUBLE) AS n FROM tr GROUP BY 1) b USING (run)"""))
def regime_comparison(spark, sf):
    t = trade_rows(spark, sf)

    def agg(df, on):
        return df.groupBy(F.col("run_id").alias("run")).agg(
            F.sum("return_pct").alias("total_return"), (F.avg("return_pct") / F.stddev_samp("return_pct")).alias("sharpe"), F.min("return_pct").alias("max_drawdown"),
            F.count(F.lit(1)).cast("double").alias("trades")).withColumn("regime_on", F.lit(on))

    return fixed(regime.compare_with_without(agg(t.where("regime <> 'P'"), True).unionByName(agg(t, False))))
