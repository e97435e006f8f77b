"""Labels, exits and probability expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pr
from ..functions.timecols import idiv, market_minute
from ..operators import labels
from ..operators.features_core import add_atr, core_pack
from ..operators.series import split_series
from . import query
from .core import CORE, TR, WINDOW
from .data import BAR_NS, BARS_E, BARS_L, bars_e, bars_l, fixed, mp, prior, roll, sql

CFG = labels.FirstHitConfig(horizon_minutes=240, multiplier=0.9, atr_return_max=5.0)
H = "(PARTITION BY symbol ORDER BY ts RANGE BETWEEN 1 FOLLOWING AND 14400000000000 FOLLOWING)"


def first_hit_sql(long_m: str, short_m: str, join: str = "") -> str:
    return f"""h1 AS (SELECT *, {TR} AS tr FROM bars {WINDOW}),
h2 AS (SELECT *, greatest(avg(tr) OVER {roll(14)}, 0.01) / close AS ar, list(close) OVER {H} AS ahead FROM h1),
h3 AS (SELECT h2.*, least(greatest(ar, 0.0001), 5.0) * {long_m} AS tl, least(greatest(ar, 0.0001), 5.0) * {short_m} AS tsh FROM h2 {join}),
h4 AS (SELECT *, list_filter([(p - close) / close FOR p IN ahead], lambda r: r >= tl OR r <= -tsh)[1] AS hit FROM h3),
lab AS (SELECT symbol, ts, close, tl AS threshold_long, tsh AS threshold_short, CAST(CASE WHEN hit >= tl THEN 1 WHEN hit <= -tsh THEN -1 ELSE 0 END AS BIGINT) AS label FROM h4)"""


@query("j02_first_hit_label", sql(BARS_E + ",\n" + first_hit_sql("0.9", "0.9"), "threshold_long threshold_short", "SELECT symbol, ts, threshold_long, threshold_short, label FROM lab"))
def first_hit(spark, sf):
    return fixed(labels.first_hit_labels(bars_e(spark, sf), CFG).select("symbol", "ts", "threshold_long", "threshold_short", "label"))


@query("j05_majority_label", sql(BARS_E + ",\n" + first_hit_sql("0.9", "0.9"), "", """SELECT ts, CASE WHEN count(*) = 1 THEN any_value(label) ELSE 0 END AS label, max(n) AS votes
  FROM (SELECT *, max(n) OVER (PARTITION BY ts) AS m FROM (SELECT ts, label, count(*) AS n FROM lab GROUP BY 1, 2)) WHERE n = m GROUP BY ts"""))
def majority(spark, sf):
    return fixed(labels.majority_label(labels.first_hit_labels(bars_e(spark, sf), CFG)))


VOLM = f"""vq AS (SELECT symbol, quantile_cont(close, 0.5) AS close_ref, quantile_cont(atr, 0.7) AS atr_ref FROM (SELECT symbol, close, avg(tr) OVER {roll(14)} AS atr FROM (SELECT *, {TR} AS tr FROM bars {WINDOW})) WHERE close > 0 AND atr > 0 GROUP BY 1),
vm AS (SELECT *, least(greatest(power(0.9, 0.4) * power(0.0075 * close_ref / atr_ref, 0.6), 0.0001), 0.12) AS multiplier FROM vq)"""


@query("j03_volatility_multipliers", sql(BARS_E + ",\n" + VOLM, "close_ref atr_ref multiplier", "SELECT * FROM vm"))
def multipliers(spark, sf):
    return fixed(labels.volatility_multipliers(bars_e(spark, sf), CFG))


@query("j04_balanced_multipliers")
def balanced(spark, sf):
    return fixed(labels.balance_multipliers(bars_e(spark, sf), CFG, passes=3, lo=0.1, hi=3.0))


def big_sql():
    return f"""SELECT symbol, ts, fr AS forward_return, thr AS big_move_threshold, CAST(coalesce(abs(fr) >= thr, false) AS BIGINT) AS big_move,
  CAST(CASE WHEN abs(fr) >= thr THEN sign(fr) ELSE 0 END AS BIGINT) AS direction FROM (SELECT symbol, ts, (lead(close, 5) OVER w - close) / close AS fr,
  greatest(0.8 * (avg(tr) OVER {roll(14)}) / close, 0.01) AS thr FROM (SELECT *, {TR} AS tr FROM bars {WINDOW}) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query("j06_big_move_labels", sql(BARS_L, "forward_return big_move_threshold", big_sql()))
def big_moves(spark, sf):
    f = split_series(bars_l(spark, sf), lookback=16, lookahead=5)
    f = add_atr(f, {"atr": 14})
    f = labels.big_move_labels(f, 5, "atr", 0.8, 0.01)
    return fixed(f.finish().select("symbol", "ts", "forward_return", "big_move_threshold", "big_move", "direction"))


@query("j01_forward_return", sql(BARS_L, "forward_return", "SELECT symbol, ts, forward_return FROM (SELECT symbol, ts, (lead(close, 3) OVER (PARTITION BY symbol ORDER BY ts) - close) / close AS forward_return FROM bars) WHERE forward_return IS NOT NULL"))
def forward(spark, sf):
    f = labels.forward_return(split_series(bars_l(spark, sf), lookahead=3), 3)
    return fixed(f.finish().select("symbol", "ts", "forward_return").where("forward_return is not null"))


EXITS = CORE + """,
x1 AS (SELECT *, (close - f__ta__vwap_30) / f__ta__vwap_30 AS dev, list({'t': ts, 'c': close, 'v': f__ta__vwap_30}) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 1 FOLLOWING AND 10800000000000 FOLLOWING) AS ahead FROM core),
x2 AS (SELECT *, CASE WHEN dev < 0 THEN 'LONG' ELSE 'SHORT' END AS direction, abs(dev) * 100 AS vdp, CAST(make_timestamp(ts // 1000) - INTERVAL 5 HOUR AS DATE) AS d FROM x1 WHERE dev <> 0 AND abs(dev) * 100 >= 50 AND len(ahead) > 0),
x3 AS (SELECT *, list_filter(ahead, lambda r: CASE WHEN direction = 'LONG' THEN r.c >= r.v ELSE r.c <= r.v END)[1] AS hit FROM x2 QUALIFY row_number() OVER (PARTITION BY d ORDER BY direction, ts, symbol) <= 2),
x4 AS (SELECT *, coalesce(hit, ahead[-1]) AS ex, greatest(floor(2000000.0 / close / 100) * 100, 100) AS q FROM x3),
x5 AS (SELECT *, CASE WHEN direction = 'LONG' THEN ex.c - close ELSE close - ex.c END * q AS pnl FROM x4)"""


@query("j09_vwap_exits", sql(BARS_E + ",\n" + EXITS, "pnl_pct vwap_deviation_pct", """SELECT CAST(d AS VARCHAR) AS date, symbol, direction, ts AS entry_ts, ex.t AS exit_ts, close AS entry_price, ex.c AS exit_price,
  CAST(q AS BIGINT) AS quantity, pnl, pnl / 2000000.0 * 100 AS pnl_pct, (ex.t - ts) // 60000000000 AS duration_minutes, CASE WHEN pnl > 0 THEN 'WIN' ELSE 'LOSS' END AS result,
  CASE WHEN hit IS NOT NULL THEN 'vwap_target' ELSE 'timeout' END AS exit_reason, vdp AS vwap_deviation_pct FROM x5"""))
def exits(spark, sf):
    return fixed(labels.vwap_exits(core_pack(bars_e(spark, sf)), "f__ta__vwap_30", 50.0, 180, 2, 2_000_000.0))


@query("d30_deviation_counts", sql(BARS_E + ",\n" + CORE, "", """SELECT symbol, count(*) AS bars, count(*) FILTER ((close - f__ta__vwap_30) / f__ta__vwap_30 * 100 <= -20) AS long_signals,
  count(*) FILTER ((close - f__ta__vwap_30) / f__ta__vwap_30 * 100 >= 20) AS short_signals FROM core GROUP BY 1"""))
def deviations(spark, sf):
    return labels.deviation_counts(core_pack(bars_e(spark, sf)), "f__ta__vwap_30", 20.0)


# --- predictions -----------------------------------------------------------------------------------

SLOT = "ts // 1800000000000"
PREDS = f"""preds AS (SELECT symbol, ts, close, volume, pl AS prob_long, ps AS prob_short, 1.0::DOUBLE - pl - ps AS prob_neutral FROM (SELECT *,
  (({SLOT}) * 7 + volume * 3) % 101 / 202.0::DOUBLE AS pl, (({SLOT}) * 11 + volume * 5) % 97 / 194.0::DOUBLE AS ps FROM bars))"""


def predictions(b):
    slot, v = idiv(F.col("ts"), BAR_NS), F.col("volume")
    pl = F.pmod(slot * 7 + v * 3, F.lit(101)) / F.lit(202.0)
    ps = F.pmod(slot * 11 + v * 5, F.lit(97)) / F.lit(194.0)
    return b.select("symbol", "ts", "close", "volume", pl.alias("prob_long"), ps.alias("prob_short")).withColumn(
        "prob_neutral", F.lit(1.0) - F.col("prob_long") - F.col("prob_short"))


@query("h13_score_predictions", sql(BARS_E + ",\n" + PREDS, "trade_prob edge_margin trade_score", """SELECT symbol, ts, greatest(prob_long, prob_short) AS trade_prob,
  CAST(CASE WHEN greatest(prob_long, prob_short) <= 0 THEN 0 WHEN prob_long >= prob_short THEN 1 ELSE -1 END AS BIGINT) AS trade_direction, greatest(prob_long, prob_short) - greatest(prob_neutral, 0) AS edge_margin,
  greatest(prob_long, prob_short) * (greatest(prob_long, prob_short) - greatest(prob_neutral, 0)) AS trade_score FROM preds"""))
def scores(spark, sf):
    p = predictions(bars_e(spark, sf)).withColumnsRenamed({"prob_long": "p_long", "prob_short": "p_short", "prob_neutral": "p_flat"})
    df = pr.score_predictions(pr.normalise_predictions(p))
    return fixed(df.select("symbol", "ts", "trade_prob", "trade_direction", "edge_margin", "trade_score"))


@query("h14_move_adapter", sql(BARS_E + ",\n" + PREDS, "prob_bigmove prob_long prob_short prob_neutral bigmove_expected_r", """SELECT symbol, ts, pm AS prob_bigmove, pm * cl AS prob_long, pm * cs AS prob_short,
  greatest(1.0 - pm * cl - pm * cs, 0.0) AS prob_neutral, pm >= 0.5 AS bigmove_allowed, greatest(r, 1.5) AS bigmove_expected_r FROM (SELECT symbol, ts, pm, CASE WHEN l + s > 1 THEN l / (l + s) ELSE l END AS cl,
  CASE WHEN l + s > 1 THEN s / (l + s) ELSE s END AS cs, r FROM (SELECT symbol, ts, least(prob_long * 2.5, 1.0) AS pm, least(prob_short * 2.5, 1.0) AS l, prob_long AS s, volume / 50.0 AS r FROM preds))"""))
def adapter(spark, sf):
    p = predictions(bars_e(spark, sf)).select(
        "symbol", "ts", (F.col("prob_long") * 2.5).alias("pm"), (F.col("prob_short") * 2.5).alias("l"), F.col("prob_long").alias("s"),
        (F.col("volume") / 50.0).alias("r"))
    return fixed(pr.move_adapter(p, "bigmove", 0.5, 1.5, "pm", "l", "s", "r").drop("pm", "l", "s", "r"))


@query("h15_fallback_columns", sql(BARS_E + ",\n" + PREDS, "prob_bigmove prob_bigmove_long prob_bigmove_short", """SELECT symbol, ts, least(prob_long + prob_short, 1.0) AS prob_bigmove,
  prob_long / CASE WHEN prob_long + prob_short = 0 THEN 1 ELSE prob_long + prob_short END AS prob_bigmove_long, prob_short / CASE WHEN prob_long + prob_short = 0 THEN 1 ELSE prob_long + prob_short END AS prob_bigmove_short,
  2.0::DOUBLE AS expected_r_bigmove FROM preds"""))
def fallback(spark, sf):
    df = pr.fallback_move_columns(predictions(bars_e(spark, sf)))
    return fixed(df.select("symbol", "ts", "prob_bigmove", "prob_bigmove_long", "prob_bigmove_short", "expected_r_bigmove"))


@query("h16_signal_strength", sql(BARS_E + ",\n" + PREDS, "class_strength signal_strength", f"""SELECT symbol, ts, CASE WHEN prob_long >= prob_short THEN greatest(least((m - 0.5) * 2, 1.0), 0.0) ELSE least(greatest(-(m - 0.5) * 2, -1.0), 0.0) END AS class_strength,
  CASE WHEN abs(pred) < cut THEN 0.0 ELSE tanh(pred / cut) END AS signal_strength FROM (SELECT *, greatest(prob_long, prob_short) + 0.3 AS m, prob_long - prob_short AS pred,
  CASE WHEN count(r) OVER {roll(39)} >= 19 THEN greatest(0.05, stddev_pop(r) OVER {roll(39)} * 0.5) ELSE 0.05 END AS cut FROM (SELECT *, (close - lag(close) OVER w) / lag(close) OVER w AS r FROM preds {WINDOW}))"""))
def strength(spark, sf):
    f = split_series(predictions(bars_e(spark, sf)), lookback=42, count_from=bars_e(spark, sf))
    f = f.with_cols(pred=F.col("prob_long") - F.col("prob_short"))
    f = pr.return_strength(f, "pred", floor=0.05)
    m = F.greatest("prob_long", "prob_short") + 0.3
    side = F.when(F.col("prob_long") >= F.col("prob_short"), 1).otherwise(0)
    return fixed(f.with_cols(class_strength=pr.class_strength(side, m)).finish().select("symbol", "ts", "class_strength", "signal_strength"))


@query("n14_argmax_signal", sql(BARS_E + ",\n" + PREDS, "max_prob", """SELECT symbol, ts, greatest(prob_short, prob_neutral, prob_long) AS max_prob, CAST(CASE WHEN prob_short = greatest(prob_short, prob_neutral, prob_long) THEN -1
  WHEN prob_neutral = greatest(prob_short, prob_neutral, prob_long) THEN 0 ELSE 1 END AS BIGINT) AS signal FROM preds WHERE NOT (prob_neutral = greatest(prob_short, prob_neutral, prob_long) AND prob_short < prob_neutral)"""))
def argmax(spark, sf):
    df = pr.argmax_signal(predictions(bars_e(spark, sf))).where("signal != 0")
    return fixed(df.select("symbol", "ts", "max_prob", "signal"))


@query("n12_trade_gate", sql(BARS_E + ",\n" + PREDS, "", """SELECT symbol, ts, reason, reason = 'ok' AS should_trade, CAST(CASE WHEN reason = 'probability' THEN 0 ELSE signal END AS BIGINT) AS direction FROM (SELECT *,
  CASE WHEN mx < 0.4 THEN 'probability' WHEN signal = 0 THEN 'neutral' WHEN abs(prob_long - prob_short) * volume < volume * 0.2 THEN 'expected_move' WHEN hm >= 540 AND hm < 600 AND hm % 60 < 3 OR hm >= 960 THEN 'time_of_day' ELSE 'ok' END AS reason FROM
  (SELECT *, greatest(prob_short, prob_neutral, prob_long) AS mx, CASE WHEN prob_short = greatest(prob_short, prob_neutral, prob_long) THEN -1 WHEN prob_neutral = greatest(prob_short, prob_neutral, prob_long) THEN 0 ELSE 1 END AS signal,
  (ts // 60000000000 - 300) % 1440 AS hm FROM preds))"""))
def trade_gate(spark, sf):
    p = predictions(bars_e(spark, sf)).withColumn("atr", F.col("volume").cast("double"))
    df = pr.trade_gate(p, 0.4, 0.2, "atr", market_minute("ts"))
    return fixed(df.select("symbol", "ts", "reason", "should_trade", "direction"))


@query("l10_ensemble", sql(BARS_E + ",\n" + PREDS, "probability variance consensus", """SELECT ts, symbol, (0.5 * prob_long + 0.3 * prob_short + 0.2 * prob_neutral) / (0.5 + 0.3 + 0.2) AS probability,
  CAST(CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS hard_vote, var AS variance, greatest(v, 1 - v) AS consensus, CAST(3 AS BIGINT) AS models FROM (SELECT *,
  (CAST(prob_long >= 0.25 AS INT) + CAST(prob_short >= 0.25 AS INT) + CAST(prob_neutral >= 0.25 AS INT)) / 3.0 AS v, list_var_pop([prob_long, prob_short, prob_neutral]) AS var FROM preds)"""))
def ensembled(spark, sf):
    p = predictions(bars_e(spark, sf))
    long = p.unpivot(["symbol", "ts"], ["prob_long", "prob_short", "prob_neutral"], "model", "probability")
    return fixed(pr.ensemble(long, {"prob_long": 0.5, "prob_short": 0.3, "prob_neutral": 0.2}, 0.25))
