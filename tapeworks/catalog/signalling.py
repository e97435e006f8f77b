"""Signals, gates, caps, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pr
from ..functions.timecols import utc_minute
from ..operators import features_vpa, signals
from ..operators.features_anchored import avwap_pack
from ..operators.features_core import add_atr, core_pack
from ..operators.features_profile import profile_pack
from ..operators.series import split_series
from . import query
from .core import AVWAP, CORE, TR, VPA, WINDOW
from .data import BARS_E, bars_e, fixed, roll, sql
from .enhanced import PROFILE, STEP
from .labelling import PREDS, predictions

PREFIX = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def held_sql(enter: str, leave: str, timeout: int) -> str:
    """Prefix fold in SQL: code 1 = may enter, 2 = must leave; the accumulator is the number of bars held."""
    return f"""f0 AS (SELECT *, CASE WHEN {enter} THEN 1 ELSE 0 END + CASE WHEN {leave} THEN 2 ELSE 0 END AS code FROM core),
f1 AS (SELECT *, list_reduce(list_concat([0], list(code) OVER {PREFIX}), lambda h, c: CASE WHEN h > 0 THEN CASE WHEN c >= 2 OR h + 1 >= {timeout} THEN 0 ELSE h + 1 END WHEN c % 2 = 1 THEN 1 ELSE 0 END) AS held FROM f0),
f2 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0) AS before FROM f1)"""


HELD = """SELECT symbol, ts, CAST(held > 0 AS BIGINT) AS signal, CAST(held AS BIGINT) AS bars_held, CASE WHEN before > 0 AND held = 0 THEN 'exit' WHEN before = 0 AND held > 0 THEN 'enter' ELSE 'hold' END AS decision FROM f2"""


@query("n01_vwap_revert", sql(BARS_E + ",\n" + CORE + ",\n" + held_sql("close < f__ta__vwap_30 AND f__vol__rel_volume_30 >= 0.8 AND f__warmup_ok", "close >= f__ta__vwap_30", 4), "", HELD))
def revert(spark, sf):
    return fixed(signals.vwap_revert(core_pack(bars_e(spark, sf)), 0.8, 4))


@query("n02_vwap_momentum", sql(BARS_E + ",\n" + CORE + ",\n" + held_sql(
    "close > f__ta__vwap_30 AND f__vol__rel_volume_30 >= 0.8 AND f__warmup_ok AND (close - f__ta__vwap_30) / f__ta__vwap_30 > 0.1",
    "close <= f__ta__vwap_30 AND (close - f__ta__vwap_30) / f__ta__vwap_30 < -0.1", 5), "", HELD))
def momentum(spark, sf):
    return fixed(signals.vwap_momentum(core_pack(bars_e(spark, sf)), 0.8, 5, 10.0))


P5 = ("volume_spike", "price_breakout", "volume_divergence", "absorption", "climax")
MODEL = VPA + """,
g0 AS (SELECT *, (volume * 13 + ts // 1800000000000) % 100 / 100.0::DOUBLE AS m, """ + " + ".join(f"CAST(p__vpa__{p} AS INT)" for p in P5) + " AS k, " + " + ".join(
    f"CASE WHEN p__vpa__{p} THEN coalesce(conf__vpa__{p}, 0.0) ELSE 0.0 END" for p in P5) + f""" AS cf FROM vpa),
g1 AS (SELECT *, CASE WHEN cf / nullif(k, 0) >= 0.5 THEN cf / k * least(k / 3.0, 1.0) ELSE 0.0 END AS vs FROM g0),
g2 AS (SELECT *, m * (1 - 0.3::DOUBLE) + vs * 0.3::DOUBLE AS cb FROM g1),
g3 AS (SELECT *, list_reduce(list_concat([{{'h': 0, 'e': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'd': 'hold'}}], list({{'h': 0, 'e': 0.0::DOUBLE, 'm': m, 'c': cb, 'd': 'hold'}}) OVER {PREFIX}),
  lambda s, x: CASE WHEN s.h > 0 AND x.m < 0.3 THEN {{'h': 0, 'e': 0.0::DOUBLE, 'm': x.m, 'c': x.c, 'd': 'exit_model'}} WHEN s.h > 0 AND x.c < s.e * 0.7::DOUBLE THEN {{'h': 0, 'e': 0.0::DOUBLE, 'm': x.m, 'c': x.c, 'd': 'exit_combined'}}
  WHEN s.h > 0 AND s.h + 1 >= 6 THEN {{'h': 0, 'e': 0.0::DOUBLE, 'm': x.m, 'c': x.c, 'd': 'exit_timeout'}} WHEN s.h > 0 THEN {{'h': s.h + 1, 'e': s.e, 'm': x.m, 'c': x.c, 'd': 'hold'}}
  WHEN x.c >= 0.6 THEN {{'h': 1, 'e': x.c, 'm': x.m, 'c': x.c, 'd': 'enter'}} ELSE {{'h': 0, 'e': 0.0::DOUBLE, 'm': x.m, 'c': x.c, 'd': 'hold'}} END) AS st FROM g2)"""


@query("n03_model_vpa_signals", sql(BARS_E + ",\n" + MODEL, "vpa_score combined_score", """SELECT symbol, ts, CAST(st.h > 0 AS BIGINT) AS signal, CAST(st.h AS BIGINT) AS bars_held, st.d AS decision, CAST(vs AS DOUBLE) AS vpa_score,
  cb AS combined_score, CAST(k AS BIGINT) AS active_patterns FROM g3"""))
def model_vpa(spark, sf):
    from ..functions.timecols import idiv

    df = features_vpa.vpa_pack(bars_e(spark, sf))
    score = F.pmod(F.col("volume") * 13 + idiv(F.col("ts"), 1_800_000_000_000), F.lit(100)) / 100.0
    return fixed(signals.model_vpa_signals(df.withColumn("model_score", score), timeout=6))


@query("n05_cooldown", sql(BARS_E, "", f"""SELECT symbol, ts, volume FROM (SELECT *, list_reduce(list_concat([0::BIGINT], list(ts) OVER {PREFIX}), lambda a, t: CASE WHEN t - a >= 10800000000000 THEN t ELSE a END) AS kept
  FROM (SELECT * FROM bars WHERE volume > 30)) WHERE kept = ts"""))
def cooled(spark, sf):
    return signals.cooldown(bars_e(spark, sf).where("volume > 30").select("symbol", "ts", "volume"), 180)


LEVELS = AVWAP + ",\n" + PROFILE + f""", atrs AS (SELECT symbol, ts, avg(tr) OVER {roll(14)} AS atr FROM (SELECT *, {TR} AS tr FROM bars {WINDOW})),
lv AS (SELECT a.symbol, a.ts, a.close, a.low, a.high, f__anchor__session_avwap AS sv, atr, f__profile__val AS val, f__profile__vah AS vah FROM avwap a JOIN profile p USING (symbol, ts) JOIN atrs USING (symbol, ts))"""


def levels(spark, sf):
    b = bars_e(spark, sf)
    df = avwap_pack(b).select("symbol", "ts", "close", "low", "high", "f__anchor__session_avwap")
    df = df.join(profile_pack(b, step=STEP).select("symbol", "ts", "f__profile__val", "f__profile__vah"), ["symbol", "ts"])
    f = split_series(b, lookback=16)
    atr = add_atr(f, {"f__vol__atr_14": 14}).finish().select("symbol", "ts", "f__vol__atr_14")
    return df.join(atr, ["symbol", "ts"])


ENTRY = {
    "momentum": ("close > sv", "close < sv", "low * 0.99::DOUBLE", "high * 1.01::DOUBLE"),
    "pullback": ("sv <> 0 AND atr <> 0 AND close <= sv - atr * 0.5::DOUBLE", "sv <> 0 AND atr <> 0 AND close >= sv + atr * 0.5::DOUBLE", "sv - atr * 0.5::DOUBLE - atr * 1.5::DOUBLE", "sv + atr * 0.5::DOUBLE + atr * 1.5::DOUBLE"),
    "rotation": ("atr <> 0 AND close <= val * (1 - 0.005::DOUBLE)", "atr <> 0 AND close >= vah * (1 + 0.005::DOUBLE)", "val * (1 - 0.005::DOUBLE) - atr * 1.5::DOUBLE", "vah * (1 + 0.005::DOUBLE) + atr * 1.5::DOUBLE"),
}
for _kind, (_l, _s, _ls, _ss) in ENTRY.items():
    query(f"n04_{_kind}_entries", sql(BARS_E + ",\n" + LEVELS, "stop_level risk_per_share", f"""SELECT symbol, ts, side, stop_level, CASE WHEN side = 'long' THEN close - stop_level ELSE stop_level - close END AS risk_per_share FROM (
  SELECT *, CASE WHEN {_l} THEN 'long' WHEN {_s} THEN 'short' END AS side, CASE WHEN {_l} THEN {_ls} WHEN {_s} THEN {_ss} END AS stop_level FROM lv) WHERE side IS NOT NULL AND CASE WHEN side = 'long' THEN close - stop_level ELSE stop_level - close END > 0"""))(
        lambda spark, sf, k=_kind: fixed(signals.level_entries(levels(spark, sf), k).select("symbol", "ts", "side", "stop_level", "risk_per_share")))


@query("b17_time_profile", sql(BARS_E, "", """SELECT symbol, ts, CASE WHEN m >= 120 AND m < 570 THEN 'early' WHEN m >= 570 AND m < 720 THEN 'open' WHEN m >= 1200 OR m < 60 THEN 'night' ELSE 'night' END AS profile FROM
  (SELECT *, ts // 60000000000 % 1440 AS m FROM bars)"""))
def profiles(spark, sf):
    p = signals.time_profile(utc_minute("ts"), [("open", 570, 720), ("early", 120, 570), ("night", 1200, 60)])
    return bars_e(spark, sf).select("symbol", "ts", p.alias("profile"))


GATE = PREDS + """, gt AS (SELECT *, abs(prob_long - prob_short) AS gap, abs(prob_long - prob_short) * greatest(prob_long, prob_short) AS conv, volume / 30.0 AS er, CASE WHEN symbol = 'VIEW-0' THEN 0.42::DOUBLE ELSE 0.38::DOUBLE END AS th FROM preds),
gs AS (SELECT *, CASE WHEN prob_long >= th AND prob_long - greatest(prob_short, prob_neutral) >= 0.02 AND prob_long > prob_short AND gap >= 0.05 AND conv >= 0.03 THEN 'long'
  WHEN prob_short >= 0.4 AND prob_short - greatest(prob_long, prob_neutral) >= 0.02 AND prob_short > prob_long AND gap >= 0.06 AND conv >= 0.03 THEN 'short' END AS side FROM gt),
gr AS (SELECT *, CASE WHEN side IS NULL AND gap < 0.05 THEN 'gap_insufficient' WHEN side IS NULL AND conv < 0.03 THEN 'conviction_low' WHEN side IS NULL THEN 'below_threshold' WHEN er < 1.0 THEN 'expected_r_low' END AS reason,
  greatest(prob_long, prob_short, prob_neutral, 0) * gap * conv * greatest(er, 0) AS score FROM gs)"""


def gated(spark, sf):
    p = predictions(bars_e(spark, sf)).withColumn("expected_r", F.col("volume") / 30.0)
    th = F.when(F.col("symbol") == "VIEW-0", 0.42).otherwise(0.38)
    x = F.lit
    return signals.ml_gate(p, th, x(0.4), x(0.05), x(0.06), x(0.03), x(0.03), 0.02, 1.0)


@query("n06_ml_gate", sql(BARS_E + ",\n" + GATE, "score", """SELECT symbol, ts, side, reason, CASE reason WHEN 'gap_insufficient' THEN 'score_margin' WHEN 'conviction_low' THEN 'score_margin' WHEN 'below_threshold' THEN 'probability'
  WHEN 'expected_r_low' THEN 'expected_r' END AS bucket, score FROM gr"""))
def ml_gate(spark, sf):
    return fixed(gated(spark, sf).select("symbol", "ts", "side", "reason", "bucket", "score"))


@query("d18_rejection_buckets", sql(BARS_E + ",\n" + GATE, "", """SELECT CASE reason WHEN 'gap_insufficient' THEN 'score_margin' WHEN 'conviction_low' THEN 'score_margin' WHEN 'below_threshold' THEN 'probability'
  WHEN 'expected_r_low' THEN 'expected_r' END AS bucket, count(*) AS rejections FROM gr WHERE reason IS NOT NULL GROUP BY 1"""))
def rejections(spark, sf):
    return signals.rejection_counts(gated(spark, sf).where("reason is not null"))


@query("n07_rank_caps", sql(BARS_E + ",\n" + GATE, "score", """SELECT symbol, ts, score FROM (SELECT *, row_number() OVER (PARTITION BY ts // 86400000000000 ORDER BY ts, score DESC, symbol) AS r3 FROM (
  SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts // 86400000000000 ORDER BY ts) AS r1 FROM gr WHERE reason IS NULL) WHERE r1 <= 2) WHERE r2 <= 1) WHERE r3 <= 4"""))
def capped(spark, sf):
    c = gated(spark, sf).where("reason is null").select("symbol", "ts", "score")
    return fixed(signals.rank_caps(c, 1, 2, 4))


GREEDY = """oc AS (SELECT symbol, ts, ts // 86400000000000 AS d, row_number() OVER (PARTITION BY ts // 86400000000000 ORDER BY ts, score DESC, symbol) AS rn FROM gr WHERE reason IS NULL),
st AS (SELECT d, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS ts, 0 AS nb, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS block_reason FROM oc GROUP BY d
UNION ALL SELECT d, rn, ts, CASE WHEN why IS NULL THEN b + 1 ELSE b END, CASE WHEN why IS NULL THEN list_append(taken, symbol) ELSE taken END, symbol, why
FROM (SELECT *, CASE WHEN b >= 1 THEN 'max_trades_per_bar_reached' WHEN len(taken) >= 4 THEN 'max_entries_reached_global'
  WHEN len(list_filter(taken, lambda x: x = symbol)) >= 2 THEN 'max_trades_per_symbol_reached' END AS why
  FROM (SELECT oc.d, oc.rn, oc.ts, oc.symbol, taken, CASE WHEN oc.ts = st.ts THEN nb ELSE 0 END AS b FROM st JOIN oc ON oc.d = st.d AND oc.rn = st.rn + 1)))"""


@query("n07_greedy_caps", sql("RECURSIVE " + BARS_E + ",\n" + GATE + ",\n" + GREEDY, "", "SELECT symbol, ts, block_reason FROM st WHERE rn > 0"))
def greedy(spark, sf):
    return signals.greedy_caps(gated(spark, sf).where("reason is null"), 1, 2, 4)


@query("n10_next_bar_orders", sql(BARS_E + ",\n" + GATE, "fill_price", """SELECT symbol, ts AS signal_ts, side, nts AS execution_ts, CASE WHEN side = 'short' THEN nopen * (1 - 0.0003::DOUBLE) ELSE nopen * (1 + 0.0003::DOUBLE) END AS fill_price
  FROM gr JOIN (SELECT symbol, ts, lead(ts) OVER w AS nts, lead(open) OVER w AS nopen FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) USING (symbol, ts) WHERE reason IS NULL AND nts IS NOT NULL"""))
def orders(spark, sf):
    o = gated(spark, sf).where("reason is null").select("symbol", "ts", "side")
    return fixed(signals.next_bar_orders(o, bars_e(spark, sf)))


@query("b19_late_orders", sql(BARS_E + ",\n" + GATE, "", "SELECT symbol, ts, side FROM gr WHERE reason IS NULL AND (ts // 60000000000 - 300) % 1440 < 930"))
def late(spark, sf):
    return signals.drop_late_orders(gated(spark, sf).where("reason is null").select("symbol", "ts", "side"), 30)


CAL = PREDS + """, cc AS (SELECT symbol, prob_long, prob_short, prob_neutral, greatest(prob_long - greatest(prob_short, prob_neutral), prob_short - greatest(prob_long, prob_neutral)) AS score_margin,
  abs(prob_long - prob_short) AS directional_gap, abs(prob_long - prob_short) * greatest(prob_long, prob_short) AS conviction FROM preds),
cu AS (UNPIVOT cc ON prob_long, prob_short, directional_gap, conviction, score_margin INTO NAME metric VALUE value),
cs AS (SELECT symbol, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS "min", max(value) AS "max", quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90
  FROM cu GROUP BY GROUPING SETS ((symbol, metric), (metric)))"""
QS = {"p50": 0.5, "p90": 0.9}


def summary(spark, sf):
    df = pr.calibration_columns(predictions(bars_e(spark, sf))).select("symbol", *signals.METRICS)
    return signals.metric_summary(df, signals.METRICS, QS)


@query("d20_n09_metric_summary", sql(BARS_E + ",\n" + CAL, 'mean std "min" "max" p50 p90', "SELECT * FROM cs"))
def metric_summary(spark, sf):
    return fixed(summary(spark, sf))


@query("n08_calibrated_thresholds", sql(BARS_E + ",\n" + CAL, "prob_threshold_long prob_threshold_short min_directional_gap", """SELECT symbol, src AS source, n, CASE WHEN adj = 0 THEN l ELSE least(greatest(greatest(l - adj, 0.25), 0.3), 0.45) END AS prob_threshold_long,
  CASE WHEN adj = 0 THEN s ELSE least(greatest(s + adj, 0.25), 0.999) END AS prob_threshold_short, g AS min_directional_gap FROM (SELECT symbol, n, CASE WHEN n >= 1080 THEN 'symbol' ELSE 'global' END AS src,
  least(greatest(CASE WHEN n >= 1080 THEN l ELSE gl END, 0.3), 0.45) AS l, least(CASE WHEN n >= 1080 THEN s ELSE gs END, 0.999) AS s, least(CASE WHEN n >= 1080 THEN g ELSE gg END, 1.0) AS g,
  CASE WHEN abs(CASE WHEN n >= 1080 THEN ml - ms ELSE gml - gms END) < 1e-6 THEN 0.0 ELSE least(greatest(-(CASE WHEN n >= 1080 THEN ml - ms ELSE gml - gms END) * 0.5, -0.05), 0.05) END AS adj FROM (
  SELECT symbol, max(n) AS n, max(p90) FILTER (metric = 'prob_long') AS l, max(p90) FILTER (metric = 'prob_short') AS s, max(p50) FILTER (metric = 'directional_gap') AS g, max(mean) FILTER (metric = 'prob_long') AS ml,
  max(mean) FILTER (metric = 'prob_short') AS ms FROM cs WHERE symbol IS NOT NULL GROUP BY 1) x, (SELECT max(p90) FILTER (metric = 'prob_long') AS gl, max(p90) FILTER (metric = 'prob_short') AS gs, max(p50) FILTER (metric = 'directional_gap') AS gg,
  max(mean) FILTER (metric = 'prob_long') AS gml, max(mean) FILTER (metric = 'prob_short') AS gms FROM cs WHERE symbol IS NULL) y)"""))
def calibrated(spark, sf):
    return fixed(signals.calibrate(
        summary(spark, sf), {"prob_threshold_long": 0.3, "prob_threshold_short": 0.3, "min_directional_gap": 0.05},
        {"prob_threshold_long": "prob_long:p90", "prob_threshold_short": "prob_short:p90", "min_directional_gap": "directional_gap:p50"},
        1080, {"prob_threshold_long": 0.3}, {"prob_threshold_long": 0.45}, bias_scale=0.5))


#: the rule bar by bar: one recursion step takes every symbol's next bar; side, entry, stop, take, eday and ets are those of the open position
DEVIATIONS = f"""ranges AS (SELECT symbol, ts, avg(tr) OVER {roll(14)} AS a FROM (SELECT *, {TR} AS tr FROM bars {WINDOW})),
dv AS (SELECT symbol, ts, CAST(close AS DOUBLE) AS price, a, (close - f__ta__vwap_30) / nullif(f__ta__vwap_30, 0) AS d, ts // 60000000000 % 1440 AS mn, ts // 86400000000000 AS dy,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM core JOIN ranges USING (symbol, ts)),
rw AS (SELECT *, stddev_samp(d) OVER (PARTITION BY symbol) AS sd FROM dv),
mc AS (SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS why, CAST(NULL AS VARCHAR) AS act, CAST(NULL AS DOUBLE) AS price,
  CAST(NULL AS DOUBLE) AS sure, CAST(NULL AS BIGINT) AS since, CAST(NULL AS DOUBLE) AS paid, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS DOUBLE) AS entry, CAST(NULL AS DOUBLE) AS stop,
  CAST(NULL AS DOUBLE) AS take, CAST(NULL AS BIGINT) AS eday, CAST(NULL AS BIGINT) AS ets, CAST(NULL AS BIGINT) AS last FROM rw GROUP BY symbol
UNION ALL SELECT symbol, i + 1, rts, kind, CASE WHEN kind = 'exit' THEN why END, CASE WHEN kind = 'exit' THEN CASE side WHEN 'long' THEN 'sell' ELSE 'buy' END WHEN kind = 'entry' THEN CASE opens WHEN 'long' THEN 'buy' ELSE 'sell' END END,
  p, CASE WHEN kind = 'exit' THEN CASE why WHEN 'end_of_day_hard_close' THEN 1.0 ELSE 0.8 END WHEN kind = 'entry' THEN CASE WHEN sd = 0 THEN 0.9 ELSE least(abs(d) / sd, 0.9) END END,
  CASE WHEN kind = 'exit' THEN ets END, CASE WHEN kind = 'exit' THEN entry END, CASE kind WHEN 'entry' THEN opens WHEN 'exit' THEN NULL ELSE side END, CASE kind WHEN 'entry' THEN p ELSE entry END,
  CASE kind WHEN 'entry' THEN least(a / p, 0.02) ELSE stop END, CASE kind WHEN 'entry' THEN least(1.5 * a / p, 0.03) ELSE take END, CASE kind WHEN 'entry' THEN dy ELSE eday END,
  CASE kind WHEN 'entry' THEN rts ELSE ets END, CASE WHEN kind IS NOT NULL THEN rts ELSE last END
FROM (SELECT *, CASE WHEN blocked THEN NULL WHEN why IS NOT NULL THEN 'exit' WHEN side IS NULL AND opens IS NOT NULL THEN 'entry' END AS kind FROM (
  SELECT mc.symbol, mc.i, side, entry, stop, take, eday, ets, last, r.ts AS rts, r.price AS p, r.a, r.d, r.sd, r.dy, coalesce(r.ts - last < 300000000000, false) AS blocked,
    CASE WHEN side IS NULL THEN NULL WHEN mn >= {signals.HARD_CLOSE} THEN 'end_of_day_hard_close' WHEN dy > eday THEN 'same_day_forced_close' WHEN d * sg > sd * 0.1 THEN 'mean_reversion_exit'
      WHEN (r.price - entry) * sg < -entry * stop THEN 'intraday_stop_loss' WHEN (r.price - entry) * sg > entry * take THEN 'intraday_take_profit' END AS why,
    CASE WHEN mn < {signals.LAST_ENTRY} AND d < -sd * 0.6 THEN 'long' WHEN mn < {signals.LAST_ENTRY} AND d > sd * 0.6 THEN 'short' END AS opens
  FROM (SELECT *, CASE side WHEN 'long' THEN 1 ELSE -1 END AS sg FROM mc) mc JOIN rw r ON r.symbol = mc.symbol AND r.i = mc.i + 1)))"""


@query("n13_deviation_signals", sql("RECURSIVE " + BARS_E + ",\n" + CORE + ",\n" + DEVIATIONS, "close entry_price confidence stop_loss_pct take_profit_pct", """SELECT symbol, ts, act AS side, kind AS signal_type, why AS exit_reason,
  price AS close, since AS entry_ts, paid AS entry_price, sure AS confidence, CASE WHEN kind = 'entry' THEN stop END AS stop_loss_pct, CASE WHEN kind = 'entry' THEN take END AS take_profit_pct FROM mc WHERE kind IS NOT NULL"""))
def deviation_signals(spark, sf):
    b = bars_e(spark, sf)
    f = add_atr(split_series(core_pack(b), lookback=16, count_from=b), {"f__vol__atr_14": 14})
    return fixed(signals.deviation_signals(f.finish()))
