"""Feature families for learning, generic transforms and market context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features_ml as ml
from ..operators.joins import asof_backward, match_report, next_bar
from ..operators.series import split_series
from . import query
from .core import TR, WINDOW
from .data import BARS_E, BARS_L, BENCH, bars_e, bars_l, bench, fixed, mp, prior, roll, sql

KEEP = ("symbol", "ts")
W = "OVER (PARTITION BY symbol ORDER BY ts)"


def family(name, fn, cols, body, lookback=130, src="l"):
    """Register one family: its columns, and SQL producing them next to symbol and ts."""
    ctes, make = (BARS_L, bars_l) if src == "l" else (BARS_E, bars_e)

    def run(spark, sf):
        f = fn(split_series(make(spark, sf), lookback=lookback, lookahead=5))
        return fixed(f.finish().select(*KEEP, *cols.split()))

    query(name, sql(ctes, cols.replace("0.5", "0.5"), body))(run)


def q(*cols):
    return " ".join(cols)


def lagx(x, n):
    return f"lag({x}, {n}) {W}"


family("e28_returns", lambda f: ml.returns_trend(f, (1, 5, 20)),
       "f__ret__simple_1 f__ret__log_1 f__ret__simple_5 f__ret__log_5 f__ret__simple_20 f__ret__log_20",
       "SELECT symbol, ts, " + ", ".join(
           f"(close - {lagx('close', n)}) / {lagx('close', n)} AS f__ret__simple_{n}, ln(close / {lagx('close', n)}) AS f__ret__log_{n}"
           for n in (1, 5, 20)) + " FROM bars")

family("e29_volatility_ranges", lambda f: ml.volatility_ranges(f, (5, 14), (5, 20), (1.0, 2.0)).with_cols(
           range_ratio_1=F.col("`f__range__ratio_1.0`"), range_ratio_2=F.col("`f__range__ratio_2.0`")),
       "f__vol__atr_5 f__vol__atr_14 f__vol__rolling_std_5 f__vol__rolling_std_20 range_ratio_1 range_ratio_2",
       f"""SELECT symbol, ts, avg(tr) OVER {roll(5)} AS f__vol__atr_5, avg(tr) OVER {roll(14)} AS f__vol__atr_14,
  {mp('stddev_samp({x})', 'r', 5, 5)} * sqrt(390) AS f__vol__rolling_std_5, {mp('stddev_samp({x})', 'r', 20, 20)} * sqrt(390) AS f__vol__rolling_std_20,
  rng / ({mp('avg({x})', 'rng', 20, 20)} * 1.0 + 1e-8) AS range_ratio_1, rng / ({mp('avg({x})', 'rng', 20, 20)} * 2.0 + 1e-8) AS range_ratio_2
  FROM (SELECT *, {TR} AS tr, (close - lag(close) OVER w) / lag(close) OVER w AS r, high - low AS rng FROM bars {WINDOW})""")

VW = {n: f"CASE WHEN sum(volume) OVER {roll(n)} > 0 THEN sum(close * volume) OVER {roll(n)} / sum(volume) OVER {roll(n)} ELSE close END"
      for n in (5, 10, 20, 30)}
family("e30_volume_flow", lambda f: ml.volume_flow(f, (5, 20), (5, 30)).with_cols(
           f__vol__sum_5=F.col("f__vol__sum_5").cast("double"), f__vol__sum_20=F.col("f__vol__sum_20").cast("double")),
       "f__vol__sum_5 f__vol__sum_20 f__vwap__value_5 f__vwap__value_30",
       f"""SELECT symbol, ts, CAST({mp('sum({x})', 'volume', 5, 5)} AS DOUBLE) AS f__vol__sum_5,
  CAST({mp('sum({x})', 'volume', 20, 20)} AS DOUBLE) AS f__vol__sum_20, {VW[5]} AS f__vwap__value_5, {VW[30]} AS f__vwap__value_30 FROM bars""")

family("e31_vwap_distance", lambda f: ml.vwap_distance(f, (5, 20), (20, 30)),
       "f__vwap__dist_5 f__vwap__dist_20 f__vwap__z_5_20 f__vwap__z_5_30 f__vwap__z_20_20 f__vwap__z_20_30",
       "SELECT symbol, ts, (close - w5) / close AS f__vwap__dist_5, (close - w20) / close AS f__vwap__dist_20, " + ", ".join(
           f"(x{n} - {mp('avg({x})', f'x{n}', z, z)}) / ({mp('stddev_samp({x})', f'x{n}', z, z)} + 1e-8) AS f__vwap__z_{n}_{z}"
           for n in (5, 20) for z in (20, 30)) +
       f" FROM (SELECT *, (close - w5) / w5 AS x5, (close - w20) / w20 AS x20 FROM (SELECT *, {VW[5]} AS w5, {VW[20]} AS w20 FROM bars))")


@query("e32_time_seasonality", sql(BARS_E, " ".join(f"f__time__{p}_{s}" for p in ("hour", "minute", "dow") for s in ("sin", "cos")),
       "SELECT symbol, ts, " + ", ".join(
           f"{s}(2 * pi() * {e} / {p}.0) AS f__time__{n}_{s}" for n, e, p in (
               ("hour", "(ts // 3600000000000 % 24)", 24), ("minute", "(ts // 60000000000 % 60)", 60),
               ("dow", "((ts // 86400000000000 + 3) % 7)", 7)) for s in ("sin", "cos")) + " FROM bars"))
def seasonality(spark, sf):
    df = ml.time_seasonality(bars_e(spark, sf))
    return fixed(df.select("symbol", "ts", *[x for x in df.columns if x.startswith("f__time")]))


@query("e32_time_one_hot", sql(BARS_E, "", """SELECT symbol, ts, CAST(ts // 3600000000000 % 24 = 9 AS BIGINT) AS f__time__hour_9,
  CAST(ts // 60000000000 % 60 BETWEEN 30 AND 34 AS BIGINT) AS f__time__minute_30,
  CAST((ts // 86400000000000 + 3) % 7 = 0 AS BIGINT) AS f__time__dow_0 FROM bars"""))
def one_hot(spark, sf):
    df = ml.time_seasonality(bars_e(spark, sf), cyclical=False)
    return fixed(df.select("symbol", "ts", "f__time__hour_9", "f__time__minute_30", "f__time__dow_0"))


def _cs(n):
    return (f"CASE WHEN count(*) OVER (PARTITION BY ts) >= 2 AND r{n} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY r{n} NULLS LAST) "
            f"+ (count(r{n}) OVER (PARTITION BY ts, r{n}) - 1) / 2.0) / count(r{n}) OVER (PARTITION BY ts) END AS f__cross__ret_percentile_{n}")


@query("e33_cross_section_rank", sql(BARS_L, "f__cross__ret_percentile_5 f__cross__ret_percentile_20",
       f"SELECT symbol, ts, {_cs(5)}, {_cs(20)} FROM (SELECT symbol, ts, " + ", ".join(
           f"(close - {lagx('close', n)}) / {lagx('close', n)} AS r{n}" for n in (5, 20)) + " FROM bars)"))
def cross(spark, sf):
    df = ml.cross_section(split_series(bars_l(spark, sf).select("symbol", "ts", "close"), lookback=21))
    return fixed(df.select("symbol", "ts", "f__cross__ret_percentile_5", "f__cross__ret_percentile_20"))


MOVES = """(SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l
  FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars))"""
family("e34_momentum", lambda f: ml.price_momentum(f, (1, 10), (14, 30), (5, 20)),
       "f__mom__roc_1 f__mom__roc_10 f__mom__rsi_14 f__mom__rsi_30 f__ma__ratio_5 f__ma__ratio_20",
       "SELECT symbol, ts, " + ", ".join(f"(close - {lagx('close', n)}) / {lagx('close', n)} * 100 AS f__mom__roc_{n}" for n in (1, 10)) + ", " +
       ", ".join(f"100 - 100 / (1 + {mp('avg({x})', 'g', n, n)} / ({mp('avg({x})', 'l', n, n)} + 1e-8)) AS f__mom__rsi_{n}" for n in (14, 30)) + ", " +
       ", ".join(f"close / {mp('avg({x})', 'close', n, n)} AS f__ma__ratio_{n}" for n in (5, 20)) + f" FROM {MOVES}")

family("e35_microstructure", lambda f: ml.microstructure(f, (1, 5), (5, 10)),
       "f__micro__spread_1 f__micro__spread_5 f__micro__imbalance_5 f__micro__imbalance_10 f__vwap__5m",
       f"""SELECT symbol, ts, {mp('avg({x})', 'sp', 1, 1)} AS f__micro__spread_1, {mp('avg({x})', 'sp', 5, 5)} AS f__micro__spread_5,
  {mp('sum({x})', 'im', 5, 5)} AS f__micro__imbalance_5, {mp('sum({x})', 'im', 10, 10)} AS f__micro__imbalance_10, {VW[5]} AS f__vwap__5m
  FROM (SELECT *, (high - low) / close AS sp, (close - lag(close) {W}) * volume AS im FROM bars)""")


def _conv(n):
    return ", ".join([
        f"(close - {mp('avg({x})', 'close', n, n)}) / (nullif({mp('stddev_pop({x})', 'close', n, n)}, 0) + 1e-8) AS f__conv__zscore_{n}",
        f"(close - {lagx('close', n)}) / {lagx('close', n)} * (volume / ({mp('avg({x})', 'volume', n, n)} + 1e-8)) AS f__conv__mom_vol_{n}",
        f"(close - {mp('min({x})', 'low', n, n)}) / ({mp('sum({x})', 'r0', n, n)} + 1e-8) AS f__conv__range_pos_{n}",
        f"{mp('avg({x})', 'body', n, n)} AS f__conv__body_strength_{n}",
        f"{mp('avg({x})', 'wick', n, n)} AS f__conv__wick_skew_{n}",
        f"{mp('sum({x})', 'adl', n, n)} / ({mp('sum({x})', 'volume', n, n)} + 1e-8) AS f__conv__adl_strength_{n}",
        f"CASE WHEN {lagx('close', n)} IS NOT NULL THEN sum(sv) OVER {roll(n)} / (sum(volume) OVER {roll(n)} + 1e-8) END AS f__conv__obv_mom_{n}",
    ])


CONV_COLS = [f"f__conv__{x}_{n}" for n in (3, 12) for x in (
    "zscore", "mom_vol", "range_pos", "body_strength", "wick_skew", "adl_strength", "obv_mom")]
family("e36_conviction", lambda f: ml.conviction(f, (3, 12)), " ".join(CONV_COLS),
       f"SELECT symbol, ts, {_conv(3)}, {_conv(12)} FROM (SELECT *, (close - open) / rng AS body, "
       "((least(open, close) - low) - (high - greatest(open, close))) / rng AS wick, ((close - low) - (high - close)) / rng * volume AS adl, "
       f"high - low AS r0, sign(coalesce(close - lag(close) {W}, 0)) * volume AS sv FROM (SELECT *, CASE WHEN high = low THEN 1e-8 ELSE high - low END + 1e-8 AS rng FROM bars))",
       src="l")

family("e39_price_volume_proxy", lambda f: ml.price_volume_proxy(f).with_cols(nr7=F.col("f__vpa__nr7").cast("double")),
       "f__vpa__ease_of_movement nr7 f__vpa__close_loc",
       f"""SELECT symbol, ts, (high - low) / close / (ln(1 + volume) + 1e-8) AS f__vpa__ease_of_movement,
  CASE WHEN coalesce(high - low < {mp('min({x})', '(high - low)', 6, 6, prior(6))}, false) THEN 1.0 ELSE 0.0 END AS nr7,
  (close - low) / (high - low + 1e-8) AS f__vpa__close_loc FROM bars""")

family("e41_lags", lambda f: ml.add_lags(f, ["close"], [1, 3]), "close_lag_1 close_lag_3",
       f"""SELECT symbol, ts, coalesce({lagx('close', 1)}, CASE WHEN count(*) OVER (PARTITION BY symbol) > 1 THEN first_value(close) {W} END) AS close_lag_1,
  coalesce({lagx('close', 3)}, CASE WHEN count(*) OVER (PARTITION BY symbol) > 3 THEN first_value(close) {W} END) AS close_lag_3 FROM bars""")

family("e42_rolling", lambda f: ml.add_rolling(f, ["close"], [5, 20], ["mean", "std", "min", "max", "median", "sum"]),
       " ".join(f"close_roll_{n}_{x}" for n in (5, 20) for x in ("mean", "std", "min", "max", "median", "sum")),
       "SELECT symbol, ts, " + ", ".join(
           f"{mp(e, 'close', n, n)} AS close_roll_{n}_{x}" for n in (5, 20) for x, e in (
               ("mean", "avg({x})"), ("std", "stddev_samp({x})"), ("min", "min({x})"), ("max", "max({x})"),
               ("median", "quantile_cont({x}, 0.5)"), ("sum", "sum({x})"))) + " FROM bars")

family("e43_differences", lambda f: ml.add_differences(f, ["close"], [1, 5]), "close_diff_1 close_diff_5",
       f"SELECT symbol, ts, close - {lagx('close', 1)} AS close_diff_1, close - {lagx('close', 5)} AS close_diff_5 FROM bars")

family("e44_technical", ml.technical_indicators,
       "close_rsi close_bb_upper close_bb_lower close_bb_position close_stoch_k close_stoch_d close_williams_r",
       f"""SELECT symbol, ts, CASE WHEN l14 = 0 THEN CASE WHEN g14 > 0 THEN 100.0 END ELSE 100 - 100 / (1 + g14 / l14) END AS close_rsi,
  up AS close_bb_upper, lo AS close_bb_lower, (close - lo) / nullif(up - lo, 0) AS close_bb_position, k AS close_stoch_k,
  {mp('avg({x})', 'k', 3, 3)} AS close_stoch_d, wr AS close_williams_r
  FROM (SELECT *, ma + sd * 2 AS up, ma - sd * 2 AS lo, (close - lo14) / nullif(hi14 - lo14, 0) * 100 AS k, (hi14 - close) / nullif(hi14 - lo14, 0) * -100 AS wr
  FROM (SELECT *, {mp('avg({x})', 'g', 14, 14)} AS g14, {mp('avg({x})', 'l', 14, 14)} AS l14, {mp('max({x})', 'high', 14, 14)} AS hi14,
  {mp('min({x})', 'low', 14, 14)} AS lo14, {mp('avg({x})', 'close', 20, 20)} AS ma, {mp('stddev_samp({x})', 'close', 20, 20)} AS sd FROM {MOVES}))""")


def _ema_sql(lst, span):
    a = f"(2.0 / {span + 1})"
    return (f"list_reduce(list_concat([0.0], {lst}), lambda a, x: a * (1 - {a}) + x) "
            f"/ ((1 - power(1 - {a}, len({lst}))) / {a})")


@query("e44_macd", sql(BARS_E, "close_macd close_macd_signal", f"""SELECT symbol, ts, close_macd, {_ema_sql('lm', 9)} AS close_macd_signal
  FROM (SELECT symbol, ts, close_macd, list(close_macd) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lm
  FROM (SELECT symbol, ts, {_ema_sql('lc', 12)} - {_ema_sql('lc', 26)} AS close_macd
  FROM (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lc FROM bars)))"""))
def macd(spark, sf):
    f = ml.macd(split_series(bars_e(spark, sf)))
    return fixed(f.finish().select("symbol", "ts", "close_macd", "close_macd_signal"))


@query("e40_ml_pack", sql(BARS_L, "f__ret__simple_1 f__ret__log_1", """SELECT symbol, ts, open, high, low, close, volume,
  (close - lag(close) OVER w) / lag(close) OVER w AS f__ret__simple_1, ln(close / lag(close) OVER w) AS f__ret__log_1
  FROM bars WHERE ts <= 900000000000000000 WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""))
def pack(spark, sf):
    return fixed(ml.ml_pack(bars_l(spark, sf), ["returns_trend"], ts_cut=900_000_000_000_000_000, max_features=2))


# --- market context and as-of joins ---------------------------------------------------------------

MKT = """mkt AS (SELECT ts AS mts, close AS MKT_close FROM bench),
merged AS (SELECT bars.*, MKT_close FROM bars ASOF LEFT JOIN mkt ON bars.ts >= mkt.mts)"""


def _merged(spark, sf):
    m = bench(spark, sf).select("ts", F.col("close").alias("MKT_close"))
    return ml.with_market(bars_e(spark, sf), m, ["MKT_close"])


@query("c05_asof_backward", sql(BARS_E + ",\n" + BENCH + ",\n" + MKT, "MKT_close", "SELECT symbol, ts, close, MKT_close FROM merged"))
def asof(spark, sf):
    return fixed(_merged(spark, sf).select("symbol", "ts", "close", "MKT_close"))


@query("c05_asof_by_symbol", f"""WITH {BARS_E}, ord AS (SELECT DISTINCT symbol, ts - ts % 7200000000000 + 5400000000000 AS ats FROM bars)
SELECT ord.symbol, ats AS ts, close AS last_close FROM ord ASOF LEFT JOIN bars ON ord.symbol = bars.symbol AND ord.ats >= bars.ts""")
def asof_by(spark, sf):
    b = bars_e(spark, sf)
    step = F.lit(7_200_000_000_000).cast("long")
    left = b.select("symbol", (F.col("ts") - F.pmod("ts", step) + F.lit(5_400_000_000_000).cast("long")).alias("ts")).distinct()
    return fixed(asof_backward(left, b.withColumn("last_close", F.col("close")), ["last_close"], by=["symbol"]))


@query("e37_market_strength", sql(BARS_E + ",\n" + BENCH + ",\n" + MKT, "f__mkt__rel_str_15m f__mkt__beta_adj_rs_60m",
       f"""SELECT symbol, ts, sn - mn AS f__mkt__rel_str_15m, s1 - CASE WHEN count(s1 + m1) OVER {roll(60)} >= 60 THEN covar_samp(s1, m1) OVER {roll(60)} END
  / ({mp('var_samp({x})', 'm1', 60, 60)} + 1e-8) * m1 AS f__mkt__beta_adj_rs_60m
  FROM (SELECT *, (close - {lagx('close', 1)}) / {lagx('close', 1)} AS s1, (MKT_close - {lagx('MKT_close', 1)}) / {lagx('MKT_close', 1)} AS m1,
  (close - {lagx('close', 15)}) / {lagx('close', 15)} AS sn, (MKT_close - {lagx('MKT_close', 15)}) / {lagx('MKT_close', 15)} AS mn FROM merged)""", 5))
def strength(spark, sf):
    df = _merged(spark, sf)
    f = ml.market_strength(split_series(df, lookback=80, count_from=bars_e(spark, sf)))
    return fixed(f.finish().select("symbol", "ts", "f__mkt__rel_str_15m", "f__mkt__beta_adj_rs_60m"), 5)


@query("e38_market_regime", sql(BARS_E + ",\n" + BENCH + ",\n" + MKT, "f__regime__vix_level f__regime__vix_roc_60m f__regime__spy_dist_ma60",
       f"""SELECT symbol, ts, MKT_close AS f__regime__vix_level, (MKT_close - {lagx('MKT_close', 60)}) / {lagx('MKT_close', 60)} AS f__regime__vix_roc_60m,
  (MKT_close - {mp('avg({x})', 'MKT_close', 60, 60)}) / {mp('avg({x})', 'MKT_close', 60, 60)} AS f__regime__spy_dist_ma60 FROM merged"""))
def market_regime(spark, sf):
    f = ml.market_regime(split_series(_merged(spark, sf), lookback=61, count_from=bars_e(spark, sf)), "MKT_close", "MKT_close")
    return fixed(f.finish().select("symbol", "ts", "f__regime__vix_level", "f__regime__vix_roc_60m", "f__regime__spy_dist_ma60"))


@query("c12_next_bar", sql(BARS_E, "", """SELECT symbol, ts, entry_ts, entry_open FROM (SELECT symbol, ts, volume, lead(ts) OVER w AS entry_ts, lead(open) OVER w AS entry_open
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE volume > 60 AND entry_ts IS NOT NULL"""))
def next_row(spark, sf):
    b = bars_e(spark, sf)
    rows = b.where("volume > 60").select("symbol", "ts")
    return next_bar(rows, b, {"entry_ts": "ts", "entry_open": "open"})


@query("c04_match_report", sql(BARS_E + ",\n" + BENCH, "", """SELECT CAST(count(*) FILTER (b.ts IS NOT NULL AND n.ts IS NOT NULL) AS BIGINT) AS matched,
  CAST(count(*) FILTER (n.ts IS NULL) AS BIGINT) AS left_dropped, CAST(count(*) FILTER (b.ts IS NULL) AS BIGINT) AS right_dropped
  FROM bars b FULL JOIN bench n ON b.ts = n.ts"""))
def matches(spark, sf):
    return match_report(bars_e(spark, sf), bench(spark, sf), ["ts"])


@query("h06_interactions", sql(BARS_L, "close_x_volume close_div_volume", """SELECT symbol, ts, close * volume AS close_x_volume,
  close / (volume + 1e-8) AS close_div_volume FROM bars"""))
def interactions(spark, sf):
    return fixed(ml.interactions(bars_l(spark, sf), [("close", "volume")]).select("symbol", "ts", "close_x_volume", "close_div_volume"))


@query("h06_interaction_ranking", sql(BARS_L, "score", """SELECT 'open' AS "left", 'volume' AS "right", abs(corr(open * volume, close)) AS score FROM bars
  UNION ALL SELECT 'high', 'volume', abs(corr(high * volume, close)) FROM bars
  UNION ALL SELECT 'open', 'high', abs(corr(open * high, close)) FROM bars"""))
def rank_pairs(spark, sf):
    return fixed(ml.rank_interactions(bars_l(spark, sf), ["open", "high", "volume"], "close"))
