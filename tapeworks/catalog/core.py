"""Core, regime, volume-price and anchored features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features_anchored, features_core, features_regime, features_vpa
from ..operators.series import split_series
from ..plans.flagship import ranked_bars
from . import query
from .data import BARS_E, BARS_L, bars_e, bars_l, fixed, mp, prior, roll, sql

TR = """greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"""
WINDOW = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
TOD = "CAST(ts // 60000000000 % 1440 AS INTEGER)"

RVOL_MARKET = f"""tod AS (SELECT tod, avg(m) AS tm FROM (SELECT symbol, {TOD} AS tod, avg(volume) AS m FROM bars
  GROUP BY 1, 2) GROUP BY 1)"""
RV = "CASE WHEN tm = 0 THEN volume / 1.0 ELSE coalesce(volume / tm, 1.0) END"


def _core_sql(extra: str = "") -> str:
    return f"""tr AS (SELECT *, {TOD} AS tod, {TR} AS tr FROM bars {WINDOW}),
core AS (SELECT tr.symbol, ts, open, high, low, close, volume,
  {RV} AS f__vol__rel_volume_30,
  CASE WHEN sum(volume) OVER {roll(30)} > 0 THEN sum(close * volume) OVER {roll(30)} / sum(volume) OVER {roll(30)}
    ELSE close END AS f__ta__vwap_30,
  avg(tr) OVER {roll(30)} AS f__vol__atr_30,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) > 30 AS f__warmup_ok
  FROM tr JOIN tod USING (tod))"""


CORE = RVOL_MARKET + ",\n" + _core_sql()
CORE_COLS = "f__vol__rel_volume_30 f__ta__vwap_30 f__vol__atr_30"


@query("e04_core_pack", sql(BARS_E + ",\n" + CORE, CORE_COLS, "SELECT * FROM core"))
def core(spark, sf):
    return fixed(features_core.core_pack(bars_e(spark, sf)))


@query("e04_core_pack_weekly", sql(BARS_L + ",\n" + CORE, CORE_COLS, "SELECT * FROM core"))
def core_weekly(spark, sf):
    return fixed(features_core.core_pack(bars_l(spark, sf)))


@query("f02_top_symbols_per_bucket", sql(BARS_E + ",\n" + CORE, CORE_COLS, """SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY ts ORDER BY f__vol__rel_volume_30 DESC, symbol) AS rank FROM core) WHERE rank <= 3"""))
def flagship(spark, sf):
    return fixed(ranked_bars(bars_e(spark, sf)))


@query("e01_vwap", sql(BARS_E, "f__ta__vwap_20", f"""SELECT symbol, ts, CASE WHEN sum(volume) OVER {roll(20)} > 0
  THEN sum(close * volume) OVER {roll(20)} / sum(volume) OVER {roll(20)} ELSE close END AS f__ta__vwap_20 FROM bars"""))
def vwap(spark, sf):
    f = split_series(bars_e(spark, sf), lookback=20)
    return fixed(features_core.add_vwap(f, {"f__ta__vwap_20": 20}).finish().select("symbol", "ts", "f__ta__vwap_20"))


@query("e02_rel_volume", sql(BARS_E, "f__vol__rel_volume_30", f"""SELECT symbol, ts, volume,
  CASE WHEN m = 0 THEN volume / 1.0 ELSE volume / m END AS f__vol__rel_volume_30
  FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol, {TOD}) AS m FROM bars)"""))
def rvol(spark, sf):
    return fixed(features_core.rel_volume(bars_e(spark, sf)).select("symbol", "ts", "volume", "f__vol__rel_volume_30"))


@query("e03_atr", sql(BARS_L, "f__vol__atr_14", f"""SELECT symbol, ts, avg(tr) OVER {roll(14)} AS f__vol__atr_14
  FROM (SELECT *, {TR} AS tr FROM bars {WINDOW})"""))
def atr(spark, sf):
    f = split_series(bars_l(spark, sf), lookback=15)
    return fixed(features_core.add_atr(f, {"f__vol__atr_14": 14}).finish().select("symbol", "ts", "f__vol__atr_14"))


@query("b20_warmup_mask", sql(BARS_L, "", """SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) > 60
  AS f__warmup_ok FROM bars"""))
def warmup(spark, sf):
    f = split_series(bars_l(spark, sf), lookback=60)
    return fixed(features_core.warmed_up(f, 60).finish().select("symbol", "ts", "f__warmup_ok"))


@query("d04_tod_volume", sql(BARS_E, "mean_volume", f"""SELECT symbol, CAST({TOD} AS BIGINT) AS tod, avg(volume) AS mean_volume
  FROM bars GROUP BY 1, 2"""))
def tod_volume(spark, sf):
    from ..functions.timecols import utc_minute

    b = bars_e(spark, sf)
    return fixed(b.groupBy("symbol", utc_minute("ts").alias("tod")).agg(F.avg("volume").alias("mean_volume")))


@query("d05_tod_two_level_mean", sql(BARS_E + ",\n" + RVOL_MARKET, "tod_mean",
                                     "SELECT CAST(tod AS BIGINT) AS tod, tm AS tod_mean FROM tod"))
def tod_profile(spark, sf):
    return fixed(features_core.tod_volume_profile(bars_e(spark, sf)).toDF("tod", "tod_mean"))


# --- regime inputs ------------------------------------------------------------------------------


def regime_ctes(v: str = "basics") -> str:
    p = features_regime.VARIANTS[v]
    vn, sh, lo, an, bn, sn = (p[k] for k in ("vol_n", "short", "long", "adx_n", "band_n", "stress_n"))
    ln, c1, c2 = max(sn * 6, 30), p["vol_cut"], p["volume_cut"]
    warm = max(vn, lo, an, bn)
    return f"""r1 AS (SELECT *, {TOD} AS tod, {TR} AS tr, (close - lag(close) OVER w) / lag(close) OVER w AS ret,
  high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM bars {WINDOW}),
r2 AS (SELECT *, tr / close AS vol, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm,
  CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM r1),
r3 AS (SELECT *, {mp('avg({x})', 'tr', an, 3)} AS atr_s, {mp('avg({x})', 'pdm', an, 3)} AS pdm_s,
  {mp('avg({x})', 'mdm', an, 3)} AS mdm_s, {mp('avg({x})', 'vol', vn, 5)} AS rv,
  {mp('var_samp({x})', 'ret', sh, 3)} AS vs, {mp('var_samp({x})', 'ret', lo, 3)} AS vl,
  {mp('avg({x})', 'close', bn, 5)} AS ma, {mp('stddev_samp({x})', 'close', bn, 5)} AS sd,
  {mp('avg({x})', 'vol', sn, 3)} AS v_s, {mp('avg({x})', 'vol', ln, 3)} AS v_l,
  {mp('avg({x})', 'volume', sn, 3)} AS w_s, {mp('avg({x})', 'volume', ln, 3)} AS w_l,
  avg(vol) OVER (PARTITION BY symbol, tod ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_tod,
  avg(vol) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_sym,
  row_number() OVER w > {warm} AS f__regime__warmup_ok FROM r2 {WINDOW}),
r4 AS (SELECT *, 100.0 * pdm_s / CASE WHEN atr_s = 0 THEN 1.0 ELSE atr_s END AS pdi,
  100.0 * mdm_s / CASE WHEN atr_s = 0 THEN 1.0 ELSE atr_s END AS mdi,
  v_s / CASE WHEN v_l = 0 THEN 1.0 ELSE v_l END AS a, w_s / CASE WHEN w_l = 0 THEN 1.0 ELSE w_l END AS b FROM r3),
r5 AS (SELECT *, 100.0 * abs(pdi - mdi) / CASE WHEN pdi + mdi = 0 THEN 1.0 ELSE pdi + mdi END AS dx FROM r4),
regime AS (SELECT symbol, ts, open, high, low, close, volume,
  rv / nullif(coalesce(base_tod, base_sym), 0) AS f__regime__mod_vol_{vn},
  greatest(least(CASE WHEN vl > 0 THEN vs / vl ELSE 1.0 END, 10.0), 0.1) AS f__regime__var_ratio_{sh}_{lo},
  {mp('avg({x})', 'dx', an, 3)} AS f__regime__adx_proxy_{an},
  CASE WHEN sd IS NOT NULL THEN greatest(least((close - (ma - 2.0 * sd)) / CASE WHEN sd = 0 THEN 1.0 ELSE (ma + 2.0 * sd) - (ma - 2.0 * sd) END,
    1.5), -0.5) END AS "f__regime__band_pos_{bn}_2.0",
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(greatest(CASE WHEN a >= {c1} THEN a - 1 ELSE 0.0 END,
    CASE WHEN b >= {c2} THEN b - 1 ELSE 0.0 END, 0.0), 10.0) END AS f__regime__stress_{sn}_{sn},
  f__regime__warmup_ok FROM r5)"""


def regime_cols(v: str = "basics") -> str:
    p = features_regime.VARIANTS[v]
    return (f"f__regime__mod_vol_{p['vol_n']} f__regime__var_ratio_{p['short']}_{p['long']} "
            f"f__regime__adx_proxy_{p['adx_n']} \"f__regime__band_pos_{p['band_n']}_2.0\" "
            f"f__regime__stress_{p['stress_n']}_{p['stress_n']}")


for _name, _variant in (("e10_regime_pack", "basics"), ("e10_regime_pack_fast", "fast"), ("e10_regime_pack_slow", "slow")):
    query(_name, sql(BARS_E + ",\n" + regime_ctes(_variant), regime_cols(_variant), "SELECT * FROM regime"))(
        lambda spark, sf, v=_variant: fixed(features_regime.regime_pack(bars_e(spark, sf), v))
    )


# --- volume-price patterns ----------------------------------------------------------------------

VPA = f"""v1 AS (SELECT *, {mp('avg({x})', 'volume', 20, 10)} AS va,
  {mp('max({x})', 'high', 20, 10, prior(20))} AS ph, {mp('min({x})', 'low', 20, 10, prior(20))} AS pl,
  abs(close - open) AS body, lag(close) OVER w AS pclose, CAST(lag(volume) OVER w AS DOUBLE) AS pvol FROM bars {WINDOW}),
v2 AS (SELECT *, volume / nullif(va, 0) AS ratio, volume / (body + 1e-8) AS vpr, (close - pclose) / pclose AS pc,
  CASE WHEN pvol = 0 THEN CASE WHEN volume > 0 THEN 'inf'::DOUBLE END ELSE (volume - pvol) / pvol END AS vc FROM v1),
v3 AS (SELECT *, {mp('avg({x})', 'body', 5, 3)} AS bodyavg, {mp('quantile_cont({x}, 0.8)', 'vpr', 20, 10)} AS q80,
  list(vpr) OVER {roll(50)} AS lr, list(volume) OVER {roll(50)} AS lv FROM v2),
v4 AS (SELECT *, CASE WHEN len(lr) >= 20 THEN (len(list_filter(lr, lambda x: x < vpr)) + (len(list_filter(lr, lambda x: x = vpr)) + 1) / 2.0) / len(lr) END AS vprank,
  CASE WHEN len(lv) >= 20 THEN (len(list_filter(lv, lambda x: x < volume)) + (len(list_filter(lv, lambda x: x = volume)) + 1) / 2.0) / len(lv) END AS vrank,
  coalesce(close > ph, false) AS up, coalesce(close < pl, false) AS dn FROM v3),
vpa AS (SELECT symbol, ts, open, high, low, close, volume,
  coalesce(ratio > 2.0, false) AS p__vpa__volume_spike,
  CASE WHEN ratio IS NOT NULL THEN least(greatest((ratio - 1.0) / 1.0, 0.0), 1.0) END AS conf__vpa__volume_spike,
  up OR dn AS p__vpa__price_breakout,
  CASE WHEN (up OR dn) AND ph = pl THEN 1.0 WHEN up THEN least(greatest((close - ph) / (ph - pl) * 2, 0.0), 1.0)
    WHEN dn THEN least(greatest((pl - close) / (ph - pl) * 2, 0.0), 1.0) ELSE 0.0 END AS conf__vpa__price_breakout,
  coalesce(pc > 0 AND vc < -0.1, false) OR coalesce(pc < 0 AND vc > 0.1, false) AS p__vpa__volume_divergence,
  CASE WHEN isinf(vc) THEN CASE WHEN pc <> 0 THEN 1.0 END WHEN pc IS NOT NULL AND vc IS NOT NULL
    THEN least(abs(pc) * abs(vc) * 5, 1.0) END AS conf__vpa__volume_divergence,
  coalesce(vpr > q80 AND body < bodyavg * 0.5 AND volume > va, false) AS p__vpa__absorption,
  CASE WHEN vprank IS NOT NULL THEN least(greatest((vprank - 0.8) * 5, 0.0), 1.0) END AS conf__vpa__absorption,
  coalesce(vrank > 0.95, false) AS p__vpa__climax,
  CASE WHEN vrank IS NOT NULL THEN least(greatest((vrank - 0.95) / (1.0 - 0.95), 0.0), 1.0) END AS conf__vpa__climax FROM v4)"""
VPA_COLS = ("conf__vpa__volume_spike conf__vpa__price_breakout conf__vpa__volume_divergence "
            "conf__vpa__absorption conf__vpa__climax")


@query("e11_15_vpa_pack", sql(BARS_E + ",\n" + VPA, VPA_COLS, "SELECT * FROM vpa"))
def vpa(spark, sf):
    return fixed(features_vpa.vpa_pack(bars_e(spark, sf)))


# --- anchored prices ----------------------------------------------------------------------------
# The event data lies in January, when the market clock is UTC - 5 hours throughout.

HIST = "(PARTITION BY symbol, session_date ORDER BY ts ROWS UNBOUNDED PRECEDING)"
ANCHORS = """an AS (SELECT *, CAST(date_trunc('day', make_timestamp(ts // 1000) - INTERVAL 5 HOUR) AS DATE) AS session_date,
  epoch_us(date_trunc('day', make_timestamp(ts // 1000) - INTERVAL 5 HOUR)) * 1000 + 18000000000000 AS mid FROM bars),
anchored AS (SELECT * EXCLUDE (mid), mid + 34200000000000 AS session_start_ns, mid + 14400000000000 AS premarket_start_ns,
  mid + 37800000000000 AS first_hour_ns FROM an)"""
AVWAP = ANCHORS + f""",
ext AS (SELECT symbol, session_date, lag(max(high)) OVER (PARTITION BY symbol ORDER BY session_date) AS ph,
  lag(min(low)) OVER (PARTITION BY symbol ORDER BY session_date) AS pl FROM anchored GROUP BY symbol, session_date),
a1 AS (SELECT *, ts < session_start_ns AS pre, ts >= session_start_ns AND ts <= first_hour_ns AS h1,
  row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, session_date) AS n
  FROM anchored JOIN ext USING (symbol, session_date)),
a2 AS (SELECT *, sum(close * volume) OVER {HIST} AS cpv, sum(volume) OVER {HIST} AS cv,
  sum(CASE WHEN pre THEN close * volume END) OVER {HIST} AS ppv, sum(CASE WHEN pre THEN volume END) OVER {HIST} AS pv,
  sum(CASE WHEN h1 THEN close * volume END) OVER {HIST} AS hpv, sum(CASE WHEN h1 THEN volume END) OVER {HIST} AS hv,
  coalesce(high >= ph AND i >= least(6, n - 1), false) OR (ph IS NULL AND i = least(4, n - 1)) AS th,
  coalesce(low <= pl AND i >= least(6, n - 1), false) OR (pl IS NULL AND i = least(4, n - 1)) AS tl FROM a1),
a3 AS (SELECT *, CASE WHEN pre AND pv > 0 THEN ppv / pv END AS pm,
  sum(CASE WHEN th THEN 1 ELSE 0 END) OVER {HIST} AS hid, sum(CASE WHEN tl THEN 1 ELSE 0 END) OVER {HIST} AS lid FROM a2),
avwap AS (SELECT symbol, session_date, ts, open, high, low, close, volume, session_start_ns, premarket_start_ns, first_hour_ns,
  CASE WHEN cv > 0 THEN cpv / cv ELSE close END AS f__anchor__session_avwap,
  coalesce(last_value(pm IGNORE NULLS) OVER {HIST}, close) AS f__anchor__premarket_avwap,
  CASE WHEN h1 OR ts > first_hour_ns THEN coalesce(hpv / nullif(hv, 0), close) ELSE close END AS f__anchor__first_hour_avwap,
  CASE WHEN hid > 0 THEN max(CASE WHEN th AND volume > 0 THEN close END) OVER (PARTITION BY symbol, session_date, hid) END AS f__anchor__prev_high_avwap,
  CASE WHEN lid > 0 THEN max(CASE WHEN tl AND volume > 0 THEN close END) OVER (PARTITION BY symbol, session_date, lid) END AS f__anchor__prev_low_avwap
  FROM a3)"""
AVWAP_COLS = ("f__anchor__session_avwap f__anchor__premarket_avwap f__anchor__first_hour_avwap "
              "f__anchor__prev_high_avwap f__anchor__prev_low_avwap")


@query("b15_session_anchors", sql(BARS_E + ",\n" + ANCHORS, "", "SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date) FROM anchored"))
def anchors(spark, sf):
    return fixed(features_anchored.session_anchors(bars_e(spark, sf)))


@query("e16_19_avwap_pack", sql(BARS_E + ",\n" + AVWAP, AVWAP_COLS, "SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date) FROM avwap"))
def avwap(spark, sf):
    return fixed(features_anchored.avwap_pack(bars_e(spark, sf)))
