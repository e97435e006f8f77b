"""Sizing, stops, exposure, risk scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.timecols import idiv
from ..operators import risk
from ..operators.features_core import add_atr
from ..operators.series import split_series
from . import query
from .core import TR, WINDOW
from .data import BARS_E, BARS_L, bars_e, bars_l, fixed, mp, roll, sql, table

ATR = f"""ba AS (SELECT symbol, ts, close, volume, avg(tr) OVER {roll(14)} AS atr, CASE volume % 5 WHEN 0 THEN 'BULL' WHEN 1 THEN 'BEAR' WHEN 2 THEN 'SIDEWAYS' WHEN 3 THEN 'STRESS' ELSE 'OFF' END AS regime,
  CASE WHEN volume % 2 = 0 THEN 'long' ELSE 'short' END AS side FROM (SELECT *, {TR} AS tr FROM bars {WINDOW}))"""


def with_atr(spark, sf):
    f = split_series(bars_e(spark, sf), lookback=16)
    f = add_atr(f, {"atr": 14})
    v = F.col("volume")
    r = F.when(v % 5 == 0, "BULL").when(v % 5 == 1, "BEAR").when(v % 5 == 2, "SIDEWAYS").when(v % 5 == 3, "STRESS").otherwise("OFF")
    return f.with_cols(regime=r, side=F.when(v % 2 == 0, "long").otherwise("short")).finish()


@query("o01_atr_quantity", sql(BARS_E + ",\n" + ATR, "", """SELECT symbol, ts, CASE WHEN atr > 0 AND floor(1e6 / close) > 0 THEN CAST(greatest(least(floor(0.02::DOUBLE * 1e6 / (atr * 1.0)), floor(1e6 / close)), 1) AS BIGINT) END AS qty,
  CASE WHEN atr > 0 AND floor(1e6 / close) > 0 THEN CAST(greatest(least(floor(least(greatest(0.02::DOUBLE * rm, 0.001), 0.1) * 1e6 / (atr * least(greatest(1.0::DOUBLE * am, 0.5), 3.0))), floor(1e6 / close)), 1) AS BIGINT) END AS regime_qty
  FROM (SELECT *, CASE regime WHEN 'BEAR' THEN 0.8::DOUBLE WHEN 'SIDEWAYS' THEN 0.9::DOUBLE WHEN 'STRESS' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS rm, CASE regime WHEN 'BEAR' THEN 1.2::DOUBLE WHEN 'SIDEWAYS' THEN 1.1::DOUBLE WHEN 'STRESS' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS am FROM ba)"""))
def quantity(spark, sf):
    q = lambda r=None: risk.atr_quantity(F.col("close"), F.col("atr"), 1e6, regime=r)
    return with_atr(spark, sf).select("symbol", "ts", q().alias("qty"), q(F.col("regime")).alias("regime_qty"))


@query("o02_stops_and_context", sql(BARS_E + ",\n" + ATR, "stop_price target_price", """SELECT symbol, ts, close - atr * 1.5 AS stop_price, close + atr * 1.5 AS target_price, regime = 'STRESS' AS rejected,
  CASE regime WHEN 'BEAR' THEN 'conservative' WHEN 'SIDEWAYS' THEN 'neutral' WHEN 'STRESS' THEN 'stress' ELSE 'normal' END AS risk_mode, CAST(CASE regime WHEN 'BEAR' THEN 0.2 WHEN 'SIDEWAYS' THEN 0.1 WHEN 'STRESS' THEN 0.7 ELSE 0.0 END AS DOUBLE) AS risk_reduction FROM ba"""))
def stops(spark, sf):
    df = risk.regime_context(risk.stop_and_target(with_atr(spark, sf), 1.5))
    return fixed(df.select("symbol", "ts", "stop_price", "target_price", "rejected", "risk_mode", "risk_reduction"))


@query("o03_risk_levels", sql(BARS_E + ",\n" + ATR, "stop_pct take_profit_pct risk_stop_price risk_target_price", """SELECT symbol, ts, d / close AS stop_pct, d * 1.5 / close AS take_profit_pct, CASE WHEN side = 'long' THEN close - d ELSE close + d END AS risk_stop_price,
  CASE WHEN side = 'long' THEN close + d * 1.5 ELSE close - d * 1.5 END AS risk_target_price, CASE WHEN d IS NOT NULL THEN 1.5::DOUBLE END AS expected_r FROM (SELECT *, CASE WHEN atr > 0 THEN least(greatest(atr, close * 0.0005), close * 0.05) END AS d FROM ba)"""))
def levels(spark, sf):
    df = risk.risk_levels(with_atr(spark, sf))
    return fixed(df.select("symbol", "ts", "stop_pct", "take_profit_pct", "risk_stop_price", "risk_target_price", "expected_r"))


PATH = ATR + """, pth AS (SELECT symbol || '-' || CAST(ts // 86400000000000 AS VARCHAR) AS trade_id, ts, CASE WHEN ts // 86400000000000 % 2 = 0 THEN 'long' ELSE 'short' END AS side, close AS price, greatest(atr, 1.0) AS atr,
  first_value(close) OVER (PARTITION BY symbol, ts // 86400000000000 ORDER BY ts) AS entry_price FROM ba),
p1 AS (SELECT *, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg, row_number() OVER (PARTITION BY trade_id ORDER BY ts) AS i FROM pth),
p2 AS (SELECT *, max(price * sg) OVER h AS best, first_value(entry_price * sg - atr * 2.0) OVER h AS init, max(CASE WHEN i > 1 AND (price - entry_price) * sg / atr >= 0.5 THEN 1 ELSE 0 END) OVER h AS act FROM p1 WINDOW h AS (PARTITION BY trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
p3 AS (SELECT *, greatest(init, max(CASE WHEN act = 1 THEN best - atr * 1.5 END) OVER (PARTITION BY trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING)) * sg AS stop FROM p2)"""


@query("o04_trailing_stops", sql(BARS_E + ",\n" + PATH, "stop", "SELECT trade_id, ts, side, stop FROM p3"))
def trailing(spark, sf):
    day = idiv(F.col("ts"), 86_400_000_000_000)
    df = with_atr(spark, sf).select(
        F.concat_ws("-", "symbol", day.cast("string")).alias("trade_id"), "ts", F.when(day % 2 == 0, "long").otherwise("short").alias("side"), F.col("close").alias("price"),
        F.greatest("atr", F.lit(1.0)).alias("atr"))
    entry = df.groupBy("trade_id").agg(F.min_by("price", "ts").alias("entry_price"))
    return fixed(risk.trailing_stops(df.join(entry, "trade_id"), activation=0.5).select("trade_id", "ts", "side", "stop"))


SIG = """sg AS (SELECT c_custkey AS id, c_custkey % 21 / 10.0 - 1 AS signal_strength, (c_custkey % 50) / 1000.0 AS volatility, (c_custkey % 97) / 97.0 AS confidence FROM customer)"""


def sizing_rows(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (k % 21 / 10.0 - 1).alias("signal_strength"), (k % 50 / 1000.0).alias("volatility"), (k % 97 / 97.0).alias("confidence"))


@query("o05_position_sizes", sql(SIG, "size", " UNION ALL ".join(f"SELECT '{m}' AS method, id, least({e}, 1000.0) AS size, {e} > 1000.0 AS was_capped FROM sg" for m, e in {
    "fixed": "abs(signal_strength) * 1500.0", "volatility": "3000.0 * (0.02 / greatest(volatility, 0.01)) * abs(signal_strength)",
    "kelly": "coalesce(least(greatest((confidence * abs(signal_strength) * volatility * 2 - (1 - confidence) * volatility * 1.5) / nullif(volatility * 1.5, 0), 0), 0.25), 0) * 3000.0",
    "risk_parity": "100.0 / nullif(volatility * sqrt(252), 0) * abs(signal_strength)"}.items())))
def sizes(spark, sf):
    df = sizing_rows(spark, sf)
    out = None
    for m in ("fixed", "volatility", "kelly", "risk_parity"):
        part = risk.position_sizes(df, m, 3000.0, 50_000.0, 0.02).select(F.lit(m).alias("method"), "id", "size", "was_capped")
        out = part if out is None else out.unionByName(part)
    return fixed(out)


POS = """ps AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_mktsegment AS sector, c_nationkey AS currency, floor(c_acctbal) AS size, CAST(10 + c_custkey % 50 AS DOUBLE) AS price, CAST(10 + c_custkey % 50 AS DOUBLE) AS entry_price,
  10 + c_custkey % 50 + c_custkey % 13 / 10.0::DOUBLE - 0.5 AS current_price FROM customer)"""


def positions(spark, sf):
    k = F.col("c_custkey")
    p = (F.lit(10) + k % 50).cast("double")
    return table(spark, sf, "customer").select(
        k.cast("string").alias("symbol"), F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").alias("currency"), F.floor("c_acctbal").cast("double").alias("size"),
        p.alias("price"), p.alias("entry_price"), (p + k % 13 / 10.0 - 0.5).alias("current_price"))


def _exp(by: str) -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT {g}le AS long_exposure, se AS short_exposure, mp AS max_position, le + se AS gross_exposure, le - se AS net_exposure, (le + se) / 1e7 AS leverage, mp / 1e7 AS concentration FROM (SELECT {g}coalesce(sum(size * price) FILTER (size > 0), 0) AS le,
  coalesce(sum(abs(size * price)) FILTER (size < 0), 0) AS se, max(abs(size * price)) AS mp FROM ps {'GROUP BY ' + by if by else ''})"""


for _name, _by in (("o06_exposure", ""), ("o06_sector_exposure", "sector"), ("o06_currency_exposure", "currency")):
    query(_name, sql(POS, "leverage concentration", _exp(_by).replace("currency,", "CAST(currency AS BIGINT) AS currency,", 1) if _by == "currency" else _exp(_by)))(
        lambda spark, sf, b=_by: fixed(risk.exposures(positions(spark, sf), 1e7, [b] if b else None)))


@query("o06_limit_alerts", sql(POS, "utilization", """SELECT 'sector' AS limit_name, sector, g AS current_value, 6.0e7::DOUBLE AS limit_value, g / 6.0e7 AS utilization, CASE WHEN g / 6.0e7 >= 0.7 THEN 'critical' ELSE 'warning' END AS severity FROM
  (SELECT sector, sum(abs(size * price)) AS g FROM ps GROUP BY 1) WHERE g / 6.0e7 >= 0.5"""))
def alerts(spark, sf):
    e = risk.exposures(positions(spark, sf), 1e7, ["sector"]).select(F.lit("sector").alias("limit_name"), "sector", F.col("gross_exposure").alias("current_value"))
    return fixed(risk.limit_alerts(e, {"sector": 6.0e7}, 0.5, 0.7))


@query("o06_price_scenarios", sql(POS, "exposure", "SELECT s AS scenario, (SELECT sum(size * price) FROM ps) * (1 + c) AS exposure FROM (VALUES ('crash', -0.2::DOUBLE), ('dip', -0.05::DOUBLE), ('rally', 0.1::DOUBLE)) v(s, c)"))
def scenarios(spark, sf):
    return fixed(risk.price_scenarios(positions(spark, sf), {"crash": -0.2, "dip": -0.05, "rally": 0.1}))


RISKS = POS + f""", r1 AS (SELECT *, abs(current_price - entry_price) / entry_price * {math.sqrt(252)!r} AS volatility, size * current_price AS v, abs(least((current_price - entry_price) / entry_price * 100, 0)) AS max_drawdown FROM ps),
r2 AS (SELECT *, abs(v * volatility * 1.65) AS var_95, abs(v * volatility * 2.33) AS var_99 FROM r1),
rk AS (SELECT *, 0.3 * least(1.0, volatility * 10) + 0.2 * CASE WHEN v > 0 THEN least(1.0, var_95 / v) ELSE 0 END + 0.15 * least(1.0, max_drawdown / 10) + 0.1 * least(1.0, abs(size) / 10000) + 0.055 AS risk_score FROM r2)"""
LEVEL = "CASE WHEN risk_score < 0.3 THEN 'low' WHEN risk_score < 0.6 THEN 'medium' WHEN risk_score < 0.8 THEN 'high' ELSE 'critical' END"


@query("o07_position_risk", sql(RISKS, "volatility var_95 var_99 max_drawdown risk_score", f"SELECT symbol, volatility, var_95, var_99, max_drawdown, risk_score, {LEVEL} AS risk_level FROM rk"))
def position_risk(spark, sf):
    return fixed(risk.position_risk(positions(spark, sf)).select("symbol", "volatility", "var_95", "var_99", "max_drawdown", "risk_score", "risk_level"))


@query("o07_portfolio_risk", sql(RISKS, "var_95 var_99 volatility max_drawdown risk_score", f"""SELECT *, {LEVEL} AS risk_level FROM (SELECT *, 0.3 * least(1.0, volatility * 10) + 0.2 * least(1.0, var_95 / 100000) + 0.15 * least(1.0, max_drawdown / 10) + 0.15 * least(1.0, positions * 0.1) + 0.03 AS risk_score FROM
  (SELECT sum(var_95) AS var_95, sum(var_99) AS var_99, avg(volatility) AS volatility, max(max_drawdown) AS max_drawdown, count(*) AS positions FROM rk))""", 4))
def portfolio(spark, sf):
    return fixed(risk.portfolio_risk(risk.position_risk(positions(spark, sf))), 4)


@query("o08_limit_violations", sql(RISKS, "value", """SELECT symbol, 'vol' AS limit_name, 'volatility' AS metric, volatility AS value, 0.3::DOUBLE AS threshold FROM rk WHERE volatility > 0.3 UNION ALL
  SELECT symbol, 'score', 'risk_score', risk_score, 0.6::DOUBLE FROM rk WHERE risk_score >= 0.6"""))
def violations(spark, sf):
    r = risk.position_risk(positions(spark, sf))
    v = risk.limit_violations(r, [("vol", "volatility", ">", 0.3), ("score", "risk_score", ">=", 0.6)])
    return fixed(v.select("symbol", "limit_name", "metric", "value", "threshold"))


@query("o09_size_from_range", sql(BARS_L, "", f"""SELECT b.symbol, b.ts, b.close, r.atr, CAST(greatest(least(floor(0.02::DOUBLE * 1e7 / (r.atr * 1.0)), floor(1e7 / b.close)), 1) AS BIGINT) AS qty, 0.02::DOUBLE AS risk_frac FROM bars b JOIN
  (SELECT symbol, arg_max(x, ts) AS atr FROM (SELECT symbol, ts, {mp('max({x})', 'high', 14, 14)} - {mp('min({x})', 'low', 14, 14)} AS x FROM bars) GROUP BY 1) r USING (symbol) WHERE b.volume > 100 AND r.atr > 0 AND floor(1e7 / b.close) > 0"""))
def from_range(spark, sf):
    b = bars_l(spark, sf)
    df = risk.size_from_range(b.where("volume > 100").select("symbol", "ts", "close"), b, equity=1e7)
    return fixed(df.select("symbol", "ts", "close", "atr", "qty", "risk_frac"))


@query("o10_adjust_prediction", sql(RISKS, "adjusted_score adjusted_prediction", f"""SELECT symbol, a AS adjusted_score, {LEVEL.replace('risk_score', 'a')} AS risk_level, prediction * greatest(1 - a * 0.5, 0.1) AS adjusted_prediction, CAST(CASE WHEN a < 0.3 THEN 1.0 WHEN a < 0.6 THEN 0.75 WHEN a < 0.8 THEN 0.5 ELSE 0.1 END AS DOUBLE) AS size_multiplier,
  array_to_string(list_filter([CASE WHEN a > 0.5 THEN 'risk_score' END, CASE WHEN exposure > 200000 THEN 'exposure' END, CASE WHEN a >= 0.8 THEN 'critical_level' END], lambda x: x IS NOT NULL), ',') AS block_reasons FROM (SELECT *, CASE WHEN liquidity < 0.3 THEN least(s2 * 1.15, 1.0) ELSE s2 END AS a FROM (
  SELECT *, CASE WHEN volatility > 0.3 THEN least(s1 * 1.1, 1.0) ELSE s1 END AS s2 FROM (SELECT *, CASE WHEN abs(prediction) > 2 THEN least(risk_score * 1.2, 1.0) WHEN abs(prediction) < 0.1 THEN risk_score * 0.9 ELSE risk_score END AS s1 FROM (
  SELECT *, current_price % 5 - 2.5 AS prediction, price % 10 / 10.0 AS liquidity, abs(v) AS exposure FROM rk))))"""))
def adjusted(spark, sf):
    r = risk.position_risk(positions(spark, sf)).withColumns({
        "prediction": F.col("current_price") % 5.0 - 2.5, "liquidity": F.col("price") % 10.0 / 10.0, "exposure": F.abs(F.col("size") * F.col("current_price")), "exposure_limit": F.lit(200_000.0)})
    a = risk.adjust_prediction(r, max_score=0.5).withColumn("block_reasons", F.concat_ws(",", "block_reasons"))
    return fixed(a.select("symbol", "adjusted_score", "risk_level", "adjusted_prediction", "size_multiplier", "block_reasons"))


@query("c13_sizing_grid", sql(BARS_E + ",\n" + ATR, "", """SELECT symbol, combo, count(*) AS rows, CAST(sum(CAST(greatest(least(floor(frac * 1e6 / nullif(atr * mult, 0)), floor(1e6 / close)), 1) AS BIGINT)) AS BIGINT) AS total_qty FROM ba,
  (VALUES (0, 0.01::DOUBLE, 1.0::DOUBLE), (1, 0.01::DOUBLE, 2.0::DOUBLE), (2, 0.02::DOUBLE, 1.0::DOUBLE), (3, 0.02::DOUBLE, 2.0::DOUBLE)) g(combo, frac, mult) WHERE atr > 0 GROUP BY 1, 2""").replace("combo, count(*)", "CAST(combo AS BIGINT) AS combo, count(*)"))
def sizing_grid(spark, sf):
    df = with_atr(spark, sf).where("atr > 0").select("symbol", "ts", "close", "atr")
    g = risk.sizing_grid(df, {"frac": [0.01, 0.02], "mult": [1.0, 2.0]}, 1e6)
    return fixed(g.groupBy("symbol", "combo").agg(F.count(F.lit(1)).alias("rows"), F.sum("qty").alias("total_qty")))
