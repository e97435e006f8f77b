"""Universe screens, shortlists, gating, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import session_date
from ..operators import screen
from ..operators.quantiles import exact_percentiles
from . import query
from .core import TOD
from .data import BARS_E, BARS_L, bars_e, bars_l, fixed, sql, table

CFG = screen.ScreenConfig(top_n=8, min_price=80_000, max_price=150_000, min_relative_volume=0.5, min_dollar_volume=1e6, exclude=("S7",))
METRICS = f"""rv AS (SELECT *, volume / CASE WHEN m = 0 THEN 1.0 ELSE m END AS relative_volume FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol, {TOD}) AS m FROM bars)),
dv AS (SELECT symbol, avg(d) AS avg_daily_dollar_volume FROM (SELECT symbol, ts // 86400000000000 AS day, sum(close * volume) AS d FROM bars GROUP BY 1, 2) GROUP BY 1),
latest AS (SELECT symbol, ts, open, high, low, close, volume, relative_volume, avg_daily_dollar_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM rv) JOIN dv USING (symbol) WHERE rn = 1),
passed AS (SELECT * FROM latest WHERE close BETWEEN 80000 AND 150000 AND relative_volume >= 0.5 AND avg_daily_dollar_volume >= 1e6 AND symbol <> 'S7'),
chosen AS (SELECT *, close * volume AS dollar_volume FROM passed ORDER BY relative_volume DESC, symbol LIMIT 8)"""
SCREEN_COLS = "relative_volume avg_daily_dollar_volume"


@query("f03_f04_screen_universe", sql(BARS_L + ",\n" + METRICS, SCREEN_COLS + " rvol_rank",
       "SELECT *, CAST(rank() OVER (ORDER BY relative_volume DESC) AS DOUBLE) AS rvol_rank FROM chosen"))
def screened(spark, sf):
    return fixed(screen.screen_universe(bars_l(spark, sf), CFG))


@query("f03_latest_rows", sql(BARS_L + ",\n" + METRICS, SCREEN_COLS, "SELECT * FROM latest"))
def latest(spark, sf):
    return fixed(screen.latest_with_metrics(bars_l(spark, sf)))


@query("d06_avg_daily_dollar_volume", sql(BARS_E + ",\n" + METRICS, "avg_daily_dollar_volume", "SELECT * FROM dv"))
def dollar_volume(spark, sf):
    return fixed(screen.avg_daily_dollar_volume(bars_e(spark, sf)))


PHASES = {"train": ("1995-01-01", "1998-12-31"), "oos": ("1999-01-01", "2001-12-31")}
COVER = """cov AS (SELECT symbol, count(*) AS total_days, count(*) FILTER (d BETWEEN '1995-01-01' AND '1998-12-31') AS train_days,
  count(*) FILTER (d BETWEEN '1999-01-01' AND '2001-12-31') AS oos_days
  FROM (SELECT DISTINCT symbol, strftime(make_timestamp(ts // 1000), '%Y-%m-%d') AS d FROM bars) GROUP BY symbol)"""


@query("k11_universe_report", sql(BARS_L + ",\n" + METRICS + ",\n" + COVER + """, cand AS (SELECT DISTINCT 'S' || CAST(p_partkey AS VARCHAR) AS symbol FROM part UNION SELECT symbol FROM latest)""",
       SCREEN_COLS, """SELECT c.symbol, l.close AS latest_close, relative_volume, avg_daily_dollar_volume, ch.symbol IS NOT NULL AS selected,
  coalesce(total_days, 0) AS total_days, coalesce(train_days, 0) AS train_days, coalesce(oos_days, 0) AS oos_days,
  array_to_string(list_filter([CASE WHEN l.symbol IS NULL THEN 'missing_data' END, CASE WHEN l.close < 80000 THEN 'price_below_min' END, CASE WHEN l.close > 150000 THEN 'price_above_max' END,
    CASE WHEN l.relative_volume < 0.5 THEN 'low_relative_volume' END, CASE WHEN avg_daily_dollar_volume < 1e6 THEN 'low_avg_dollar_volume' END, CASE WHEN c.symbol = 'S7' THEN 'excluded_symbol' END,
    CASE WHEN c.symbol IN (SELECT symbol FROM passed) AND ch.symbol IS NULL THEN 'below_top_n_cut' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM cand c LEFT JOIN latest l USING (symbol) LEFT JOIN (SELECT symbol FROM chosen) ch USING (symbol) LEFT JOIN cov USING (symbol)"""))
def report(spark, sf):
    cand = table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("symbol"))
    df = screen.universe_report(bars_l(spark, sf), cand, CFG, PHASES)
    return fixed(df.withColumn("reasons", F.concat_ws(",", "reasons")))


@query("d16_universe_stats", sql(BARS_L + ",\n" + METRICS, "mean_dv mean_rvol", """SELECT count(*) AS symbols, min(close) AS min_price, max(close) AS max_price,
  avg(avg_daily_dollar_volume) AS mean_dv, avg(relative_volume) AS mean_rvol FROM passed"""))
def stats(spark, sf):
    return fixed(screen.universe_stats(screen.latest_with_metrics(bars_l(spark, sf)).where(screen.passes_filters(CFG))))


@query("d07_symbol_stats", sql(BARS_L, "mean_daily_dv median_close", """SELECT symbol, median_close, mean_daily_dv, days FROM
  (SELECT symbol, quantile_cont(close, 0.5) AS median_close FROM bars GROUP BY 1) JOIN (SELECT symbol, avg(dv) AS mean_daily_dv, count(*) AS days FROM
  (SELECT symbol, ts // 86400000000000 AS d, sum(close * volume) AS dv FROM bars GROUP BY 1, 2) GROUP BY 1) USING (symbol)
  WHERE median_close BETWEEN 190000 AND 215000 AND mean_daily_dv >= 1e6 AND days >= 10"""))
def symbol_stats(spark, sf):
    return fixed(screen.eligible_symbols(screen.symbol_stats(bars_l(spark, sf)), 190_000, 215_000, 1e6, 10))


@query("d19_exact_percentiles", sql("", "q05 q50 q95", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS q05, quantile_cont(l_extendedprice, 0.5) AS q50,
  quantile_cont(l_extendedprice, 0.95) AS q95 FROM lineitem GROUP BY 1"""))
def percentiles(spark, sf):
    return fixed(exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95}))


# --- premarket shortlist, for every day at once ----------------------------------------------------

SHORT = """et AS (SELECT *, make_timestamp(ts // 1000) - INTERVAL 5 HOUR AS t FROM bars),
dayagg AS (SELECT symbol, CAST(t AS DATE) AS trade_date, arg_max(close, ts) FILTER (hour(t) * 60 + minute(t) >= 240 AND hour(t) * 60 + minute(t) < 570) AS pc,
  sum(volume) FILTER (hour(t) * 60 + minute(t) >= 240 AND hour(t) * 60 + minute(t) < 570) AS pv, arg_max(close, ts) FILTER (hour(t) * 60 + minute(t) BETWEEN 570 AND 589) AS xc,
  sum(volume) FILTER (hour(t) * 60 + minute(t) BETWEEN 570 AND 589) AS xv, arg_min(open, ts) FILTER (hour(t) BETWEEN 9 AND 15) AS open,
  arg_max(close, ts) FILTER (hour(t) BETWEEN 9 AND 16) AS lastc FROM et GROUP BY 1, 2),
prevs AS (SELECT d.*, max(pv IS NOT NULL) OVER (PARTITION BY trade_date) AS has, (SELECT arg_max(p.lastc, p.trade_date) FROM dayagg p WHERE p.symbol = d.symbol AND p.lastc IS NOT NULL
  AND p.trade_date BETWEEN d.trade_date - 5 AND d.trade_date - 1) AS prev_close FROM dayagg d),
pre AS (SELECT trade_date, symbol, open, prev_close, CASE WHEN has THEN pc * pv ELSE xc * xv END AS premarket_dv, (open - prev_close) / prev_close AS gap_pct FROM prevs
  WHERE open IS NOT NULL AND prev_close > 0 AND CASE WHEN has THEN pc * pv ELSE xc * xv END IS NOT NULL),
scored AS (SELECT *, 0.6 * CASE WHEN s1 = 0 THEN 0.0 ELSE (premarket_dv - m1) / s1 END + 0.4 * CASE WHEN s2 = 0 THEN 0.0 ELSE (abs(gap_pct) - m2) / s2 END AS score FROM
  (SELECT *, stddev_samp(premarket_dv) OVER d AS s1, avg(premarket_dv) OVER d AS m1, stddev_samp(abs(gap_pct)) OVER d AS s2, avg(abs(gap_pct)) OVER d AS m2 FROM pre WINDOW d AS (PARTITION BY trade_date))),
shortlist AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, symbol) AS rank FROM scored QUALIFY rank <= 3)"""


@query("f06_premarket_shortlist", sql(BARS_E + ",\n" + SHORT, "gap_pct score",
       "SELECT CAST(trade_date AS VARCHAR) AS trade_date, symbol, open, prev_close, premarket_dv, gap_pct, score, rank FROM shortlist"))
def shortlist(spark, sf):
    return fixed(screen.premarket_shortlist(bars_e(spark, sf), top_k=3))


@query("d08_d09_premarket_metrics", sql(BARS_E + ",\n" + SHORT, "gap_pct",
       "SELECT CAST(trade_date AS VARCHAR) AS trade_date, symbol, open, prev_close, premarket_dv, gap_pct FROM pre"))
def premarket(spark, sf):
    return fixed(screen.premarket_metrics(bars_e(spark, sf)))


@query("k13_broadcast_universe", sql(BARS_E + ",\n" + SHORT, "", """SELECT DISTINCT et.ts, s.symbol FROM et JOIN shortlist s ON CAST(et.t AS DATE) = s.trade_date
  WHERE hour(t) * 60 + minute(t) >= 570 AND hour(t) * 60 + minute(t) < 960"""))
def universe(spark, sf):
    b = bars_e(spark, sf)
    return screen.broadcast_universe(b, screen.premarket_shortlist(b, top_k=3))


PHAT = """phat AS (SELECT symbol, ts, (ts // 1800000000000 * 13 + volume * 7) % 100 / 100.0 AS p_hat FROM bars WHERE volume % 9 <> 0)"""


def p_hat(b):
    from ..functions.timecols import idiv

    return b.where("volume % 9 != 0").select("symbol", "ts", (
        F.pmod(idiv(F.col("ts"), 1_800_000_000_000) * 13 + F.col("volume") * 7, F.lit(100)) / 100.0).alias("p_hat"))


@query("k13_minute_gate", sql(BARS_E + ",\n" + SHORT + ",\n" + PHAT, "", """SELECT ts, symbol, p_hat FROM (SELECT et.ts, et.symbol, p_hat,
  min(p_hat) OVER w AS mn, count(p_hat) OVER w AS n FROM et JOIN shortlist s ON CAST(et.t AS DATE) = s.trade_date AND et.symbol = s.symbol LEFT JOIN phat ON et.symbol = phat.symbol AND et.ts = phat.ts
  WHERE hour(t) * 60 + minute(t) >= 570 AND hour(t) * 60 + minute(t) < 960
  WINDOW w AS (PARTITION BY et.symbol, s.trade_date ORDER BY et.ts RANGE BETWEEN 3600000000000 PRECEDING AND CURRENT ROW)) WHERE p_hat >= 0.3 AND mn >= 0.3 AND n >= 2"""))
def gated(spark, sf):
    b = bars_e(spark, sf)
    # Bars are half-hourly, so two readings in the last hour are what a persistent state can show.
    return screen.minute_gate(b, screen.premarket_shortlist(b, top_k=3), p_hat(b), 0.3, 60, readings=2)


@query("c08_universe_membership", sql(BARS_E + ",\n" + SHORT, "", """SELECT symbol, ts, (symbol, ts) IN (SELECT s.symbol, e2.ts FROM et e2 JOIN shortlist s ON CAST(e2.t AS DATE) = s.trade_date
   WHERE hour(e2.t) * 60 + minute(e2.t) >= 570 AND hour(e2.t) * 60 + minute(e2.t) < 960) OR NOT (ts IN (SELECT e3.ts FROM et e3 JOIN shortlist s3 ON CAST(e3.t AS DATE) = s3.trade_date
   WHERE hour(e3.t) * 60 + minute(e3.t) >= 570 AND hour(e3.t) * 60 + minute(e3.t) < 960)) AS in_universe FROM bars"""))
def membership_flag(spark, sf):
    b = bars_e(spark, sf)
    uni = screen.broadcast_universe(b, screen.premarket_shortlist(b, top_k=3))
    return screen.in_universe(b.select("symbol", "ts"), uni)


@query("f14_phase_symbols", sql(BARS_E + ",\n" + SHORT, "", """SELECT symbol, count(*) AS days FROM shortlist WHERE trade_date BETWEEN '2024-01-05' AND '2024-01-25'
  AND symbol <> 'VIEW-0' GROUP BY symbol ORDER BY days DESC, symbol LIMIT 3"""))
def phase(spark, sf):
    from ..sources.membership import membership_rows

    b = bars_e(spark, sf)
    rows = membership_rows(screen.premarket_shortlist(b, top_k=3), b.select("symbol", session_date("ts").alias("trade_date")))
    cand = b.select("symbol").where("symbol != 'VIEW-0'")
    return screen.phase_symbols(rows, cand, "2024-01-05", "2024-01-25", max_symbols=3)


@query("k12_membership_rows", sql(BARS_E + ",\n" + SHORT, "", """SELECT DISTINCT CAST(d.trade_date AS VARCHAR) AS trade_date, d.symbol, s.symbol IS NOT NULL AS is_sip
  FROM dayagg d LEFT JOIN shortlist s ON d.symbol = s.symbol AND d.trade_date = s.trade_date"""))
def membership(spark, sf):
    from ..sources.membership import membership_rows

    b = bars_e(spark, sf)
    return membership_rows(screen.premarket_shortlist(b, top_k=3), b.select("symbol", session_date("ts").alias("trade_date")))


# --- guards -----------------------------------------------------------------------------------------

LABELS = "lab AS (SELECT symbol, ts, CASE WHEN volume % 10 = 0 THEN 1 WHEN volume % 10 = 1 THEN -1 ELSE 0 END AS label FROM bars)"


def labelled(b):
    v = F.col("volume") % 10
    return b.select("symbol", "ts", F.when(v == 0, 1).when(v == 1, -1).otherwise(0).alias("label"))


@query("d13_label_guard", sql(BARS_L + ",\n" + LABELS, "", """SELECT symbol, long_labels, short_labels, long_labels + short_labels AS total_directional,
  array_to_string(list_filter([CASE WHEN long_labels < 28 THEN 'insufficient_long' END, CASE WHEN short_labels < 28 THEN 'insufficient_short' END,
  CASE WHEN long_labels + short_labels < 60 THEN 'insufficient_total' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN long_labels < 28 OR short_labels < 28 OR long_labels + short_labels < 60 THEN 'dropped' ELSE 'kept' END AS status
  FROM (SELECT symbol, count(*) FILTER (label = 1) AS long_labels, count(*) FILTER (label = -1) AS short_labels FROM lab GROUP BY 1)"""))
def label_guard(spark, sf):
    df = screen.label_guard(labelled(bars_l(spark, sf)), 28, 60)
    return df.withColumn("reasons", F.concat_ws(",", "reasons"))


@query("d14_coverage_guard", sql(BARS_L + ",\n" + COVER, "", """SELECT symbol, total_days, train_days, oos_days, array_to_string(list_filter([CASE WHEN total_days < tn THEN 'insufficient_total_days' END,
  CASE WHEN train_days < rn THEN 'insufficient_train_days' END, CASE WHEN oos_days < o THEN 'insufficient_oos_days' END], lambda x: x IS NOT NULL), ',') AS reasons,
  total_days < tn OR train_days < rn AS drop_training, total_days < tn OR oos_days < o AS drop_deployment
  FROM (SELECT *, greatest(5, ceil(max(total_days) OVER () * 0.95)) AS tn, greatest(5, ceil(max(train_days) OVER () * 0.95)) AS rn, greatest(5, ceil(max(oos_days) OVER () * 0.95)) AS o FROM cov)"""))
def coverage_guard(spark, sf):
    c = screen.coverage_days(bars_l(spark, sf), PHASES)
    df = screen.coverage_guard(c, {"total": 5, "train": 5, "oos": 5}, 0.05)
    return df.withColumn("reasons", F.concat_ws(",", "reasons"))


@query("d12_label_distribution", sql(BARS_E + ",\n" + LABELS, "", """SELECT symbol, ts // 86400000000000 AS day, count(*) FILTER (label = -1) AS short, count(*) FILTER (label = 0) AS flat,
  count(*) FILTER (label = 1) AS long FROM lab GROUP BY 1, 2"""))
def distribution(spark, sf):
    from ..operators.datasets import label_distribution

    return label_distribution(labelled(bars_e(spark, sf)), per_symbol=True)


@query("f12_head_per_symbol", sql(BARS_L, "", """SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars) WHERE rn <= 5"""))
def heads(spark, sf):
    return screen.head_per_symbol(bars_l(spark, sf), 5).select("symbol", "ts", "close")


@query("c06_c07_keep_drop", sql(BARS_L, "", """SELECT symbol, count(*) AS bars FROM bars WHERE symbol IN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 2000)
  AND symbol NOT IN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 5) GROUP BY 1"""))
def keep_drop(spark, sf):
    s = table(spark, sf, "supplier").withColumn("symbol", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    df = screen.drop_symbols(screen.keep_symbols(bars_l(spark, sf), s.where("s_acctbal > 2000")), s.where("s_nationkey < 5"))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query("a07_external_shortlist", sql("", "", """SELECT trade_date, symbol, score, rank FROM (SELECT strftime(o_orderdate, '%Y-%m') AS trade_date, CAST(o_custkey AS VARCHAR) AS symbol, max(o_totalprice) AS score,
  row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY max(o_totalprice) DESC, CAST(o_custkey AS VARCHAR)) AS rank FROM orders GROUP BY 1, 2 HAVING max(o_totalprice) >= 100000) WHERE rank <= 5"""))
def external(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("trade_date"), F.col("o_custkey").cast("string").alias("sym")).agg(
        F.max("o_totalprice").alias("score"))
    return screen.external_shortlist(o, 5, 100_000).withColumn("rank", F.col("rank").cast("long"))
