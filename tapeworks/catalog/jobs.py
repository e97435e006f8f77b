"""Whole jobs, sinks and sources round trips, context tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import HOUR_NS, idiv, session_date
from ..operators import datasets as ds
from ..operators import quality, resample, screen
from ..operators.joins import join_unique
from ..operators.trades import Selection
from ..plans import enhanced, pipelines
from ..registry import default_registry
from ..sources import market, membership, runs
from ..streaming.jobs import work_folder
from . import query
from .core import AVWAP, AVWAP_COLS, CORE, TR, WINDOW
from .data import BAR_NS, BARS_E, BARS_L, TICKS, bars_e, bars_l, fixed, roll, sql, table, ticks
from .enhanced import PROFILE, STEP
from .labelling import CFG, PREDS, first_hit_sql, predictions
from .screening import SHORT
from .signalling import held_sql
from .trading import FILLS, fills, trade_rows, TRADES


@query("e27_enhanced_pack", sql(BARS_E + ",\n" + AVWAP + ",\n" + PROFILE + f""", en AS (SELECT a.*, f__profile__poc, f__profile__vah, f__profile__val FROM avwap a JOIN profile p USING (symbol, ts)),
at30 AS (SELECT symbol, ts, avg(tr) OVER {roll(30)} AS f__vol__atr_30 FROM (SELECT *, {TR} AS tr FROM bars {WINDOW}))""", AVWAP_COLS + " f__vol__atr_30",
       f"SELECT symbol, ts, {', '.join(AVWAP_COLS.split())}, f__vol__atr_30, f__profile__poc, false AS f__stress__contraction FROM en JOIN at30 USING (symbol, ts)"))
def enhanced_pack(spark, sf):
    df = enhanced.enhanced_pack(bars_e(spark, sf), step=STEP)
    return fixed(df.select("symbol", "ts", *AVWAP_COLS.split(), "f__vol__atr_30", "f__profile__poc", "f__stress__contraction"))


@query("r01_registry_pack", sql(BARS_E + ",\n" + CORE, "f__vol__rel_volume_30 f__ta__vwap_30 f__vol__atr_30", "SELECT * FROM core"))
def registry_pack(spark, sf):
    r = default_registry()
    r.register_pack("core_only", [("core_basics", {"vwap_n": 30, "atr_n": 30})])
    return fixed(r.apply_config(bars_e(spark, sf), [{"type": "core_only"}]))


@query("a11_market_context", sql(TICKS + """, hb AS (SELECT split_part(symbol, '-', 1) AS s, ts - ts % 3600000000000 AS ts, last(price ORDER BY tk.ts, event_id) AS c FROM tk WHERE symbol LIKE 'VIEW%' OR symbol LIKE 'ERROR%' GROUP BY 1, 2),
wd AS (SELECT ts, max(c) FILTER (s = 'VIEW') AS v, max(c) FILTER (s = 'ERROR') AS e FROM hb GROUP BY 1)""", "", """SELECT ts, last_value(v IGNORE NULLS) OVER (ORDER BY ts) AS "VIEW_close", last_value(e IGNORE NULLS) OVER (ORDER BY ts) AS "ERROR_close" FROM wd"""))
def context(spark, sf):
    t = ticks(spark, sf).withColumn("symbol", F.split("symbol", "-")[0])
    b = resample.bars_from_ticks(t, HOUR_NS, tie=("event_id",))
    return market.market_context(b, ["VIEW", "ERROR"], ["close"])


@query("a09_a10_membership_files", sql(BARS_E + ",\n" + SHORT, "", "SELECT symbol, true AS is_sip, CAST(trade_date AS VARCHAR) AS trade_date FROM shortlist WHERE trade_date BETWEEN '2024-01-08' AND '2024-01-20'"))
def membership_files(spark, sf):
    b = bars_e(spark, sf)
    rows = membership.membership_rows(screen.premarket_shortlist(b, 3), b.select("symbol", session_date("ts").alias("trade_date")))
    root = work_folder(spark)
    membership.write_membership(rows, root)
    # Writing some days again replaces just those.
    membership.write_membership(rows.where("trade_date >= '2024-01-15'"), root)
    return membership.read_membership(spark, root, "2024-01-08", "2024-01-20")


@query("a12_split_files", sql(BARS_L, "", """SELECT split, symbol, ts, close FROM (SELECT symbol, ts, close, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'valid' ELSE 'test' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)) WHERE split = 'valid'"""))
def split_files(spark, sf):
    root = work_folder(spark)
    runs.write_splits(ds.split_by_symbol(bars_l(spark, sf)).select("symbol", "ts", "close", "split"), root)
    return runs.read_splits(spark, root, "symbol string, ts long, close double, split string", split="valid")


@query("a13_a14_run_tables", sql(TRADES, "", "SELECT run_id, count(*) AS trades, sum(pnl) AS total_pnl FROM tr WHERE run_id IN ('1-URGENT', '5-LOW') GROUP BY 1"))
def run_tables(spark, sf):
    root = work_folder(spark)
    runs.write_run_table(trade_rows(spark, sf).select("run_id", "ts", "order_id", "pnl"), root, "trades")
    return runs.read_run_table(spark, root, "trades", ["1-URGENT", "5-LOW"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total_pnl"))


@query("a18_warehouse_sql", sql(TRADES, "", "SELECT run_id, regime, count(*) AS trades, sum(pnl) AS total_pnl FROM tr GROUP BY 1, 2"))
def warehouse(spark, sf):
    runs.register_views({"fact_trades": trade_rows(spark, sf)})
    return runs.run_sql(spark, "SELECT run_id, regime, count(*) AS trades, sum(pnl) AS total_pnl FROM fact_trades GROUP BY run_id, regime")


@query("a19_table_status", sql(FILLS + ",\n" + TRADES, "", """SELECT 'fact_trades' AS "table", count(*) AS rows FROM tr UNION ALL SELECT 'fact_signals', count(*) FROM fl UNION ALL SELECT 'dim_runs', count(DISTINCT run_id) FROM tr"""))
def status(spark, sf):
    t = trade_rows(spark, sf)
    return runs.table_status({"fact_trades": t, "fact_signals": fills(spark, sf), "dim_runs": t.select("run_id").distinct()})


@query("k10_dataset_manifest")
def manifest(spark, sf):
    return runs.dataset_manifest(bars_l(spark, sf), ["open", "close"], "volume")


@query("d29_session_ranges", sql(BARS_E, "", """SELECT symbol, strftime(et, '%Y-%m-%d') AS session_date, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (m < 570) AS pre_rows, count(*) FILTER (m >= 570 AND m < 960) AS regular_rows, count(*) FILTER (m >= 960) AS post_rows
  FROM (SELECT *, hour(et) * 60 + minute(et) AS m FROM (SELECT *, make_timestamp(ts // 1000) - INTERVAL 5 HOUR AS et FROM bars)) GROUP BY 1, 2"""))
def session_ranges(spark, sf):
    return fixed(resample.session_ranges(bars_e(spark, sf)))


@query("c03_signals_with_bars", sql(BARS_E, "", """SELECT s.symbol, s.ts, close, volume FROM (SELECT symbol, ts FROM bars WHERE volume % 4 = 0 UNION ALL SELECT symbol, ts + 1 FROM bars WHERE volume % 40 = 0) s LEFT JOIN bars USING (symbol, ts)"""))
def with_bars(spark, sf):
    b = bars_e(spark, sf)
    s = b.where("volume % 4 = 0").select("symbol", "ts").unionByName(b.where("volume % 40 = 0").select("symbol", (F.col("ts") + 1).alias("ts")))
    return join_unique(s, b.select("symbol", "ts", "close", "volume"), ["symbol", "ts"])


@query("c14_orders_to_fills", sql(FILLS, "", "SELECT order_id, price, o_orderstatus AS reason FROM fl LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0) ON order_id = o_orderkey"))
def orders_to_fills(spark, sf):
    meta = table(spark, sf, "orders").where("o_orderkey % 7 != 0").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("reason"))
    return fills(spark, sf).join(meta, "order_id", "left").select("order_id", "price", "reason")


@query("b18_label_sessions", sql(BARS_E + ",\n" + first_hit_sql("0.9", "0.9"), "", """SELECT symbol, ts, CAST(CASE WHEN (ts // 60000000000 - 300) % 1440 BETWEEN 600 AND 900 THEN label ELSE 0 END AS BIGINT) AS label FROM lab"""))
def label_sessions(spark, sf):
    from dataclasses import replace

    from ..operators.labels import first_hit_labels

    cfg = replace(CFG, min_after_open=30, max_before_close=60)
    return fixed(first_hit_labels(bars_e(spark, sf), cfg).select("symbol", "ts", "label"))


@query("j08_lookahead_check", sql(BARS_E, "", """SELECT 'source_ts_looks_ahead' AS rule, count(*) AS violations FROM bars WHERE volume % 50 = 0"""))
def lookahead(spark, sf):
    b = bars_e(spark, sf).withColumn("source_ts", F.when(F.col("volume") % 50 == 0, F.col("ts") + 1).otherwise(F.col("ts")))
    return quality.violations(b, [quality.not_before("source_ts", "ts")])


VARIANTS = {"revert_tight": {"policy": "vwap_revert", "rvol_min": 1.0, "timeout": 3}, "revert_loose": {"policy": "vwap_revert", "rvol_min": 0.5, "timeout": 6}}


def _variant(name: str, rvol: float, timeout: int) -> str:
    return f"""SELECT '{name}' AS variant, count(*) FILTER (held > 0) AS bars_in, count(*) FILTER (before = 0 AND held > 0) AS entries FROM f2"""


@query("l1_entry_variants", "SELECT * FROM (WITH " + BARS_E + ",\n" + CORE.replace("core AS (SELECT", "core0 AS (SELECT") + """, core AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY f__vol__rel_volume_30 DESC, symbol) <= 3 AS u FROM core0),
""" + held_sql("close < f__ta__vwap_30 AND f__vol__rel_volume_30 >= 1.0 AND f__warmup_ok AND u", "close >= f__ta__vwap_30", 3) + "\n" + _variant("revert_tight", 1.0, 3) + ") UNION ALL SELECT * FROM (WITH " + BARS_E + ",\n" +
       CORE.replace("core AS (SELECT", "core0 AS (SELECT") + """, core AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY f__vol__rel_volume_30 DESC, symbol) <= 3 AS u FROM core0),
""" + held_sql("close < f__ta__vwap_30 AND f__vol__rel_volume_30 >= 0.5 AND f__warmup_ok AND u", "close >= f__ta__vwap_30", 6) + "\n" + _variant("revert_loose", 0.5, 6) + ")")
def entry_variants(spark, sf):
    s = pipelines.entry_variants(bars_e(spark, sf), VARIANTS, 3)
    return s.groupBy("variant").agg(F.sum("signal").alias("bars_in"), F.sum((F.col("decision") == "enter").cast("long")).alias("entries"))


@query("l2_k14_phase_report", sql(BARS_E + ",\n" + first_hit_sql("0.9", "0.9"), "", """SELECT phase, symbol, long_labels, short_labels, long_labels + short_labels AS total_directional, CASE WHEN long_labels < 100 OR short_labels < 100 OR long_labels + short_labels < 200 THEN 'dropped' ELSE 'kept' END AS status FROM
  (SELECT CASE WHEN ts // 86400000000000 BETWEEN 19723 AND 19737 THEN 'train' ELSE 'oos' END AS phase, symbol, count(*) FILTER (label = 1) AS long_labels, count(*) FILTER (label = -1) AS short_labels FROM lab WHERE ts // 86400000000000 BETWEEN 19723 AND 19750 GROUP BY 1, 2)"""))
def phase_report(spark, sf):
    d = pipelines.phase_dataset(bars_e(spark, sf), {"train": (19723, 19737), "oos": (19738, 19750)}, CFG, ("returns_trend",))
    return pipelines.phase_report(d, 100, 200).select("phase", "symbol", "long_labels", "short_labels", "total_directional", "status")


@query("l3_universe_evaluation", sql(BARS_E + ",\n" + SHORT + ",\n" + PREDS + """, ff AS (SELECT symbol, ts, (lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close) / close AS rr FROM bars),
kp AS (SELECT p.*, greatest(prob_long, prob_short) AS tp, CASE WHEN greatest(prob_long, prob_short) <= 0 THEN 0 WHEN prob_long >= prob_short THEN 1 ELSE -1 END AS dir, greatest(prob_long, prob_short) - greatest(prob_neutral, 0) AS em FROM preds p
  JOIN shortlist s ON p.symbol = s.symbol AND CAST(make_timestamp(p.ts // 1000) - INTERVAL 5 HOUR AS DATE) = s.trade_date),
k2 AS (SELECT *, row_number() OVER (PARTITION BY ts // 86400000000000 ORDER BY tp * em DESC, ts, symbol) AS rk FROM kp WHERE tp >= 0.3 QUALIFY rk <= 5)""", "daily_pnl",
       "SELECT k2.ts // 86400000000000 AS trade_day, sum(dir * rr - 0.001) AS daily_pnl, count(*) AS trades FROM k2 JOIN ff ON k2.symbol = ff.symbol AND k2.ts = ff.ts WHERE rr IS NOT NULL GROUP BY 1"))
def evaluation(spark, sf):
    b = bars_e(spark, sf)
    return fixed(pipelines.universe_evaluation(b, predictions(b), 3, Selection(top_k=5, min_prob=0.3), 1, 0.001))


@query("f13_smallest_and_largest", sql("", "", """SELECT 'low' AS side, o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n, o_custkey LIMIT 5) UNION ALL SELECT 'high', o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5)"""))
def extremes(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    low = g.orderBy("n", "o_custkey").limit(5).select(F.lit("low").alias("side"), "o_custkey", "n")
    return low.unionByName(g.orderBy(F.col("n").desc(), "o_custkey").limit(5).select(F.lit("high").alias("side"), "o_custkey", "n"))


@query("a08_probability_join", sql(BARS_E, "", """SELECT b.symbol, b.ts, CASE WHEN b.volume % 9 <> 0 THEN (b.ts // 1800000000000 * 13 + b.volume * 7) % 100 / 100.0::DOUBLE END AS p_hat FROM bars b"""))
def probability_join(spark, sf):
    b = bars_e(spark, sf)
    p = b.where("volume % 9 != 0").select("symbol", "ts", (F.pmod(idiv(F.col("ts"), BAR_NS) * 13 + F.col("volume") * 7, F.lit(100)) / 100.0).alias("p_hat"))
    return b.select("symbol", "ts").join(p, ["symbol", "ts"], "left")
