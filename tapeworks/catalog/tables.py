"""Sources, data quality, resampling and scalar functions over the derived bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecols as tc
from ..operators import quality, resample, setops
from ..operators.joins import with_grid
from ..sources import bars as src
from . import query
from .data import BARS_E, BARS_L, TICKS, bars_e, bars_l, fixed, sql, table, ticks


def raw_ticks(spark, sf):
    """Ticks as raw short-name bars: ms and us epochs mixed, some fields unparsable or missing."""
    t = ticks(spark, sf)
    k = F.col("event_id")
    price = F.when(k % 50 == 0, F.lit("bad")).otherwise(F.col("price").cast("long").cast("string"))
    return t.select(
        F.when(k % 2 == 0, tc.idiv(F.col("ts"), 1_000_000)).otherwise(tc.idiv(F.col("ts"), 1000)).alias("t"),
        F.lower("symbol").alias("T"), price.alias("o"), F.when(k % 70 == 0, "-1").otherwise(price).alias("h"),
        price.alias("l"), price.alias("c"), F.when(k % 3 != 0, F.col("size")).alias("v"))


RAW = TICKS + """, raw AS (SELECT CASE WHEN event_id % 2 = 0 THEN ts // 1000000 * 1000000 ELSE ts END AS ts, symbol,
  CASE WHEN event_id % 50 <> 0 THEN price END AS p, event_id % 70 = 0 AS neg, CASE WHEN event_id % 3 <> 0 THEN size ELSE 0 END AS volume, event_id FROM tk)"""


@query("a04_normalise_bars", sql(RAW, "", """SELECT symbol, ts, p AS open, p AS high, p AS low, p AS close, volume FROM raw WHERE NOT neg"""))
def normalise(spark, sf):
    return src.normalise_bars(raw_ticks(spark, sf))


@query("a05_symbol_dates", sql(BARS_E, "", """SELECT symbol, count(DISTINCT CAST(make_timestamp(ts // 1000) AS DATE)) AS dates,
  CAST(min(CAST(make_timestamp(ts // 1000) AS DATE)) AS VARCHAR) AS first_date, CAST(max(CAST(make_timestamp(ts // 1000) AS DATE)) AS VARCHAR) AS last_date
  FROM bars GROUP BY symbol"""))
def dates(spark, sf):
    return fixed(src.list_dates(bars_e(spark, sf)))


@query("a21_symbol_list", sql("", "", """SELECT DISTINCT upper(t) AS symbol FROM (SELECT unnest(regexp_split_to_array(c_name || ',' || c_mktsegment, '[,\\s]+')) AS t
  FROM customer) WHERE regexp_matches(upper(t), '^[A-Z][A-Z0-9.\\-]*$')"""))
def symbols(spark, sf):
    return src.symbol_list(table(spark, sf, "customer").select(F.concat_ws(",", "c_name", "c_mktsegment").alias("value")))


@query("a22_frame_summary", sql(BARS_E, "", """SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(ts) AS min_ts, max(ts) AS max_ts,
  strftime(make_timestamp(min(ts) // 1000), '%Y-%m-%d %H:%M') AS first_bar, '' AS optional_columns FROM bars"""))
def summary(spark, sf):
    return quality.frame_summary(bars_e(spark, sf))


@query("a23_display_extract", sql(BARS_E, "", """SELECT strftime(make_timestamp(ts // 1000) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS "Timestamp (ET)",
  printf('%.2f', open) AS "Open", printf('%.2f', high) AS "High", printf('%.2f', low) AS "Low", printf('%.2f', close) AS "Close", volume AS "Volume"
  FROM bars WHERE symbol = 'CLICK-0' AND ts BETWEEN 1704794400000000000 AND 1704898800000000000"""))
def extract(spark, sf):
    b = src.window_slice(bars_e(spark, sf), 1704794400000000000, 1704898800000000000, ["CLICK-0"])
    return src.display_extract(b)


# --- quality -------------------------------------------------------------------------------------

BAD = TICKS + """, bad AS (SELECT symbol, ts - ts % 3600000000000 AS ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE price END AS open,
  CASE WHEN event_id % 13 = 0 THEN price - 5 ELSE price END AS high, CASE WHEN event_id % 17 = 0 THEN -price ELSE price END AS low, price AS close,
  CASE WHEN event_id % 19 = 0 THEN -size ELSE size END AS volume, event_id FROM tk)"""
BAD_RULES = {
    **{f"{c}_missing": f"{c} IS NULL" for c in quality.BAR_REQUIRED},
    **{f"{c}_negative": f"{c} < 0" for c in ("open", "high", "low", "close", "volume")},
    "high_below_low": "high < low", "high_below_body": "high < open OR high < close",
    "low_above_body": "low > open OR low > close", "ts_not_positive": "ts <= 0",
}


def bad_bars(spark, sf):
    k, p = F.col("event_id"), F.col("price")
    return ticks(spark, sf).select(
        "symbol", tc.bucket_ns("ts", tc.HOUR_NS).alias("ts"), F.when(k % 11 != 0, p).alias("open"),
        F.when(k % 13 == 0, p - 5).otherwise(p).alias("high"), F.when(k % 17 == 0, -p).otherwise(p).alias("low"),
        p.alias("close"), F.when(k % 19 == 0, -F.col("size")).otherwise(F.col("size")).alias("volume"), "event_id")


@query("b01_validate_bars", sql(BAD, "", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS violations FROM bad" for n, c in BAD_RULES.items()) +
    " UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM bad GROUP BY symbol, ts)"))
def validate(spark, sf):
    return quality.validate(bad_bars(spark, sf), "bars")


@query("b04_bad_rows", sql(BAD, "", """SELECT event_id, array_to_string(list_filter([CASE WHEN open IS NULL THEN 'open_missing' END,
  CASE WHEN low < 0 THEN 'low_negative' END, CASE WHEN close < 1000 OR close > 20000 THEN 'close_out_of_range' END], lambda x: x IS NOT NULL), ',') AS broken
  FROM bad WHERE open IS NULL OR low < 0 OR close < 1000 OR close > 20000"""))
def bad_rows(spark, sf):
    rules = [quality.not_null("open"), quality.non_negative("low"), quality.in_range("close", 1000, 20000)]
    return quality.bad_rows(bad_bars(spark, sf), rules).select("event_id", F.concat_ws(",", "broken_rules").alias("broken"))


ORDERS = """sig AS (SELECT epoch_us(o_orderdate) * 1000 AS ts, CAST(o_custkey AS VARCHAR) AS symbol,
  CASE o_orderkey % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'hold' END AS side, (o_orderkey % 41 - 20) / 16.0 AS strength, o_orderkey % 7 AS qty,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice - 50000 END AS entry FROM orders)"""


def signals_o(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        tc.to_ns("o_orderdate").alias("ts"), F.col("o_custkey").cast("string").alias("symbol"),
        F.when(k % 3 == 0, "long").when(k % 3 == 1, "short").otherwise("hold").alias("side"),
        ((k % 41 - 20) / 16.0).alias("strength"), (k % 7).alias("qty"), F.when(k % 5 != 0, F.col("o_totalprice") - 50000).alias("entry"))


@query("b09_feature_inputs", sql(BAD, "", " UNION ALL ".join(f"SELECT '{c}_not_positive' AS rule, count(*) FILTER ({c} IS NULL OR {c} <= 0) AS violations FROM bad" for c in ("open", "high", "low", "close"))))
def feature_inputs(spark, sf):
    return quality.feature_inputs(bad_bars(spark, sf))


@query("b02_validate_signals", sql(ORDERS, "", """SELECT 'ts_not_positive' AS rule, count(*) FILTER (ts <= 0) AS violations FROM sig
  UNION ALL SELECT 'symbol_missing', count(*) FILTER (symbol IS NULL) FROM sig
  UNION ALL SELECT 'side_not_allowed', count(*) FILTER (side NOT IN ('long', 'short', 'buy', 'sell')) FROM sig
  UNION ALL SELECT 'strength_out_of_range', count(*) FILTER (strength < -1 OR strength > 1) FROM sig"""))
def validate_signals(spark, sf):
    return quality.validate(signals_o(spark, sf), "signals")


@query("b02_validate_orders", sql(ORDERS, "", """SELECT 'ts_not_positive' AS rule, count(*) FILTER (ts <= 0) AS violations FROM sig
  UNION ALL SELECT 'symbol_missing', count(*) FILTER (symbol IS NULL) FROM sig
  UNION ALL SELECT 'side_not_allowed', count(*) FILTER (side NOT IN ('long', 'short', 'buy', 'sell')) FROM sig
  UNION ALL SELECT 'qty_not_positive', count(*) FILTER (qty <= 0) FROM sig
  UNION ALL SELECT 'entry_not_positive', count(*) FILTER (entry <= 0) FROM sig"""))
def validate_orders(spark, sf):
    return quality.validate(signals_o(spark, sf), "orders")


@query("b03_validate_trades", sql("""tr AS (SELECT 'buy' AS side, CAST(l_orderkey AS VARCHAR) AS symbol, l_quantity - 3 AS qty, l_extendedprice AS entry_px,
  l_extendedprice * l_discount AS exit_px, epoch_us(o_orderdate) * 1000 AS entry_ts, epoch_us(l_shipdate) * 1000 AS exit_ts, l_tax - 0.02 AS fees
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""", "", """SELECT 'symbol_missing' AS rule, count(*) FILTER (symbol IS NULL) AS violations FROM tr
  UNION ALL SELECT 'side_not_allowed', 0 UNION ALL SELECT 'qty_not_positive', count(*) FILTER (qty <= 0) FROM tr
  UNION ALL SELECT 'entry_px_not_positive', count(*) FILTER (entry_px <= 0) FROM tr UNION ALL SELECT 'exit_px_not_positive', count(*) FILTER (exit_px <= 0) FROM tr
  UNION ALL SELECT 'exit_ts_not_after_entry_ts', count(*) FILTER (exit_ts <= entry_ts) FROM tr UNION ALL SELECT 'fees_negative', count(*) FILTER (fees < 0) FROM tr"""))
def validate_trades(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("buy").alias("side"), F.col("l_orderkey").cast("string").alias("symbol"), (F.col("l_quantity") - 3).alias("qty"),
        F.col("l_extendedprice").alias("entry_px"), (F.col("l_extendedprice") * F.col("l_discount")).alias("exit_px"),
        tc.to_ns("o_orderdate").alias("entry_ts"), tc.to_ns("l_shipdate").alias("exit_ts"), (F.col("l_tax") - 0.02).alias("fees"))
    return quality.validate(t, "trades")


@query("b06_raw_file_report", sql(BAD, "", """SELECT symbol AS file, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts,
  count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (least(open, high, low, close) < 0) AS negative_prices,
  CAST(0 AS BIGINT) AS fractional_volume, count(*) FILTER (open IS NULL) AS missing_values, count(*) FILTER (jts < pts) AS steps_back
  FROM (SELECT *, lag(jts) OVER (PARTITION BY symbol ORDER BY event_id) AS pts FROM (SELECT *, ts + event_id % 23 * 7200000000000 AS jts FROM bad)) GROUP BY 1""")
  .replace("min(ts) AS min_ts, max(ts) AS max_ts", "min(jts) AS min_ts, max(jts) AS max_ts"))
def raw_report(spark, sf):
    b = bad_bars(spark, sf).withColumn("jts", F.col("ts") + F.col("event_id") % 23 * F.lit(7_200_000_000_000).cast("long"))
    return quality.raw_file_report(b.withColumnRenamed("symbol", "file"), "file", "event_id", "jts")


@query("b07_normalisation_plan", sql("", "", """SELECT event_type AS family, CASE user_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'float_volume' ELSE 'long' END AS variant,
  count(*) AS files, CASE WHEN user_id % 3 = 0 THEN 't>ts,o>open,h>high,l>low,c>close,v>volume,T>symbol' ELSE '' END AS renames,
  CASE WHEN user_id % 3 = 1 THEN 'volume:long' ELSE '' END AS casts FROM events GROUP BY 1, 2, 4, 5"""))
def plan(spark, sf):
    e = table(spark, sf, "events")
    u = F.col("user_id") % 3
    return quality.normalisation_plan(e.select(
        F.col("event_type").alias("family"), F.when(u == 0, "short").when(u == 1, "float_volume").otherwise("long").alias("variant")))


@query("b08_contract_report", sql(BARS_E, "", """SELECT symbol, count(*) AS rows, count(*) FILTER (ts % 60000000000 <> 0) AS unaligned, CAST(0 AS BIGINT) AS repeated_in_session,
  count(*) FILTER (abs(close * volume + ts // 1800000000000 % 7 // 6 - close * volume) > 1e-6 * greatest(abs(close * volume), 1.0)) AS turnover_mismatch,
  count(DISTINCT CAST(make_timestamp(ts // 1000) - INTERVAL 5 HOUR AS DATE)) AS sessions FROM bars GROUP BY symbol"""))
def contract(spark, sf):
    b = bars_e(spark, sf)
    slot = F.pmod(tc.idiv(F.col("ts"), 1_800_000_000_000), F.lit(7))
    b = b.withColumn("turnover", F.col("close") * F.col("volume") + F.when(slot == 6, 1).otherwise(0))
    return quality.contract_report(b, "turnover")


@query("b22_feature_report", sql(BARS_L, "non_null_share", """SELECT f AS feature, s AS non_null_share, s >= 0.9 AS passes FROM (
  SELECT 'r1' AS f, avg(CASE WHEN rn > 1 THEN 1.0 ELSE 0.0 END) AS s FROM (SELECT row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)
  UNION ALL SELECT 'r50', avg(CASE WHEN rn > 50 THEN 1.0 ELSE 0.0 END) FROM (SELECT row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars))"""))
def feature_report(spark, sf):
    from ..operators.series import split_series

    f = split_series(bars_l(spark, sf), lookback=50)
    df = f.with_cols(r1=f.lag("close", 1), r50=f.lag("close", 50)).finish()
    return fixed(quality.feature_report(df, ["r1", "r50"]))


# --- session predicates ---------------------------------------------------------------------------


@query("b10_14_sessions", sql(BARS_E, "", """SELECT symbol, ts, strftime(et, '%Y-%m-%d') AS session_date, isodow(et) <= 5 AS trading_day,
  isodow(et) <= 5 AND hour(et) * 60 + minute(et) BETWEEN 570 AND 960 AS in_session, hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960 AS regular,
  hour(et) * 60 + minute(et) >= 240 AND hour(et) * 60 + minute(et) < 570 AS premarket, CASE WHEN hour(et) * 60 + minute(et) >= 750 THEN 'PM' ELSE 'AM' END AS half
  FROM (SELECT *, make_timestamp(ts // 1000) - INTERVAL 5 HOUR AS et FROM bars)"""))
def sessions(spark, sf):
    b = bars_e(spark, sf)
    return fixed(b.select(
        "symbol", "ts", tc.session_date("ts").alias("session_date"), tc.is_trading_day(tc.market_time("ts")).alias("trading_day"),
        tc.in_market_session("ts").alias("in_session"), tc.in_regular_hours("ts").alias("regular"),
        tc.in_premarket("ts").alias("premarket"), tc.day_half("ts").alias("half")))


@query("h01_h02_time_functions", sql("", "", """SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) * 1000 AS from_us, epoch_us(ts) // 1000 * 1000000 AS from_ms, epoch_us(ts) // 1000000 * 1000000000 AS from_s,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS market, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc FROM events"""))
def times(spark, sf):
    e = table(spark, sf, "events").withColumn("ns", tc.to_ns("ts"))
    us = tc.idiv(F.col("ns"), 1000)
    return e.select(
        "event_id", "ns", tc.infer_epoch_ns(us).alias("from_us"), tc.infer_epoch_ns(tc.idiv(us, 1000)).alias("from_ms"),
        tc.infer_epoch_ns(tc.idiv(us, 1_000_000)).alias("from_s"), F.date_format(tc.event_time("ns"), "yyyy-MM-dd HH:mm:ss").alias("text"),
        tc.output_time("ns", "market_aware").alias("market"), tc.output_time("ns", "utc_aware").alias("utc"))


@query("h03_h04_durations", sql("", "", """SELECT event_id, CASE WHEN event_id % 5 < 4 THEN event_id % 90 * [1, 60, 3600, 86400][event_id % 5 + 1] END AS seconds,
  greatest(least(a + 500, b + 300) - greatest(a, b), 0) AS overlap FROM (SELECT event_id, event_id % 1000 AS a, user_id * 7 % 1000 AS b FROM events)"""))
def durations(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    unit = F.when(k % 5 == 0, "s").when(k % 5 == 1, "m").when(k % 5 == 2, "H").when(k % 5 == 3, "d").otherwise("w")
    a, b = k % 1000, F.col("user_id") * 7 % 1000
    return e.select(
        "event_id", tc.duration_seconds(F.concat((k % 90).cast("string"), unit)).alias("seconds"),
        tc.overlap_ns(a, a + 500, b, b + 300).alias("overlap"))


# --- resampling -----------------------------------------------------------------------------------


def _resampled(width):
    return f"""SELECT symbol, ts - ts % {width} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
  CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2"""


@query("d01_resample", sql(BARS_E, "", _resampled(14_400_000_000_000)))
def resampled(spark, sf):
    return resample.resample(bars_e(spark, sf), 4 * tc.HOUR_NS)


@query("d01_resample_keep_empty", sql(BARS_E, "", f"""SELECT g.symbol, g.ts, open, high, low, close, coalesce(volume, 0) AS volume
  FROM (SELECT symbol, unnest(generate_series(min(ts - ts % 3600000000000), max(ts - ts % 3600000000000), 3600000000000)) AS ts FROM bars GROUP BY symbol) g
  LEFT JOIN ({_resampled(3_600_000_000_000)}) r ON g.symbol = r.symbol AND g.ts = r.ts"""))
def resampled_full(spark, sf):
    return resample.resample(bars_e(spark, sf), tc.HOUR_NS, keep_empty=True)


@query("d02_resample_ticks", sql(TICKS, "", """SELECT symbol, ts - ts % 86400000000000 AS ts, first(price ORDER BY tk.ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY tk.ts, event_id) AS close, CAST(sum(size) AS BIGINT) AS volume FROM tk GROUP BY symbol, tk.ts - tk.ts % 86400000000000"""))
def daily(spark, sf):
    return resample.bars_from_ticks(ticks(spark, sf), tc.DAY_NS, tie=("event_id",))


@query("d03_time_bars", sql(BARS_E, "", """SELECT symbol, ts, ts - ts % 7200000000000 AS bar_start, ts - ts % 7200000000000 + 7200000000000 AS bar_end,
  ts % 7200000000000 AS bar_offset FROM bars"""))
def time_bars(spark, sf):
    df = resample.with_time_bars(bars_e(spark, sf), 2 * tc.HOUR_NS)
    return df.select("symbol", "ts", "bar_start", "bar_end", "bar_offset")


# --- set operations, grids, hashes ------------------------------------------------------------------


@query("g02_dedupe", sql(BAD, "", """SELECT symbol, ts, event_id, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) AS rn FROM bad) WHERE rn = 1"""))
def deduped(spark, sf):
    return src.dedupe(bad_bars(spark, sf).select("symbol", "ts", "event_id", "close"), prefer=["event_id"])


@query("g01_union", sql(BARS_E, "", """SELECT symbol, ts, close, volume FROM bars WHERE symbol LIKE 'C%' UNION ALL SELECT symbol, ts, close, NULL FROM bars WHERE symbol NOT LIKE 'C%'"""))
def unioned(spark, sf):
    b = bars_e(spark, sf)
    return setops.union_all([b.where("symbol like 'C%'").select("symbol", "ts", "close", "volume"),
                             b.where("symbol not like 'C%'").select("symbol", "ts", "close")])


@query("g03_common_symbols", sql("", "", "SELECT c_nationkey AS symbol FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"))
def common(spark, sf):
    return setops.common_symbols(table(spark, sf, "customer").select(F.col("c_nationkey").alias("symbol")),
                                 table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("symbol")))


@query("g04_missing_symbols", sql("", "", "SELECT DISTINCT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"))
def missing(spark, sf):
    return setops.missing_symbols(table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol")),
                                  table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("symbol")))


@query("g06_first_difference", sql(BARS_E, "", """SELECT symbol, ts, CAST(volume AS BIGINT) AS left_volume, CAST(v2 AS BIGINT) AS right_volume FROM (
  SELECT symbol, ts, volume, CASE WHEN close > 9000 THEN volume + 1 ELSE volume END AS v2 FROM bars) WHERE volume <> v2 ORDER BY symbol, ts LIMIT 1"""))
def difference(spark, sf):
    a = bars_e(spark, sf).select("symbol", "ts", "close", "volume")
    b = a.withColumn("volume", F.when(F.col("close") > 9000, F.col("volume") + 1).otherwise(F.col("volume")))
    d = setops.first_difference(a, b, ["symbol", "ts"], ["volume"])
    return d.select("symbol", "ts", F.col("left_values.volume").alias("left_volume"), F.col("right_values.volume").alias("right_volume"))


@query("c13_parameter_grid", sql(BARS_E, "", """SELECT combo, lo, cut, count(*) FILTER (close >= lo AND volume >= cut) AS hits
  FROM bars, (VALUES (0, 1000.0::DOUBLE, 10), (1, 1000.0::DOUBLE, 50), (2, 5000.0::DOUBLE, 10), (3, 5000.0::DOUBLE, 50)) g(combo, lo, cut) GROUP BY ALL"""))
def grid(spark, sf):
    g = with_grid(bars_e(spark, sf), {"lo": [1000.0, 5000.0], "cut": [10, 50]})
    hit = (F.col("close") >= F.col("lo")) & (F.col("volume") >= F.col("cut"))
    return g.groupBy("combo", "lo", "cut").agg(F.sum(hit.cast("long")).alias("hits"))


@query("h10_table_hash")
def hashes(spark, sf):
    return setops.table_hash(bars_e(spark, sf))


@query("h11_column_hashes")
def column_hashes(spark, sf):
    return setops.column_hashes(bars_e(spark, sf), ["symbol", "ts"], ["open", "close", "volume"])


@query("g05_oversample")
def oversampled(spark, sf):
    b = bars_e(spark, sf)
    lab = F.when(F.col("volume") % 10 == 0, 1).when(F.col("volume") % 10 == 1, -1).otherwise(0)
    df = setops.oversample(b.select("symbol", "ts", lab.alias("label")), "label", 3, 7, ["symbol", "ts"])
    return df.groupBy("label", "copy").agg(F.count(F.lit(1)).alias("rows"))
