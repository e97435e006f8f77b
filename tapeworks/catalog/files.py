"""Sources over files written from the given tables: bar datasets, feature CSVs, schema inventories; horizons combined."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.labels import shortest_horizon
from ..operators.series import settle, split_series
from ..operators.setops import union_all
from ..sources import bars as source
from ..sources import manifest, windows
from ..streaming.jobs import work_folder
from . import query
from .data import BARS_E, BARS_L, W, bars_e, bars_l, fixed, sql


@query("a02_bar_dataset", sql(BARS_E, "", """SELECT upper(symbol) AS symbol, ts, close, volume FROM bars WHERE upper(symbol) IN ('CLICK-0', 'VIEW-0', 'PURCHASE-1')
  AND strftime(make_timestamp(ts // 1000), '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'"""))
def bar_dataset(spark, sf):
    root = f"{work_folder(spark)}/bars"
    source.write_bars(bars_e(spark, sf), root)
    return source.read_bars(spark, root, symbols=["click-0", "View-0", "purchase-1"], start="2024-01-05", end="2024-01-20", columns=["close", "volume"])


@query("a17_feature_csv", sql(BARS_L, "", "SELECT symbol, ts, close, volume FROM bars"))
def feature_csv(spark, sf):
    root = f"{work_folder(spark)}/features"
    bars_l(spark, sf).select("symbol", "ts", "close", "volume").write.csv(root, header=True)
    return source.read_feature_csv(spark, root, "symbol string, ts long, close double, volume long")


@query("a20_schema_inventory", sql(BARS_L, "", """SELECT 'early' AS family, count(*) AS "rows" FROM bars WHERE ts < 883612800000000000
  UNION ALL SELECT 'late', count(*) FROM bars WHERE ts >= 883612800000000000"""))
def inventory(spark, sf):
    root, rows = work_folder(spark), bars_l(spark, sf)
    for name, part in (("early", rows.where("ts < 883612800000000000")), ("late", rows.where("ts >= 883612800000000000"))):
        part.write.parquet(f"{root}/{name}")
    return source.schema_inventory(spark, root).select("family", "rows")


@query("j07_shortest_horizon", sql(BARS_L, "", f"""SELECT symbol, ts, CAST(sign(lead(close, 2) OVER ({W}) - close) AS BIGINT) AS label FROM bars"""))
def horizons(spark, sf):
    f = split_series(bars_l(spark, sf), lookahead=5)
    f = f.with_cols(**{f"label_{n}": F.signum(f.lead("close", n) - F.col("close")).cast("long") for n in (2, 5)})
    return fixed(shortest_horizon(f.finish(), {5: "label_5", 2: "label_2"}).select("symbol", "ts", "label"))


@query("a01_validated_bars", sql(BARS_E, "", "SELECT upper(symbol) AS symbol, ts, open, high, low, close, volume FROM bars"))
def validated(spark, sf):
    root = f"{work_folder(spark)}/bars"
    source.write_bars(bars_e(spark, sf), root)
    return source.read_bars(spark, root, validate=True).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("a06_bar_windows", sql(BARS_L, "", """SELECT w AS win, symbol, count(*) AS "rows", min(ts) AS first_ts, max(ts) AS last_ts, sum(volume) AS volume
  FROM (SELECT *, strftime(make_timestamp(ts // 1000), '%Y-%m-%d') AS d FROM bars) JOIN (VALUES (1, '1996-01-15', '1998-06-30'), (2, '1997-03-01', '1999-02-10')) s(w, a, b) ON d BETWEEN a AND b
  GROUP BY w, symbol"""))
def bar_windows(spark, sf):
    root = f"{work_folder(spark)}/months"
    windows.write_months(bars_l(spark, sf), root)
    cache, parts = windows.BarWindows(spark, root), []
    for n, (start, end) in enumerate([("1996-01-15", "1998-06-30"), ("1997-03-01", "1999-02-10")], 1):
        bars = cache.window(start, end).bars  # both stay open: the result reads them
        parts.append(bars.groupBy(F.lit(n).alias("win"), "symbol").agg(
            F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("volume").alias("volume")))
    return union_all(parts)


LEAVES = """mr AS (SELECT *, strftime(make_timestamp(ts // 1000), '%Y-%m') AS month, concat_ws('|', symbol, ts, CAST(floor(open * 1e6 + 0.5) AS DECIMAL(38,0)), CAST(floor(close * 1e6 + 0.5) AS DECIMAL(38,0)), volume) AS txt FROM bars),
ml AS (SELECT month, symbol, n AS "rows", a AS first_ts, b AS last_ts, sha256(concat_ws('|', n, x, s)) AS hash FROM (SELECT month, symbol, count(*) AS n, min(ts) AS a, max(ts) AS b, bit_xor(h) AS x, sum(CAST(h AS HUGEINT)) AS s
  FROM (SELECT *, CAST('0x' || substr(sha256(txt), 1, 15) AS BIGINT) AS h FROM mr) GROUP BY month, symbol)),
mm AS (SELECT month, CAST(sum("rows") AS BIGINT) AS "rows", min(first_ts) AS first_ts, max(last_ts) AS last_ts, sha256(string_agg(symbol || ':' || hash, ',' ORDER BY symbol)) AS hash FROM ml GROUP BY month)"""


@query("k10_manifest_tree", sql(BARS_L + ",\n" + LEAVES, "", """SELECT 'leaf' AS level, month, symbol, "rows", first_ts, last_ts, hash FROM ml
  UNION ALL SELECT 'month', month, NULL, "rows", first_ts, last_ts, hash FROM mm
  UNION ALL SELECT 'root', NULL, NULL, CAST(sum("rows") AS BIGINT), min(first_ts), max(last_ts), sha256(string_agg(month || ':' || hash, ',' ORDER BY month)) FROM mm"""))
def manifest_tree(spark, sf):
    return manifest.hash_tree(manifest.leaf_hashes(bars_l(spark, sf), ["open", "close", "volume"]))


@query("k10_changed_leaves", sql(BARS_L, "", """SELECT month, symbol, CASE WHEN count(*) FILTER (volume % 97 = 5) = count(*) THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT *, strftime(make_timestamp(ts // 1000), '%Y-%m') AS month FROM bars) GROUP BY month, symbol HAVING count(*) FILTER (volume % 97 = 5 OR volume % 89 = 3) > 0"""))
def changed_leaves(spark, sf):
    root = f"{work_folder(spark)}/bars"
    bars_l(spark, sf).select("symbol", "ts", "close", "volume").write.parquet(root)
    bars = spark.read.parquet(root)  # both versions and both levels of their trees read it
    edited = bars.where("volume % 97 <> 5").withColumn("close", F.when(F.col("volume") % 89 == 3, F.col("close") + 1.0).otherwise(F.col("close")))
    old, new = (manifest.hash_tree(settle(manifest.leaf_hashes(b, ["close", "volume"]))) for b in (bars, edited))
    return manifest.changed_leaves(old, new)
