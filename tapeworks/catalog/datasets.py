"""Splits, folds, weights, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as ds
from ..operators import features_ml as ml
from ..operators import labels
from ..operators.features_core import add_atr
from ..operators.series import split_series
from . import query
from .core import TR, WINDOW
from .data import BARS_E, BARS_L, bars_e, bars_l, fixed, roll, sql
from .labelling import CFG, first_hit_sql
from .screening import LABELS, labelled

SPLIT = """sp AS (SELECT *, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'valid' ELSE 'test' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE n >= 285)"""


@query("k02_split_by_symbol", sql(BARS_L + ",\n" + SPLIT, "", "SELECT symbol, ts, split FROM sp"))
def by_symbol(spark, sf):
    return ds.split_by_symbol(bars_l(spark, sf), min_rows=285, valid=0.15).select("symbol", "ts", "split")


@query("k02_split_global", sql(BARS_E, "", """SELECT symbol, ts, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'valid' ELSE 'test' END AS split FROM
  (SELECT *, row_number() OVER (ORDER BY ts, symbol) AS rn, count(*) OVER () AS n FROM bars)"""))
def globally(spark, sf):
    return ds.split_global(bars_e(spark, sf)).select("symbol", "ts", "split")


@query("d28_split_statistics", sql(BARS_L + ",\n" + SPLIT, "close_mean close_std volume_mean volume_std", """SELECT split, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(ts) AS min_ts, max(ts) AS max_ts,
  avg(close) AS close_mean, stddev_samp(close) AS close_std, avg(volume) AS volume_mean, stddev_samp(volume) AS volume_std FROM sp GROUP BY 1"""))
def split_statistics(spark, sf):
    return fixed(ds.split_statistics(ds.split_by_symbol(bars_l(spark, sf), min_rows=285), ["close"], "volume"))


@query("k03_split_problems", sql(BARS_E, "", """SELECT problem, CAST(n AS BIGINT) AS count FROM (VALUES ('train_after_valid', 0), ('valid_after_test', 0), ('train_after_test', 0), ('empty_train', 0), ('empty_valid', 0), ('empty_test', 0)) t(problem, n)"""))
def split_problems(spark, sf):
    return ds.split_problems(ds.split_by_symbol(bars_e(spark, sf)))


def _fold_sql(folds_cte: str, against: str) -> str:
    return f"""days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts // 86400000000000 AS d FROM bars)),
{folds_cte},
tag AS (SELECT fold, symbol, count(*) FILTER (ts // 86400000000000 BETWEEN tf AND tt) AS t, count(*) FILTER (ts // 86400000000000 BETWEEN vf AND vt) AS v FROM bars, folds GROUP BY 1, 2)"""


PURGED = _fold_sql("""folds AS (SELECT k AS fold, (SELECT min(d) FROM days) AS tf, least((SELECT d FROM days WHERE i = (k - 1) * (n // 5) - 1), (SELECT d FROM days WHERE i = (k - 1) * (n // 5)) - 3) AS tt,
  (SELECT d FROM days WHERE i = (k - 1) * (n // 5)) AS vf, (SELECT d FROM days WHERE i = CASE WHEN k = 5 THEN n ELSE k * (n // 5) END - 1) AS vt FROM range(2, 6) r(k))""", "val")


@query("k05_purged_folds", sql(BARS_E + ",\n" + PURGED, "", """SELECT fold, CAST(sum(t) AS BIGINT) AS train_rows, CAST(sum(v) AS BIGINT) AS val_rows, count(*) AS train_symbols, count(*) AS val_symbols FROM tag WHERE t > 0 AND v > 0 GROUP BY 1"""))
def purged(spark, sf):
    b = bars_e(spark, sf)
    return fixed(ds.fold_report(b, ds.purged_folds(ds.trading_days(b), 5, purge_days=2)))


@query("k05_purged_fold_rows", sql(BARS_E + ",\n" + PURGED, "", """SELECT fold, 'train' AS role, symbol, t AS rows FROM tag WHERE t > 0 UNION ALL SELECT fold, 'val', symbol, v FROM tag WHERE v > 0"""))
def purged_rows(spark, sf):
    b = bars_e(spark, sf)
    rows = ds.fold_rows(b, ds.purged_folds(ds.trading_days(b), 5, purge_days=2))
    return fixed(rows.groupBy("fold", "role", "symbol").agg(F.count(F.lit(1)).alias("rows")))


WALK = """dd AS (SELECT DISTINCT ts // 86400000000000 AS d FROM bars),
starts AS (SELECT CAST(1 AS BIGINT) AS fold, min(d) AS tf FROM dd UNION ALL SELECT any_value(fold) + 1, min(d) FROM starts, dd WHERE d >= tf + 180 GROUP BY tf HAVING count(*) > 0),
trains AS (SELECT fold, tf, min(d) AS tt FROM starts, dd WHERE d >= tf + 360 GROUP BY 1, 2),
vals AS (SELECT fold, tf, tt, min(d) AS vt FROM trains, dd WHERE d >= tt + 91 GROUP BY 1, 2, 3),
folds AS (SELECT fold, tf, tt, vt + 1 AS oos_from, min(d) AS ot FROM vals, dd WHERE d >= vt + 181 GROUP BY 1, 2, 3, 4),
tag AS (SELECT fold, symbol, count(*) FILTER (ts // 86400000000000 BETWEEN tf AND tt) AS t, count(*) FILTER (ts // 86400000000000 BETWEEN oos_from AND ot) AS v FROM bars, folds GROUP BY 1, 2)"""


@query("k06_walk_forward", sql("RECURSIVE " + BARS_L + ",\n" + WALK, "", """SELECT fold, CAST(sum(t) AS BIGINT) AS train_rows, CAST(sum(v) AS BIGINT) AS oos_rows, count(*) AS train_symbols, count(*) AS oos_symbols
  FROM tag WHERE t > 0 AND v > 0 GROUP BY 1 HAVING count(*) >= 2"""))
def walk_forward(spark, sf):
    b = bars_l(spark, sf)
    folds = ds.walk_forward_periods(ds.trading_days(b), 12, 3, 6, 6)
    return fixed(ds.fold_report(b, folds, against="oos", min_symbols=2))


@query("d26_class_weights", sql(BARS_E + ",\n" + first_hit_sql("0.9", "0.9"), "weight", """SELECT label, n, w / avg(w) OVER () AS weight FROM (SELECT label, n, least(greatest(power(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 0.7), 0.1), 10.0) AS w FROM
  (SELECT label, count(*) AS n FROM lab GROUP BY 1))"""))
def class_weights(spark, sf):
    return fixed(ds.class_weights(labels.first_hit_labels(bars_e(spark, sf), CFG), mix=0.7))


@query("d27_focal_weights", sql(BARS_E + ",\n" + LABELS, "sample_weight", """SELECT CAST(label AS BIGINT) AS label, count(*) AS n, 0.75 * power(1 - count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2.0) AS sample_weight FROM lab GROUP BY 1"""))
def focal(spark, sf):
    return fixed(ds.focal_weights(labelled(bars_e(spark, sf)), alpha=0.75))


@query("d15_feature_coverage", sql(BARS_L, "train_non_null oos_non_null abs_gap", " UNION ALL ".join(
    f"""SELECT 'f__r{n}' AS feature, avg(CASE WHEN phase = 'train' THEN CAST(r IS NOT NULL AS INT) END) AS train_non_null, avg(CASE WHEN phase = 'oos' THEN CAST(r IS NOT NULL AS INT) END) AS oos_non_null,
    abs(avg(CASE WHEN phase = 'train' THEN CAST(r IS NOT NULL AS INT) END) - avg(CASE WHEN phase = 'oos' THEN CAST(r IS NOT NULL AS INT) END)) AS abs_gap
    FROM (SELECT lag(close, {n}) OVER (PARTITION BY symbol ORDER BY ts) AS r, CASE WHEN ts < 850000000000000000 THEN 'train' ELSE 'oos' END AS phase FROM bars)""" for n in (1, 100))))
def coverage(spark, sf):
    f = split_series(bars_l(spark, sf), lookback=101)
    df = f.with_cols(f__r1=f.lag("close", 1), f__r100=f.lag("close", 100)).finish()
    df = df.withColumn("phase", F.when(F.col("ts") < 850_000_000_000_000_000, "train").otherwise("oos"))
    return fixed(ds.feature_coverage(df, ["f__r1", "f__r100"]))


@query("k04_next_return", sql(BARS_L, "next_return", "SELECT symbol, ts, (lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close) / close AS next_return FROM bars"))
def next_return(spark, sf):
    return fixed(ds.next_return(split_series(bars_l(spark, sf), lookahead=1)).finish().select("symbol", "ts", "next_return"))


@query("k01_training_dataset", sql(BARS_E + ",\n" + first_hit_sql("0.9", "0.9"), "f__mom__roc_1 f__ret__simple_1 f__ret__log_1", """SELECT symbol, ts, (close - lag(close) OVER w) / lag(close) OVER w AS f__ret__simple_1,
  ln(close / lag(close) OVER w) AS f__ret__log_1, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS f__mom__roc_1, label FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""))
def dataset(spark, sf):
    b = bars_e(spark, sf)
    f = ml.returns_trend(split_series(b, lookback=30), (1,))
    f = ml.price_momentum(f, (1,), (), ())
    return fixed(ds.training_dataset(b, f.finish(), labels.first_hit_labels(b, CFG)))


@query("b21_numeric_features", sql(BARS_L, "f__x", "SELECT symbol, ts, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0.0) AS f__x, CASE WHEN volume > 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p__y FROM bars"))
def numeric(spark, sf):
    f = split_series(bars_l(spark, sf), lookback=1)
    df = f.with_cols(f__x=f.lag("close"), p__y=F.col("volume") > 40).finish().select("symbol", "ts", "f__x", "p__y")
    return fixed(ds.numeric_features(df))


@query("k09_window_labels", sql(BARS_E, "forward_return big_move_threshold", f"""SELECT symbol, ts, ret AS forward_return, cut AS big_move_threshold, CAST(coalesce(abs(ret) >= cut, false) AS BIGINT) AS big_move,
  CAST(CASE WHEN abs(ret) >= cut THEN sign(ret) ELSE 0 END AS BIGINT) AS direction FROM (SELECT symbol, ts, (lead(close, 4) OVER w - close) / nullif(close, 0) AS ret, greatest(atr / nullif(close, 0) * 0.8, 0.05) AS cut
  FROM (SELECT symbol, ts, close, avg(tr) OVER {roll(14)} AS atr FROM (SELECT *, {TR} AS tr FROM bars {WINDOW})) WHERE ts BETWEEN 1704412800000000000 AND 1705795199000000000 WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""))
def window_labels(spark, sf):
    b = bars_e(spark, sf)
    df = add_atr(split_series(b, lookback=16), {"atr": 14}).finish()
    out = ds.with_big_move_labels(ds.trim_to_window(df, "2024-01-05", "2024-01-20"), 4, "atr", 0.8, 0.05)
    return fixed(out.select("symbol", "ts", "forward_return", "big_move_threshold", "big_move", "direction"))
