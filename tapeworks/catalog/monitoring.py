"""Error metrics, drift, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import to_ns
from ..operators import drift
from ..operators.series import split_series
from . import query
from .data import BARS_E, bars_e, fixed, mp, roll, sql, table
from .labelling import PREDS, predictions

PA = PREDS + """, pa AS (SELECT symbol, ts, prob_long AS pred, prob_short AS act, prob_neutral, volume, CASE WHEN ts < 1705363200000000000 THEN 'reference' ELSE 'current' END AS phase, CASE WHEN prob_long > 0.25 THEN 1 ELSE 0 END AS yp, CASE WHEN volume % 3 = 0 THEN 1 ELSE 0 END AS ya FROM preds)"""


def pa(spark, sf):
    p = predictions(bars_e(spark, sf))
    return p.select(
        "symbol", "ts", F.col("prob_long").alias("pred"), F.col("prob_short").alias("act"), "prob_neutral", "volume", F.when(F.col("ts") < 1705363200000000000, "reference").otherwise("current").alias("phase"),
        (F.col("prob_long") > 0.25).cast("int").alias("yp"), (F.col("volume") % 3 == 0).cast("int").alias("ya"))


@query("p01_regression_metrics", sql(BARS_E + ",\n" + PA, "mse mae r2 explained_variance", """SELECT symbol, count(*) AS n, avg((act - pred) ** 2) AS mse, avg(abs(act - pred)) AS mae, 1 - avg((act - pred) ** 2) / var_pop(act) AS r2, 1 - var_pop(act - pred) / var_pop(act) AS explained_variance FROM pa GROUP BY 1"""))
def regression(spark, sf):
    return fixed(drift.regression_metrics(pa(spark, sf), "pred", "act", ["symbol"]))


@query("p01_l11_binary_metrics", sql(BARS_E + ",\n" + PA, "accuracy precision recall f1".replace("precision", '"precision"'), """SELECT *, 2 * "precision" * recall / ("precision" + recall) AS f1 FROM (SELECT symbol, tp, fp, fn, tn, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, tp / CAST(tp + fp AS DOUBLE) AS "precision", tp / CAST(tp + fn AS DOUBLE) AS recall FROM
  (SELECT symbol, count(*) FILTER (yp = 1 AND ya = 1) AS tp, count(*) FILTER (yp = 1 AND ya = 0) AS fp, count(*) FILTER (yp = 0 AND ya = 1) AS fn, count(*) FILTER (yp = 0 AND ya = 0) AS tn FROM pa GROUP BY 1))"""))
def binary(spark, sf):
    return fixed(drift.binary_metrics(pa(spark, sf), "yp", "ya", ["symbol"]))


@query("l11_multiclass_metrics", sql("", '"precision" recall f1', """SELECT label, support, predicted, hits, p AS "precision", r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT c AS label, (SELECT count(*) FROM events WHERE event_id % 4 = c) AS support,
  (SELECT count(*) FROM events WHERE user_id % 4 = c) AS predicted, (SELECT count(*) FROM events WHERE event_id % 4 = c AND user_id % 4 = c) AS hits, coalesce((SELECT count(*) FROM events WHERE event_id % 4 = c AND user_id % 4 = c) / CAST((SELECT count(*) FROM events WHERE user_id % 4 = c) AS DOUBLE), 0) AS p,
  coalesce((SELECT count(*) FROM events WHERE event_id % 4 = c AND user_id % 4 = c) / CAST((SELECT count(*) FROM events WHERE event_id % 4 = c) AS DOUBLE), 0) AS r FROM (VALUES (0::BIGINT), (1), (2), (3)) v(c))"""))
def multiclass(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("p"), (F.col("event_id") % 4).alias("a"))
    return fixed(drift.multiclass_metrics(e, "p", "a"))


@query("l11_auc", sql(BARS_E + ",\n" + PA, "auc", """SELECT CAST(sum(ya) AS BIGINT) AS positives, count(*) AS rows, (sum(r * ya) - sum(ya) * (sum(ya) + 1) / 2.0) / (sum(ya) * (count(*) - sum(ya))) AS auc FROM
  (SELECT ya, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS r FROM pa)"""))
def auc(spark, sf):
    return fixed(drift.auc(pa(spark, sf), "pred", "ya"))


@query("l11_log_loss", sql(BARS_E + ",\n" + PA, "log_loss baseline_log_loss", """SELECT avg(-(ya * ln(p) + (1 - ya) * ln(1 - p))) AS log_loss, -(avg(ya) * ln(avg(ya)) + (1 - avg(ya)) * ln(1 - avg(ya))) AS baseline_log_loss FROM (SELECT ya, least(greatest(pred, 1e-15), 1 - 1e-15) AS p FROM pa)"""))
def log_loss(spark, sf):
    return fixed(drift.log_loss(pa(spark, sf), "pred", "ya"))


@query("p02_rolling_errors", sql(BARS_E + ",\n" + PA, "rolling_mse rolling_mae", f"""SELECT symbol, ts, avg((pred - act) ** 2) OVER {roll(30)} AS rolling_mse, avg(abs(pred - act)) OVER {roll(30)} AS rolling_mae FROM pa QUALIFY count(*) OVER {roll(30)} >= 30"""))
def rolling(spark, sf):
    f = split_series(pa(spark, sf), lookback=30, count_from=bars_e(spark, sf))
    return fixed(drift.rolling_errors(f, "pred", "act").select("symbol", "ts", "rolling_mse", "rolling_mae"))


@query("p08_concept_drift", sql(BARS_E + ",\n" + PA, "rolling_error jump", f"""SELECT * FROM (SELECT symbol, ts, e AS rolling_error, e - lag(e) OVER (PARTITION BY symbol ORDER BY ts) AS jump FROM (SELECT symbol, ts, {mp('avg({x})', 'abs(pred - act)', 20, 20)} AS e FROM pa)) WHERE jump > 0.008"""))
def concept(spark, sf):
    f = split_series(pa(spark, sf), lookback=22, count_from=bars_e(spark, sf))
    return fixed(drift.concept_drift(f, "pred", "act", 20, 0.008).select("symbol", "ts", "rolling_error", "jump"))


@query("p03_uncertainty", sql(BARS_E + ",\n" + PA, "avg_confidence confidence_std low_confidence_ratio", "SELECT avg(prob_neutral) AS avg_confidence, stddev_pop(prob_neutral) AS confidence_std, avg(CASE WHEN prob_neutral < 0.5 THEN 1.0 ELSE 0.0 END) AS low_confidence_ratio FROM pa"))
def uncertainty(spark, sf):
    return fixed(drift.uncertainty(pa(spark, sf), "prob_neutral"))


@query("p04_distribution", sql("", "mean std", 'SELECT count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS "min", max(value) AS "max" FROM events'))
def distribution(spark, sf):
    return fixed(drift.distribution(table(spark, sf, "events"), "value"))


@query("p04_outliers", sql("", "z_score", "SELECT event_id, value, z_score FROM (SELECT event_id, value, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z_score FROM events) WHERE abs(z_score) > 3"))
def outliers(spark, sf):
    return fixed(drift.outliers(table(spark, sf, "events"), "value").select("event_id", "value", "z_score"))


@query("p05_feature_drift", sql(BARS_E + ",\n" + PA, "mean_reference mean_current relative_shift", " UNION ALL ".join(f"""SELECT '{c}' AS feature, mr AS mean_reference, mc AS mean_current, abs(mc - mr) / greatest(sd, 1e-9) AS relative_shift, abs(mc - mr) / greatest(sd, 1e-9) > 0.02 AS drift_detected FROM
  (SELECT avg({c}) FILTER (phase = 'reference') AS mr, avg({c}) FILTER (phase = 'current') AS mc, stddev_pop({c}) AS sd FROM pa)""" for c in ("pred", "act", "volume"))))
def feature_drift(spark, sf):
    return fixed(drift.feature_drift(pa(spark, sf), ["pred", "act", "volume"], threshold=0.002))


@query("p06_target_drift", sql(BARS_E + ",\n" + PA, "mean_difference effect_size", """SELECT d AS mean_difference, d / greatest(s, 1e-9) AS effect_size, d / greatest(s, 1e-9) > 0.05 AS drift_detected FROM (SELECT abs(avg(act) FILTER (phase = 'reference') - avg(act) FILTER (phase = 'current')) AS d,
  sqrt((var_pop(act) FILTER (phase = 'reference') + var_pop(act) FILTER (phase = 'current')) / 2) AS s FROM pa)"""))
def target_drift(spark, sf):
    return fixed(drift.target_drift(pa(spark, sf), "act"))


@query("p07_stability_index", sql(BARS_E + ",\n" + PA, "psi", """SELECT sum((c - r) * ln(c / r)) AS psi, count(*) AS bins FROM (SELECT b, count(*) FILTER (phase = 'reference') / CAST(sum(count(*) FILTER (phase = 'reference')) OVER () AS DOUBLE) + 1e-9 AS r,
  count(*) FILTER (phase = 'current') / CAST(sum(count(*) FILTER (phase = 'current')) OVER () AS DOUBLE) + 1e-9 AS c FROM (SELECT phase, least(len(list_filter(e, lambda q: q <= x)) - 1, 9) AS b FROM (SELECT phase, CAST(volume AS DOUBLE) AS x, e FROM pa, (SELECT list_concat([q[1] - 1e-9], q[2:10], [q[11] + 1e-9]) AS e FROM
  (SELECT quantile_cont(CAST(volume AS DOUBLE), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM pa WHERE phase = 'reference'))) WHERE x >= e[1] AND x <= e[11]) GROUP BY 1)"""))
def psi(spark, sf):
    return fixed(drift.stability_index(pa(spark, sf), "volume"))


@query("p09_two_sample_ks", sql(BARS_E + ",\n" + PA, "ks", """SELECT max(abs(cr / nr - cc / nc)) AS ks, CAST(max(nr) AS BIGINT) AS reference_rows, CAST(max(nc) AS BIGINT) AS current_rows, max(abs(cr / nr - cc / nc)) > sqrt(1.8443972705 / (max(nr) * max(nc) / (max(nr) + max(nc)))) AS drift_detected FROM (
  SELECT CAST(sum(r) OVER (ORDER BY volume) AS DOUBLE) AS cr, CAST(sum(c) OVER (ORDER BY volume) AS DOUBLE) AS cc, CAST(sum(r) OVER () AS DOUBLE) AS nr, CAST(sum(c) OVER () AS DOUBLE) AS nc FROM (SELECT volume, count(*) FILTER (phase = 'reference') AS r, count(*) FILTER (phase = 'current') AS c FROM pa GROUP BY 1))"""))
def ks(spark, sf):
    return fixed(drift.two_sample_ks(pa(spark, sf), "volume"))


LOG = """lg AS (SELECT event_type AS model_id, epoch_us(ts) * 1000 AS ts, value - 1 AS latency_ms, CASE WHEN event_id % 17 <> 0 THEN value END AS prediction, user_id / 150.0 AS confidence FROM events)"""


@query("p10_request_metrics", sql(LOG, "avg_latency_ms requests_per_second mean_confidence std_confidence p95_latency_ms p99_latency_ms error_share", """SELECT model_id, count(*) AS requests, count(prediction) AS successes, avg(latency_ms) FILTER (latency_ms > 0) AS avg_latency_ms,
  count(*) / ((max(ts) - min(ts)) / 1e9) AS requests_per_second, avg(confidence) AS mean_confidence, stddev_pop(confidence) AS std_confidence, quantile_cont(latency_ms, 0.95) FILTER (latency_ms > 0) AS p95_latency_ms, quantile_cont(latency_ms, 0.99) FILTER (latency_ms > 0) AS p99_latency_ms,
  1 - count(prediction) / CAST(count(*) AS DOUBLE) AS error_share FROM lg GROUP BY 1"""))
def requests(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.col("event_type").alias("model_id"), to_ns("ts").alias("ts"), (F.col("value") - 1).alias("latency_ms"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("prediction"), (F.col("user_id") / 150.0).alias("confidence"))
    return fixed(drift.request_metrics(log))


@query("p11_threshold_alerts", sql("", "value", """SELECT user_id, 'mean' AS metric, v AS value, '>' AS operator, 30.0::DOUBLE AS threshold, 'high' AS severity FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) WHERE v > 30 UNION ALL
  SELECT user_id, 'mean', v, '<', 20.0::DOUBLE, 'low' FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) WHERE v < 20"""))
def alerts(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("value")).withColumn("metric", F.lit("mean"))
    return fixed(drift.threshold_alerts(v, [("mean", ">", 30.0, "high"), ("mean", "<", 20.0, "low")]))


@query("h12_feature_usage", sql("", "coverage", """SELECT f AS feature, count(*) AS predictions, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS coverage FROM (SELECT unnest(list_distinct(['f' || (user_id % 5), 'f' || (event_id % 3), 'base'])) AS f FROM events) GROUP BY 1"""))
def usage(spark, sf):
    e = table(spark, sf, "events")
    f = F.array(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")), F.lit("base"))
    return fixed(drift.feature_usage(e.select(f.alias("features_used"))))


@query("l13_importance_shares", sql("", "share", """SELECT feature, share, rank FROM (SELECT feature, importance / sum(importance) OVER () AS share, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM (SELECT p_brand AS feature, sum(p_size) AS importance FROM part GROUP BY 1)) WHERE rank <= 10"""))
def importance(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").alias("importance"))
    return fixed(drift.importance_shares(p, 10).select("feature", "share", "rank"))
