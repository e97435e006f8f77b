"""Model and data monitoring: error metrics, drift, stability index, alerts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathcols import div
from .joins import attach_one_row
from .quantiles import exact_percentiles, running_by_value
from .series import Frame


def regression_metrics(df: DataFrame, pred: str, actual: str, by: Iterable[str] = ()) -> DataFrame:
    e = F.col(actual) - F.col(pred)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(e).alias("_ve"), F.var_pop(actual).alias("_va"))
    return g.withColumns({"r2": 1 - div(F.col("mse"), F.col("_va")), "explained_variance": 1 - div(F.col("_ve"), F.col("_va"))}).drop("_ve", "_va")


def binary_metrics(df: DataFrame, pred: str, actual: str, by: Iterable[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of class 1."""
    p, a = F.col(pred) == 1, F.col(actual) == 1
    n = lambda c: F.sum(c.cast("long"))
    g = df.groupBy(*by).agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"), n(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    g = g.withColumns({"accuracy": (tp + tn) / (tp + fp + fn + tn), "precision": F.coalesce(div(tp, tp + fp), zero), "recall": F.coalesce(div(tp, tp + fn), zero)})
    pr, rc = F.col("precision"), F.col("recall")
    return g.withColumn("f1", F.coalesce(div(2 * pr * rc, pr + rc), zero))


def multiclass_metrics(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """(class, support, precision, recall, f1) from the confusion counts."""
    cells = df.groupBy(F.col(pred).alias("p"), F.col(actual).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))).alias("r")).select("r.*")
    g = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    g = g.withColumns({"precision": F.coalesce(div(F.col("hits"), F.col("predicted")), zero), "recall": F.coalesce(div(F.col("hits"), F.col("support")), zero)})
    pr, rc = F.col("precision"), F.col("recall")
    return g.withColumn("f1", F.coalesce(div(2 * pr * rc, pr + rc), zero))


def auc(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks; equal probabilities share their rank."""
    hit = (F.col(label) == 1).cast("long")
    v = running_by_value(df, prob, {"n": F.lit(1).cast("long"), "pos": hit})
    rank = F.col("n_below") + (F.col("n") + 1) / 2.0
    g = v.agg(F.sum(rank * F.col("pos")).alias("_r"), F.sum("pos").alias("positives"), F.sum("n").alias("rows"))
    p, n = F.col("positives"), F.col("rows") - F.col("positives")
    return g.withColumn("auc", div(F.col("_r") - p * (p + 1) / 2.0, (p * n).cast("double"))).drop("_r")


def log_loss(df: DataFrame, prob: str, label: str, eps: float = 1e-15) -> DataFrame:
    """Log loss and that of always predicting the class frequency."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    g = df.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg(y.cast("double")).alias("_f"))
    f = F.col("_f")
    return g.withColumn("baseline_log_loss", F.when((f > 0) & (f < 1), -(f * F.ln(f) + (1 - f) * F.ln(1 - f))).otherwise(0.0)).drop("_f")


def rolling_errors(f: Frame, pred: str, actual: str, n: int = 30) -> DataFrame:
    """Rolling mean squared and absolute error; only rows with a full window."""
    e = F.col(pred) - F.col(actual)
    f = f.sums((n,), sq=e * e, ab=F.abs(e))
    f = f.with_cols(rolling_mse=f.mean("sq", n), rolling_mae=f.mean("ab", n)).drop_sums()
    return f.finish().where(F.col("rolling_mse").isNotNull())


def concept_drift(f: Frame, pred: str, actual: str, n: int = 50, threshold: float = 0.05) -> DataFrame:
    """Rows where the rolling mean absolute error jumped by more than the threshold."""
    f = f.sums((n,), ab=F.abs(F.col(pred) - F.col(actual)))
    f = f.with_cols(rolling_error=f.mean("ab", n)).drop_sums()
    f = f.with_cols(jump=F.col("rolling_error") - f.lag("rolling_error"))
    return f.finish().where(F.col("jump") > threshold)


def uncertainty(df: DataFrame, prob: str) -> DataFrame:
    return df.agg(F.avg(prob).alias("avg_confidence"), F.stddev_pop(prob).alias("confidence_std"),
                  F.avg((F.col(prob) < 0.5).cast("double")).alias("low_confidence_ratio"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def outliers(df: DataFrame, value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows more than ``sigmas`` population deviations from the mean."""
    m = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = div(F.col(value) - F.col("_m"), F.col("_s"))
    return attach_one_row(df, m).withColumn("z_score", z).drop("_m", "_s").where(F.abs("z_score") > sigmas)


def feature_drift(df: DataFrame, features: list[str], phase: str = "phase", threshold: float = 0.05) -> DataFrame:
    """Shift of each feature's mean between the reference and current phase, in pooled deviations."""
    aggs = []
    for c in features:
        for p in ("reference", "current"):
            aggs.append(F.avg(F.when(F.col(phase) == p, F.col(c))).alias(f"{p}|{c}"))
        aggs.append(F.stddev_pop(F.when(F.col(phase).isin("reference", "current"), F.col(c))).alias(f"sd|{c}"))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`reference|{c}`").alias("mean_reference"), F.col(f"`current|{c}`").alias("mean_current"),
                              F.col(f"`sd|{c}`").alias("_sd")) for c in features])
    out = df.agg(*aggs).select(F.inline(rows))
    shift = F.abs(F.col("mean_current") - F.col("mean_reference")) / F.greatest(F.col("_sd"), F.lit(1e-9))
    return out.withColumn("relative_shift", shift).withColumn("drift_detected", F.coalesce(F.col("relative_shift") > threshold * 10, F.lit(False))).drop("_sd")


def target_drift(df: DataFrame, target: str, phase: str = "phase", threshold: float = 0.05) -> DataFrame:
    r, c = (F.when(F.col(phase) == p, F.col(target)) for p in ("reference", "current"))
    g = df.agg(F.abs(F.avg(r) - F.avg(c)).alias("mean_difference"), F.sqrt((F.var_pop(r) + F.var_pop(c)) / 2).alias("_sd"))
    return g.withColumn("effect_size", F.col("mean_difference") / F.greatest(F.col("_sd"), F.lit(1e-9))).withColumn(
        "drift_detected", F.col("effect_size") > threshold).drop("_sd")


def stability_bins(df: DataFrame, value: str, phase: str = "phase", bins: int = 10) -> DataFrame:
    """Share of reference and current rows per reference-quantile bin (values outside the range are left out)."""
    ref = df.where(F.col(phase) == "reference")
    names = [f"q{i:03d}" for i in range(bins + 1)]
    edges = exact_percentiles(ref, [], value, {n: i / bins for i, n in enumerate(names)})
    arr = F.array(F.col(names[0]) - 1e-9, *[F.col(n) for n in names[1:-1]], F.col(names[-1]) + 1e-9)
    tagged = attach_one_row(df, edges.select(arr.alias("_e")))
    x = F.col(value)
    inside = (x >= F.get("_e", F.lit(0))) & (x <= F.get("_e", F.lit(bins)))
    bin_ = F.least(F.size(F.filter("_e", lambda e: e <= x)) - 1, F.lit(bins - 1))
    g = tagged.where(inside).groupBy(bin_.alias("bin")).agg(
        F.sum((F.col(phase) == "reference").cast("long")).alias("reference_rows"), F.sum((F.col(phase) == "current").cast("long")).alias("current_rows"))
    w = Window.partitionBy(F.lit(0))  # at most ``bins`` rows
    share = lambda c: F.col(c) / F.sum(c).over(w) + 1e-9
    return g.withColumns({"reference_share": share("reference_rows"), "current_share": share("current_rows")})


def stability_index(df: DataFrame, value: str, phase: str = "phase", bins: int = 10) -> DataFrame:
    """Population stability index; a bin empty on one side still counts through the small constant."""
    b = stability_bins(df, value, phase, bins)
    r, c = F.col("reference_share"), F.col("current_share")
    return b.agg(F.sum((c - r) * F.ln(c / r)).alias("psi"), F.count(F.lit(1)).alias("bins"))


def two_sample_ks(df: DataFrame, value: str, phase: str = "phase") -> DataFrame:
    """Largest distance between the empirical distributions of the two phases."""
    v = running_by_value(df, value, {"r": (F.col(phase) == "reference").cast("long"), "c": (F.col(phase) == "current").cast("long")})
    totals = v.agg(F.sum("r").alias("_nr"), F.sum("c").alias("_nc"))
    upto = lambda s, n: (F.col(f"{s}_below") + F.col(s)) / F.col(n)
    g = attach_one_row(v, totals).agg(F.max(F.abs(upto("r", "_nr") - upto("c", "_nc"))).alias("ks"), F.max("_nr").alias("reference_rows"), F.max("_nc").alias("current_rows"))
    n = F.col("reference_rows") * F.col("current_rows") / (F.col("reference_rows") + F.col("current_rows"))
    # Critical distance at the 5% level of the asymptotic distribution.
    return g.withColumn("drift_detected", F.col("ks") > F.sqrt(F.lit(1.8443972705) / n))


def request_metrics(log: DataFrame, by: Iterable[str] = ("model_id",)) -> DataFrame:
    """Latency, rate, errors and confidence per model; latencies of zero or less are not counted."""
    by = list(by)
    lat = log.where(F.col("latency_ms") > 0)
    q = exact_percentiles(lat, by, "latency_ms", {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99})
    span = (F.max("ts") - F.min("ts")) / 1e9
    g = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count("prediction").alias("successes"), F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("avg_latency_ms"),
        F.coalesce(div(F.count(F.lit(1)), span), F.lit(0.0)).alias("requests_per_second"), F.avg("confidence").alias("mean_confidence"), F.stddev_pop("confidence").alias("std_confidence"))
    return g.join(q, by, "left").withColumn("error_share", 1 - F.col("successes") / F.col("requests"))


def threshold_alerts(values: DataFrame, rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """(metric, value) rows that break (metric, operator, threshold, severity) rules."""
    tests = {">": lambda v, t: v > t, "<": lambda v, t: v < t, ">=": lambda v, t: v >= t, "<=": lambda v, t: v <= t}
    hits = F.array_compact(F.array(*[
        F.when((F.col("metric") == m) & tests[op](F.col("value"), F.lit(float(t))), F.struct(F.lit(op).alias("operator"), F.lit(float(t)).alias("threshold"), F.lit(sev).alias("severity")))
        for m, op, t, sev in rules]))
    return values.select("*", F.inline(hits))


def feature_usage(df: DataFrame, features: str = "features_used") -> DataFrame:
    """Share of predictions that used each feature (array column)."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    used = df.select(F.explode(F.array_distinct(F.col(features))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("predictions"))
    return attach_one_row(used, total).select("feature", "predictions", (F.col("predictions") / F.col("_n")).alias("coverage"))


def importance_shares(df: DataFrame, top: int | None = None) -> DataFrame:
    """Importance as a share of the total, ranked (one row per feature)."""
    w = Window.partitionBy(F.lit(0))
    share = F.coalesce(div(F.col("importance"), F.sum("importance").over(w)), F.lit(0.0))
    out = df.withColumn("share", share).withColumn("rank", F.row_number().over(w.orderBy(F.col("share").desc(), "feature")))
    return out.where(F.col("rank") <= top) if top else out
