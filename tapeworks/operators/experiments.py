"""Tables over many runs: summaries, comparisons with a baseline, leaderboards, sweeps, fairness."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.mathcols import div, flag
from .equity import equity_metrics
from .quantiles import exact_percentiles

# Weights of the composite variant score.
VARIANT_WEIGHTS = {"total_return": 0.3, "sharpe": 0.3, "max_drawdown": -0.2, "win_rate": 0.2}


def one_group() -> WindowSpec:
    """All rows together: only for tables with one row per run or variant."""
    return Window.partitionBy(F.lit(0))


def run_summary(trades: DataFrame, curve: DataFrame, key: str = "run_id") -> DataFrame:
    """Trade and equity summary, one row per run."""
    t = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg("pnl").alias("avg_trade_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.sum("pnl").alias("total_pnl"))
    med = exact_percentiles(trades, [key], "r_multiple", {"median_r_multiple": 0.5})
    return t.join(med, key, "left").join(equity_metrics(curve, (key,)), key, "full_outer")


def unpivot_metrics(summary: DataFrame, key: str, metrics: Iterable[str]) -> DataFrame:
    metrics = list(metrics)
    return summary.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "value")


def comparison_table(summary: DataFrame, key: str, metrics: Iterable[str], variants: list[str]) -> DataFrame:
    """Metrics as rows, variants as columns."""
    return unpivot_metrics(summary, key, metrics).groupBy("metric").pivot(key, variants).agg(F.first("value"))


def baseline_difference(summary: DataFrame, key: str, metrics: Iterable[str], baseline: str) -> DataFrame:
    """Absolute and relative difference of every variant's metric from the baseline variant's."""
    long = unpivot_metrics(summary, key, metrics)
    base = long.where(F.col(key) == baseline).select("metric", F.col("value").alias("_b"))
    j = long.join(base, "metric", "left")
    same = F.col(key) == baseline
    return j.select(key, "metric", "value", F.when(same, 0.0).otherwise(F.col("value") - F.col("_b")).alias("difference"),
                    F.when(same, 0.0).otherwise(div(F.col("value"), F.col("_b")) - 1).alias("pct_difference"))


def leaderboard(summary: DataFrame, key: str, metric: str) -> DataFrame:
    w = one_group().orderBy(F.col(metric).desc_nulls_last(), key)
    return summary.withColumn("rank", F.row_number().over(w)).withColumn("winner", F.col("rank") == 1)


def variant_ranking(summary: DataFrame, key: str = "run_id") -> DataFrame:
    score = F.lit(0.0)
    for m, wt in VARIANT_WEIGHTS.items():
        score = score + F.coalesce(F.col(m), F.lit(0.0)) * wt
    return summary.withColumn("score", score).withColumn("rank", F.rank().over(one_group().orderBy(F.col("score").desc())))


def significance(summary: DataFrame, key: str, metrics: Iterable[str]) -> DataFrame:
    """Per metric: best and worst variant and the relative improvement, where any value is positive."""
    long = unpivot_metrics(summary, key, metrics)
    g = long.groupBy("metric").agg(
        F.max("value").alias("best_value"), F.min("value").alias("worst_value"),
        F.min_by(key, F.struct(-F.col("value"), F.col(key))).alias("best_variant"),
        F.min_by(key, F.struct(F.col("value"), F.col(key))).alias("worst_variant"))
    g = g.where((F.col("best_value") > 0) & (F.col("best_value") != F.col("worst_value")))
    imp = F.coalesce(div(F.col("best_value") - F.col("worst_value"), F.abs("worst_value")), F.lit(0.0)) * 100
    return g.withColumn("improvement_pct", imp)


def run_statistics(summary: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """Spread of each metric over the runs; one row per run bounds the exact median."""
    long = unpivot_metrics(summary, summary.columns[0], metrics).where(F.col("value").isNotNull())
    return long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("max"),
        F.min("value").alias("min"), F.stddev_samp("value").alias("std"), F.sum((F.col("value") > 0).cast("long")).alias("positive_runs"))


def hash_statistics(runs: DataFrame, hashes: list[str]) -> DataFrame:
    """How many runs share each combination of input hashes."""
    return runs.groupBy(*hashes).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("seed").alias("seeds"))


def extreme_runs(summary: DataFrame, key: str, metric: str, activity: str, n: int = 3) -> DataFrame:
    """Best, worst and most active runs, and those without trades, as (kind, rank, run)."""
    def top(kind: str, order) -> DataFrame:
        return summary.withColumn("rank", F.row_number().over(one_group().orderBy(order, key))).where(F.col("rank") <= n).select(
            F.lit(kind).alias("kind"), "rank", key)

    none = summary.where(F.coalesce(F.col(activity), F.lit(0)) == 0).select(
        F.lit("zero_trades").alias("kind"), F.row_number().over(one_group().orderBy(key)).alias("rank"), key)
    return top("best", F.col(metric).desc_nulls_last()).unionByName(top("worst", F.col(metric).asc_nulls_last())).unionByName(
        top("most_active", F.col(activity).desc_nulls_last())).unionByName(none)


def sweep_summary(results: DataFrame, metric: str, params: list[str], others: list[str]) -> DataFrame:
    """Range of the metric, its correlation with and slope over every parameter, best parameter values."""
    cols = [F.count(F.lit(1)).alias("combinations"), F.min(metric).alias("low"), F.max(metric).alias("high"), F.avg(metric).alias("mean"),
            F.stddev_samp(metric).alias("std")]
    best = F.struct(F.col(metric), *[-F.col(p) for p in params])
    for p in params:
        cols += [F.max_by(p, best).alias(f"best_{p}"), F.corr(metric, p).alias(f"corr_{p}"),
                 F.regr_slope(metric, F.col(p).cast("double")).alias(f"slope_{p}")]
    for i, a in enumerate(others):
        cols += [F.corr(a, b).alias(f"corr_{a}_{b}") for b in others[i + 1:]]
    return results.agg(*cols)


def cost_impact(results: DataFrame, metric: str, param: str) -> DataFrame:
    """Mean metric per parameter value and the correlation of value and mean."""
    g = results.groupBy(param).agg(F.avg(metric).alias("mean_metric"))
    return g.withColumn("correlation", F.corr(F.col(param).cast("double"), F.col("mean_metric")).over(one_group()))


def fairness(runs: DataFrame, key: str, experiment: str, hashes: list[str], trades: str) -> DataFrame:
    """Per experiment: whether all runs used the same inputs, and warnings about their trade counts."""
    g = runs.groupBy(experiment).agg(
        F.count(F.lit(1)).alias("runs"), *[F.countDistinct(h).alias(f"_{h}") for h in hashes],
        F.min(trades).alias("_lo"), F.max(trades).alias("_hi"), F.countDistinct(trades).alias("_d"))
    bad = F.array_compact(F.array(F.when(F.col("runs") < 2, F.lit("insufficient_variants")),
                                  *[F.when(F.col(f"_{h}") > 1, F.lit(f"mismatch_{h}")) for h in hashes]))
    warn = F.array_compact(F.array(
        F.when((F.col("_d") == 1) & (F.col("_hi") > 0) & (F.col("runs") > 1), F.lit("identical_trade_counts_across_variants")),
        F.when((F.col("_hi") > 0) & ((F.col("_lo") == 0) | flag(F.col("_hi") / F.nullif(F.col("_lo"), F.lit(0)) > 10)),
               F.lit("extreme_trade_count_difference"))))
    return g.select(experiment, "runs", (F.size(bad) == 0).alias("is_fair"), bad.alias("violations"), warn.alias("warnings"))


def value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value, count) of several columns in one pass."""
    columns = list(columns)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def fold_aggregate(metrics: DataFrame, value: str = "value") -> DataFrame:
    """Over folds, per metric: mean, deviation, range, stability 1 / (1 + deviation), slope over the fold number."""
    return metrics.groupBy("metric").agg(
        F.count(F.lit(1)).alias("folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.regr_slope(value, F.col("fold").cast("double")).alias("slope")).withColumn(
        "stability", 1 / (1 + F.col("std")))
