"""Feature scaling, selection, staged models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as ds
from ..operators import features_ml as fm
from ..operators import labels
from ..operators import modeling as md
from ..operators.features_core import add_atr
from ..operators.series import split_series
from ..streaming.jobs import work_folder
from . import query
from .data import bars_l, fixed, sql, table

LI = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_extendedprice AS p, l_discount * 100 AS d, l_tax * 100 AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""
COLS = ["q", "p", "d", "t"]


def li(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"))


def scaled(df, keep=("q", "p")):
    return fixed(df.select("l_orderkey", "l_linenumber", "l_partkey", *[f"{c}_scaled" for c in keep]))


@query("l01_standard_scale", sql(LI, "q_scaled p_scaled", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS q_scaled, (p - avg(p) OVER ()) / stddev_samp(p) OVER () AS p_scaled FROM li"))
def standard(spark, sf):
    return scaled(md.scale(li(spark, sf), ["q", "p"]))


@query("l01_minmax_scale", sql(LI, "q_scaled p_scaled", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS q_scaled, (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()) AS p_scaled FROM li"))
def minmax(spark, sf):
    return scaled(md.scale(li(spark, sf), ["q", "p"], "minmax"))


@query("l01_robust_scale", sql(LI, "q_scaled p_scaled", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, (q - quantile_cont(q, 0.5) OVER ()) / (quantile_cont(q, 0.75) OVER () - quantile_cont(q, 0.25) OVER ()) AS q_scaled, "
       "(p - quantile_cont(p, 0.5) OVER ()) / (quantile_cont(p, 0.75) OVER () - quantile_cont(p, 0.25) OVER ()) AS p_scaled FROM li"))
def robust(spark, sf):
    return scaled(md.scale(li(spark, sf), ["q", "p"], "robust"))


@query("l01_quantile_scale", sql(LI, "q_scaled", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, len(list_filter(e, lambda x: x <= q)) / CAST(len(e) AS DOUBLE) AS q_scaled FROM li,
  (SELECT list_distinct(quantile_cont(q, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS e FROM li)"""))
def quantile(spark, sf):
    return scaled(md.quantile_scale(li(spark, sf), ["q"], 20), ("q",))


@query("h07_uniform_bins", sql(LI, "", "SELECT " + ", ".join(f"CAST(count(*) FILTER ({c}) AS BIGINT) AS q_bin_{i}" for i, c in enumerate(
    ["q <= 1 + 49.0 / 5", *[f"q > 1 + 49.0 * {i} / 5 AND q <= 1 + 49.0 * {i + 1} / 5" for i in range(1, 5)]])) + " FROM li"))
def uniform_bins(spark, sf):
    df = md.bin_columns(li(spark, sf), "q", 5, "uniform")
    return df.agg(*[F.sum(f"q_bin_{i}").alias(f"q_bin_{i}") for i in range(5)])


@query("h07_quantile_bins", sql(LI, "", "SELECT " + ", ".join(f"CAST(count(*) FILTER (p > e[{i + 1}] AND p <= e[{i + 2}]) AS BIGINT) AS p_bin_{i}" if i else "CAST(count(*) FILTER (p >= e[1] AND p <= e[2]) AS BIGINT) AS p_bin_0" for i in range(4)) +
       " FROM li, (SELECT quantile_cont(p, [0, 0.25, 0.5, 0.75, 1]) AS e FROM li)"))
def quantile_bins(spark, sf):
    df = md.bin_columns(li(spark, sf), "p", 4)
    return df.agg(*[F.sum(f"p_bin_{i}").alias(f"p_bin_{i}") for i in range(4)])


@query("l02_pca")
def pca(spark, sf):
    df, _ = md.pca(li(spark, sf), COLS, 0.6)
    return fixed(df.select("l_orderkey", "l_linenumber", *[c for c in df.columns if c.startswith("pc_")]))


@query("l04_f_scores", sql(LI, "f_score", " UNION ALL ".join(f"""SELECT '{c}' AS feature, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score FROM (SELECT y, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM li) AS g FROM li GROUP BY y)""" for c in COLS)))
def f_scores(spark, sf):
    return fixed(md.f_scores(li(spark, sf), COLS, "y"))


@query("l04_univariate_selection")
def univariate(spark, sf):
    names = md.univariate_select(li(spark, sf).withColumn("y", F.col("y").cast("double")), COLS, "y", 2)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("l05_mutual_information", sql(LI, "mutual_information", " UNION ALL ".join(f"""SELECT '{c}' AS feature, sum(n / t * ln(n * t / (nb * ny))) AS mutual_information FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS nb,
  CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny FROM (SELECT y, len(list_filter(e, lambda x: x <= {c})) AS b, count(*) AS n FROM li, (SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM li) GROUP BY 1, 2))""" for c in COLS)))
def mutual(spark, sf):
    return fixed(md.mutual_information(li(spark, sf), COLS, "y"))


@query("l07_correlations", sql(LI, "correlation", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS correlation FROM li" for i, a in enumerate(COLS) for b in COLS[i + 1:])))
def correlations(spark, sf):
    return fixed(md.correlations(li(spark, sf), COLS))


def training_rows(spark, sf):
    """Weekly bars with a few features, the big-move label and a reward."""
    f = split_series(bars_l(spark, sf), lookback=40, lookahead=5)
    f = add_atr(f, {"atr": 14})
    f = labels.big_move_labels(f, 5, "atr", 0.8, 0.01)
    f = fm.returns_trend(f, (1, 5))
    f = fm.price_momentum(f, (1,), (14,), (5, 20))
    df = f.finish().where("forward_return is not null")
    df = df.withColumn("expected_r", F.abs("forward_return") / F.col("big_move_threshold"))
    # training reads its rows many times: they are made once, as a file in the shared folder
    root = f"{work_folder(spark)}/rows"
    df.select("symbol", "ts", "big_move", "direction", "expected_r", *FEATURES).write.parquet(root)
    return spark.read.parquet(root)


FEATURES = ["f__ret__simple_1", "f__ret__simple_5", "f__mom__rsi_14", "f__ma__ratio_5", "f__ma__ratio_20"]


@query("l06_elimination_and_lasso")
def elimination(spark, sf):
    df = training_rows(spark, sf).withColumn("y", F.col("big_move").cast("double"))
    kept = md.recursive_elimination(df, FEATURES, "y", 3, trees=5)
    lasso = md.lasso_select(df, FEATURES, "y", 0.001)
    return spark.createDataFrame([(c, c in kept, float(lasso.get(c, 0.0))) for c in FEATURES], "feature string, kept boolean, coefficient double")


@query("l08_l09_staged_scores")
def staged(spark, sf):
    df = training_rows(spark, sf)
    models = md.train_staged(df, FEATURES, maxIter=10)
    return fixed(md.score_staged(models, df.select("symbol", "ts", *FEATURES)).drop(*FEATURES))


@query("l03_l14_prediction_table")
def prediction_table(spark, sf):
    df = training_rows(spark, sf).withColumn("y", F.col("big_move").cast("double"))
    model = md.train(df, FEATURES, "forest", "y", numTrees=5)
    return md.prediction_table(model, df.select("symbol", "ts", *FEATURES), FEATURES, "forest-1").withColumn("features_used", F.size("features_used"))


@query("l12_fold_accuracy")
def fold_accuracy(spark, sf):
    from ..operators.experiments import fold_aggregate

    df = training_rows(spark, sf).withColumn("y", F.col("big_move").cast("double")).select("symbol", "ts", "y", *FEATURES)
    folds = ds.purged_folds(ds.trading_days(df), 3, purge_days=35)
    return fixed(fold_aggregate(md.run_folds(df, folds, FEATURES, "logistic", "y", maxIter=5)))
