"""Feature scaling and selection, staged classifiers and scoring with Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    PCA, Bucketizer, MinMaxScaler, StandardScaler, UnivariateFeatureSelector, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathcols import no_nan
from .joins import attach_one_row
from .quantiles import exact_percentiles


def assembler(cols: list[str], out: str = "features", invalid: str = "skip") -> VectorAssembler:
    """Scaling and components are fitted without rows that miss a feature ("skip"); what transforms a table keeps every row ("keep", NaN for missing)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=invalid)


def _known(col: str) -> Column:
    """A feature as models are fitted and scored with it: a missing value counts as 0."""
    return F.coalesce(F.nanvl(F.col(col).cast("double"), F.lit(0.0)), F.lit(0.0))


def known(df: DataFrame, cols: list[str]) -> DataFrame:
    """All rows of df, missing features filled."""
    return df.withColumns({c: _known(c) for c in cols})


def _spread(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    arr = vector_to_array(F.col(vector))
    return df.withColumn("_a", arr).withColumns({n: no_nan(F.col("_a")[i]) for i, n in enumerate(names)}).drop("_a")


SCALERS = {
    "standard": lambda: StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
    "minmax": lambda: MinMaxScaler(inputCol="_v", outputCol="_s"),
}


def scale(df: DataFrame, cols: list[str], method: str = "standard") -> DataFrame:
    """Scaled copies ``{col}_scaled`` of the columns; a row with a missing value is kept and its missing copies are NULL.

    ``robust`` takes the distance from the median in exact quartile ranges of the column's own values (0 where the range is 0).
    """
    if method == "robust":
        out = df
        for c in cols:
            low, mid, high = (f"_{q}_{c}" for q in ("low", "mid", "high"))
            of_column = exact_percentiles(df, [], c, {low: 0.25, mid: 0.5, high: 0.75}).withColumn("_one", F.lit(1))  # no row for a column of NULLs
            out = out.withColumn("_one", F.lit(1)).join(F.broadcast(of_column), "_one", "left").drop("_one")
            spread = F.col(high) - F.col(low)
            value = F.when(spread == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(mid)) / spread)
            out = out.withColumn(f"{c}_scaled", F.when(F.col(c).isNotNull(), value)).drop(low, mid, high)
        return out
    model = SCALERS[method]().fit(assembler(cols, "_v").transform(df))
    return _spread(model.transform(assembler(cols, "_v", "keep").transform(df)), "_s", [f"{c}_scaled" for c in cols]).drop("_v", "_s")


def _edges_below(edges: str, col: str) -> Column:
    """How many elements of the edge array are at or below the value."""
    x = F.col(col)
    return F.size(F.filter(edges, lambda e: e <= x))


def quantile_scale(df: DataFrame, cols: list[str], buckets: int = 100) -> DataFrame:
    """Each value's bucket among the column's quantiles, as a number in [0, 1]."""
    out = df
    for c in cols:
        edges = exact_percentiles(df, [], c, {f"q{i:04d}": i / buckets for i in range(1, buckets)})
        arr = edges.select(F.array_distinct(F.array(*edges.columns)).alias("_e"))
        out = attach_one_row(out, arr).withColumn(f"{c}_scaled", _edges_below("_e", c) / F.size("_e")).drop("_e")
    return out


def bin_columns(df: DataFrame, col: str, n: int = 5, strategy: str = "quantile") -> DataFrame:
    """One-hot bin membership ``{col}_bin_{i}``; edges are equal widths or quantiles of the column."""
    if strategy == "uniform":
        ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        edges = [ends["lo"] + (ends["hi"] - ends["lo"]) * i / n for i in range(n + 1)]
    elif strategy == "quantile":
        row = exact_percentiles(df, [], col, {f"q{i:03d}": i / n for i in range(n + 1)}).first()
        edges = list(row)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    edges = sorted(set(edges))
    # Bins are (low, high] except the first, which is closed on both sides.
    x = F.col(col)
    cols: dict[str, Column] = {}
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        cols[f"{col}_bin_{i}"] = ((x >= lo if i == 0 else x > lo) & (x <= hi)).cast("int")
    return df.withColumns(cols)


def bucketize(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def pca(df: DataFrame, cols: list[str], variance: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Components explaining at least ``variance``, as columns pc_0.., and their shares; they are NULL for rows with a missing value."""
    complete = assembler(cols, "_v").transform(df)
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(complete)
    scaled = scaler.transform(complete)
    shares = list(PCA(k=len(cols), inputCol="_s", outputCol="_p").fit(scaled).explainedVariance)
    k, total = 0, 0.0
    while k < len(shares) and total < variance:
        total += shares[k]
        k += 1
    every = scaler.transform(assembler(cols, "_v", "keep").transform(df))
    out = PCA(k=max(k, 1), inputCol="_s", outputCol="_p").fit(scaled).transform(every)
    return _spread(out, "_p", [f"pc_{i}" for i in range(max(k, 1))]).drop("_v", "_s", "_p"), shares[: max(k, 1)]


# --- selection ------------------------------------------------------------------------------------------


def univariate_select(df: DataFrame, cols: list[str], label: str, k: int) -> list[str]:
    """Best k features by F-test against a categorical label."""
    data = assembler(cols, "_v").transform(known(df, cols))
    sel = UnivariateFeatureSelector(featuresCol="_v", labelCol=label, outputCol="_o", selectionMode="numTopFeatures")
    sel = sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return [cols[i] for i in sel.fit(data).selectedFeatures]


def f_scores(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """One-way F statistic of each feature over the label's classes, from sums only."""
    long = df.unpivot([label], cols, "feature", "x").where(F.col("x").isNotNull())
    by = long.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    g = by.withColumn("_g", grand).groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_g"), F.lit(2))).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"))
    return g.select("feature", ((F.col("ssb") / (F.col("classes") - 1)) / (F.col("ssw") / (F.col("rows") - F.col("classes")))).alias("f_score"))


def mutual_information(df: DataFrame, cols: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of each binned feature with the label, from the contingency counts."""
    edges = None
    for c in cols:
        q = exact_percentiles(df, [], c, {f"q{i}": i / bins for i in range(1, bins)})
        one = q.select(F.array_distinct(F.array(*q.columns)).alias(f"_e_{c}"))
        edges = one if edges is None else attach_one_row(edges, one)
    tagged = attach_one_row(df, edges)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), _edges_below(f"_e_{c}", c).alias("bin")) for c in cols])
    cells = tagged.select(F.col(label).alias("y"), F.inline(parts)).groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    pb, py = F.sum("n").over(Window.partitionBy("feature", "bin")), F.sum("n").over(Window.partitionBy("feature", "y"))
    cells = cells.withColumns({"_t": total, "_b": pb, "_y": py})
    p = F.col("n") / F.col("_t")
    return cells.groupBy("feature").agg(F.sum(p * F.ln(F.col("n") * F.col("_t") / (F.col("_b") * F.col("_y")))).alias("mutual_information"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every pair's correlation in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    s = F.split("pair", "\\|")
    return wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "correlation").select(s[0].alias("left"), s[1].alias("right"), "correlation")


def correlation_filter(df: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    """Keep a feature unless an earlier kept one correlates with it beyond the threshold."""
    strong = {(r["left"], r["right"]) for r in correlations(df, cols).where(F.abs("correlation") > threshold).collect()}
    kept: list[str] = []
    for c in cols:
        if not any((k, c) in strong for k in kept):
            kept.append(c)
    return kept


def recursive_elimination(df: DataFrame, cols: list[str], label: str, keep: int, step: int = 1, trees: int = 20, seed: int = 7) -> list[str]:
    """Drop the least important forest features until ``keep`` are left."""
    left, df = list(cols), known(df, cols)
    while len(left) > keep:
        model = RandomForestClassifier(labelCol=label, featuresCol="_v", numTrees=trees, seed=seed).fit(assembler(left, "_v").transform(df))
        imp = model.featureImportances.toArray()
        order = sorted(range(len(left)), key=lambda i: (imp[i], left[i]))
        drop = {left[i] for i in order[: min(step, len(left) - keep)]}
        left = [c for c in left if c not in drop]
    return left


def lasso_select(df: DataFrame, cols: list[str], label: str, strength: float = 0.01) -> dict[str, float]:
    """Non-zero coefficients of an L1-penalised regression on standardised features."""
    model = LinearRegression(featuresCol="_v", labelCol=label, elasticNetParam=1.0, regParam=strength, standardization=True).fit(
        assembler(cols, "_v").transform(known(df, cols)))
    return {c: float(w) for c, w in zip(cols, model.coefficients, strict=True) if abs(w) > 1e-12}


# --- models ---------------------------------------------------------------------------------------------


def classifier(kind: str, label: str, weight: str | None = None, seed: int = 7, **params):
    cls = {"forest": RandomForestClassifier, "logistic": LogisticRegression, "boosted": GBTClassifier}[kind]
    est = cls(labelCol=label, featuresCol="features", **params)
    if kind != "logistic":
        est = est.setSeed(seed)
    return est.setWeightCol(weight) if weight else est


def train(df: DataFrame, cols: list[str], kind: str, label: str, weight: str | None = None, **params) -> PipelineModel:
    """Assemble, scale and fit; a tri-class label must be encoded 0, 1, 2."""
    stages = [assembler(cols, "_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), classifier(kind, label, weight, **params)]
    return Pipeline(stages=stages).fit(known(df, cols))


def encode_tri_class(label: Column) -> Column:
    return (label + 1).cast("double")


def train_staged(df: DataFrame, cols: list[str], kind: str = "logistic", **params) -> dict[str, PipelineModel]:
    """Three models: is it a big move, which way if so, and the expected R of big moves.

    Wants columns big_move (0/1), direction (-1/0/1) and expected_r.
    """
    data = df.withColumns({"_big": F.col("big_move").cast("double"), "_up": (F.col("direction") > 0).cast("double")})
    big = data.where("big_move = 1")
    stages = [assembler(cols, "features"), GBTRegressor(labelCol="expected_r", featuresCol="features", maxIter=5, maxDepth=3, seed=7)]
    return {"move": train(data, cols, kind, "_big", **params), "side": train(big, cols, kind, "_up", **params), "reward": Pipeline(stages=stages).fit(known(big, cols))}


def _inputs(model: PipelineModel) -> list[str]:
    """The feature columns a fitted pipeline reads."""
    return list(next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols())


def score(model: PipelineModel, df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """All rows and columns of df with the named columns of the model's output; a missing feature counts as 0, so no row is lost."""
    given = F.struct(*df.columns)
    filled = [_known(c).alias(c) for c in _inputs(model)]
    out = model.transform(df.select(given.alias("_given"), *filled))
    return out.select("_given.*", *(c.alias(n) for n, c in cols.items()))


def positive_probability(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    return score(model, df, {out: vector_to_array(F.col("probability"))[1]})


def score_staged(models: dict[str, PipelineModel], df: DataFrame, min_expected_r: float = 1.5) -> DataFrame:
    """Probabilities of a big move and its side, clipped, with expected R floored."""
    df = positive_probability(models["move"], df, "prob_bigmove")
    df = positive_probability(models["side"], df, "prob_bigmove_long")
    df = score(models["reward"], df, {"expected_r_bigmove": F.greatest("prediction", F.lit(min_expected_r))})
    return df.withColumn("prob_bigmove_short", 1.0 - F.col("prob_bigmove_long"))


def prediction_table(model: PipelineModel, df: DataFrame, cols: list[str], model_id: str) -> DataFrame:
    """(symbol, ts, prediction, max probability, model id, map of the features used)."""
    scored = score(model, df, {"_prediction": F.col("prediction"), "_probability": F.array_max(vector_to_array(F.col("probability")))})
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols]))
    return scored.select("symbol", "ts", F.col("_prediction").alias("prediction"), F.col("_probability").alias("probability"),
                         F.lit(model_id).alias("model_id"), values.alias("features_used"))


def run_folds(df: DataFrame, folds: Iterable[dict], cols: list[str], kind: str, label: str, **params) -> DataFrame:
    """Accuracy of a model trained and judged on every fold: (fold, metric, value)."""
    from .datasets import fold_rows

    out = None
    for f in folds:
        rows = fold_rows(df, [f])
        model = train(rows.where("role = 'train'"), cols, kind, label, **params)
        judged = score(model, rows.where("role = 'val'"), {"_prediction": F.col("prediction")})
        acc = judged.agg(F.avg((F.col("_prediction") == F.col(label)).cast("double")).alias("value"))
        part = acc.select(F.lit(f["fold"]).alias("fold"), F.lit("accuracy").alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out
