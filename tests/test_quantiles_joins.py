from __future__ import annotations

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from tapeworks.operators import drift, modeling, screen
from tapeworks.operators.joins import asof_backward, next_bar
from tapeworks.operators.quantiles import exact_percentiles, kth_largest, order_statistics, running_by_value


@pytest.fixture
def values(spark):
    # a third of all rows share one key, with many ties and a heavy tail
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.pow((F.col("id") * 7919 % 1009).cast("double"), F.lit(3.0)).alias("v"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    return df.withColumn("v", F.when(F.col("v") > 0, F.col("v")))


def test_exact_percentiles(values):
    got = frame(exact_percentiles(values, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p999": 0.999, "p100": 1.0}), "k")
    pdf = values.toPandas().dropna()
    for r in got.itertuples():
        v = pdf.loc[pdf["k"] == r.k, "v"]
        assert [r.p10, r.p50, r.p999, r.p100] == pytest.approx([np.quantile(v, q) for q in (0.1, 0.5, 0.999, 1.0)])


def test_kth_largest(values):
    got = kth_largest(values, ["k"], "v", F.lit(5), "x").toPandas()
    pdf = values.toPandas().dropna()
    for r in got.itertuples():
        assert r.x == pdf.loc[pdf["k"] == r.k, "v"].sort_values().iloc[-5]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_by_value_and_auc(spark, values, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        running_and_auc(values)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def running_and_auc(values):
    got = frame(running_by_value(values, "v", {"n": F.lit(1)}), "value")
    counts = values.toPandas().dropna()["v"].value_counts().sort_index()
    assert got["n"].tolist() == counts.tolist() and got["n_below"].tolist() == (counts.cumsum() - counts).tolist()
    pdf = values.toPandas().dropna()
    ranks = pdf["v"].rank()
    n1 = (pdf["y"] == 1).sum()
    want = (ranks[pdf["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(pdf) - n1))
    assert drift.auc(values, "v", "y").first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize("rows", [10_000, 30])
def test_asof_matches_pandas(bars, rows):
    import pandas as pd

    right = bars.where("symbol = 'MID' and volume % 3 = 0").select("ts", F.col("close").alias("ref"))
    got = frame(asof_backward(bars, right, ["ref"], max_rows=rows), "symbol", "ts")
    want = pd.merge_asof(frame(bars, "ts"), frame(right, "ts"), on="ts").sort_values(["symbol", "ts"])["ref"]
    np.testing.assert_array_equal(got["ref"].to_numpy(), want.to_numpy())


def test_next_bar_drops_the_last(bars):
    got = next_bar(bars.select("symbol", "ts"), bars, {"nts": "ts"})
    assert got.count() == bars.count() - 3 and got.where("nts <= ts").count() == 0


def test_screen_is_deterministic_on_ties(spark, bars):
    top = screen.top_per_time(bars.withColumn("s", F.lit(1.0)), "s", 1)
    first = bars.groupBy("ts").agg(F.min("symbol").alias("m"))
    assert top.join(first, "ts").where("symbol != m").count() == 0


def test_stability_index_is_zero_for_equal_phases(values):
    both = values.withColumn("phase", F.explode(F.array(F.lit("reference"), F.lit("current"))))
    assert drift.stability_index(both, "v").first()["psi"] == pytest.approx(0.0, abs=1e-9)
    assert drift.two_sample_ks(both, "v").first()["ks"] == 0.0


def test_correlation_filter_and_selection(values):
    df = values.na.drop().withColumns({"w": F.col("v") * 2 + 1, "u": F.col("y") * 10.0 + F.rand(1), "lab": F.col("y").cast("double")})
    assert modeling.correlation_filter(df, ["v", "w", "u"]) == ["v", "u"]
    assert modeling.univariate_select(df, ["v", "u"], "lab", 1) == ["u"]
    assert "u" in modeling.lasso_select(df, ["v", "u"], "lab", 0.01)


def test_pca_keeps_enough_variance(values):
    df = values.na.drop().withColumns({"a": F.col("v"), "b": F.col("v") * -3.0, "c": F.rand(2)})
    out, shares = modeling.pca(df, ["a", "b", "c"], 0.6)
    assert len(shares) == 1 and shares[0] == pytest.approx(2 / 3, abs=0.05) and "pc_0" in out.columns


AWKWARD = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 1.0, 1.0000000000000002, 1.0000000000000004, 0.9999999999999999, -1.0, 1e308, 1.7976931348623157e308,
           -1.7976931348623157e308, 123456.78, 123456.79, 1e-5, 3.0, 3.0, 3.0, float("inf"), -float("inf"), 1e16, 1e16 + 2, -1e16, 2.0**-1060]


def test_every_rank_of_awkward_doubles(spark):
    import random

    rng = random.Random(1)
    near = [1.5]
    for _ in range(300):
        near.append(float(np.nextafter(near[-1], 2)))  # neighbouring doubles
    values = {"a": AWKWARD, "b": near, "c": [rng.uniform(1, 1.02) for _ in range(500)], "d": [7.25], "e": [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1000, 1000) for _ in range(300)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in rng.sample(vs, len(vs))] + [("a", None), ("z", None)], "k string, v double")
    for at in (0, 1, 5, 10, 17, 24, 25):
        got = {r["k"]: r["x"] for r in order_statistics(df, ["k"], "v", {"x": lambda total, at=at: F.least(F.lit(at), total - 1).cast("double")}).collect()}
        assert got == {k: sorted(vs)[min(at, len(vs) - 1)] for k, vs in values.items()}
    shares = {f"p{i}": i / 40 for i in range(41)}
    got = exact_percentiles(df.where("k = 'b'"), [], "v", shares).first().asDict()
    assert got == pytest.approx({n: float(np.quantile(near, q)) for n, q in shares.items()}, rel=1e-15)


def test_no_value_is_sorted_or_moved(values, monkeypatch):
    from tapeworks.operators import quantiles

    plans = []
    keep = quantiles.settle
    monkeypatch.setattr(quantiles, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    exact_percentiles(values, ["k"], "v", {"p50": 0.5}).collect()
    assert 2 <= len(plans) <= quantiles.ROUNDS
    for plan in plans:
        # values are counted before the first exchange: what is exchanged and sorted are histograms
        assert not any(x in plan for x in ("PythonUDF", "InPandas", "InArrow", "SortMergeJoin", "ShuffledHashJoin", "rangepartitioning"))
        lowest = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line][-1]
        assert "_d" in lowest and plan.index("partial_count") > plan.index(lowest)
    assert exact_percentiles(values.where("false"), [], "v", {"p50": 0.5}).collect() == []


