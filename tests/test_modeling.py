"""Models are fitted on every row; scores, scaling and components exist for every row."""

from __future__ import annotations

import numpy as np
import pytest

from tapeworks.operators import modeling as md


@pytest.fixture(scope="module")
def rows(spark):
    data = [("S", i, float(i % 7), None if i % 5 == 0 else float(i % 3), float(i % 2), int(i % 2), 1.0 + i % 4) for i in range(200)]
    data[7] = ("S", 7, float("nan"), 1.0, 1.0, 1, 2.0)
    return spark.createDataFrame(data, "symbol string, ts long, a double, b double, y double, big_move int, expected_r double").selectExpr("*", "IF(ts % 4 < 2, 1, -1) AS direction")


def test_every_row_is_scored_with_zero_for_missing(rows):
    model = md.train(rows, ["a", "b"], "logistic", "y", maxIter=5)
    got = {r["ts"]: r["p"] for r in md.positive_probability(model, rows, "p").collect()}
    filled = {r["ts"]: r["p"] for r in md.positive_probability(model, rows.na.fill(0.0, ["a", "b"]), "p").collect()}
    assert len(got) == 200 and got == filled
    assert md.prediction_table(model, rows, ["a", "b"], "m").count() == 200


def test_staged_scores_keep_all_rows(rows):
    scored = md.score_staged(md.train_staged(rows, ["a", "b"], maxIter=3), rows)
    assert scored.count() == 200 and scored.where("prob_bigmove IS NULL OR expected_r_bigmove < 1.5").count() == 0
    assert set(rows.columns) <= set(scored.columns)


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaling_keeps_rows(rows, method):
    got = md.scale(rows, ["a", "b"], method).select("ts", "b_scaled", "a_scaled").collect()
    assert len(got) == 200 and all((r["b_scaled"] is None) == (r["ts"] % 5 == 0) for r in got)


def test_components_keep_rows(rows):
    got, shares = md.pca(rows, ["a", "b"])
    assert got.count() == 200 and got.where("pc_0 IS NULL").count() == 41 and 0.95 <= sum(shares) <= 1.0 + 1e-9


def test_every_row_is_fitted_with_zero_for_missing(rows):
    rows = rows.selectExpr("*", "IF(ts < 3, 1.0D, NULL) AS sparse")
    cols = ["a", "b", "sparse"]
    filled = rows.na.fill(0.0, cols)
    fitted = lambda model: model.stages[-1].summary.predictions.count()
    assert fitted(md.train(rows, cols, "logistic", "y", maxIter=3)) == rows.count()
    staged, want = md.train_staged(rows, cols, maxIter=3), md.train_staged(filled, cols, maxIter=3)
    assert fitted(staged["move"]) == rows.count() and fitted(staged["side"]) == rows.where("big_move = 1").count()
    assert md.score_staged(staged, filled).orderBy("ts").collect() == md.score_staged(want, filled).orderBy("ts").collect()
    assert md.lasso_select(rows, cols, "y", 0.001) == md.lasso_select(filled, cols, "y", 0.001) != {}
    assert md.recursive_elimination(rows, cols, "y", 2, trees=3) == md.recursive_elimination(filled, cols, "y", 2, trees=3)
    assert md.univariate_select(rows, cols, "y", 2) == md.univariate_select(filled, cols, "y", 2)


def test_robust_scale_keeps_incomplete_rows(spark):
    rows = [(i, float(i * i), None if i % 3 else 2.0 * i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, gone double")
    got = {r["id"]: r for r in md.scale(df, ["a", "b", "gone"], "robust").collect()}
    for c, k in (("a", 1), ("b", 2)):
        v = np.array([r[k] for r in rows if r[k] is not None])
        low, mid, high = np.quantile(v, [0.25, 0.5, 0.75])
        assert all(got[r[0]][f"{c}_scaled"] == (None if r[k] is None else pytest.approx((r[k] - mid) / (high - low))) for r in rows)
    assert len(got) == 40 and all(r["gone_scaled"] is None for r in got.values())


def test_training_rows_are_made_once(spark):
    from tapeworks.catalog.learning import training_rows

    plan = training_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # before, every pass of a fit derived the bars and features anew
    assert "Window" not in plan and "Exchange" not in plan and "FileScan parquet" in plan
