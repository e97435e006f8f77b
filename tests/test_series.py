"""Segmented series give what whole series give; features do not depend on partitioning or the future."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import frame, make_bars
from pyspark.sql import functions as F

from tapeworks.operators import features_core, features_ml, features_profile, features_regime, features_structure, features_vpa, labels
from tapeworks.operators.series import affine_recurrence, affine_scan, ema, split_series

PACKS = {
    "core": features_core.core_pack, "regime": features_regime.regime_pack, "vpa": features_vpa.vpa_pack,
    "structure": features_structure.structure_and_flow_pack, "profile": lambda b, **k: features_profile.profile_pack(b, step=5.0, window=30, **k),
    "ml": lambda b, **k: features_ml.ml_pack(b, ["returns_trend", "price_momentum", "conviction_signals"], **k),
    "labels": lambda b, **k: labels.first_hit_labels(b, labels.FirstHitConfig(horizon_minutes=10), **k),
}


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", PACKS)
def test_split_equals_whole(bars, name):
    fn = PACKS[name]
    same(frame(fn(bars), "symbol", "ts"), frame(fn(bars, max_rows=40), "symbol", "ts"))


@pytest.mark.parametrize("name", ["core", "regime", "vpa", "ml", "profile"])
def test_split_is_identical_on_fractional_prices(spark, name):
    from conftest import make_bars, walk

    bars = make_bars(spark, {"HOT": [(*(x / 7 for x in r[:4]), r[4]) for r in walk(1500, 1)], "B": [(*(x / 3 for x in r[:4]), r[4]) for r in walk(50, 2)]})
    fn = PACKS[name]
    a, b = frame(fn(bars), "symbol", "ts"), frame(fn(bars, max_rows=500), "symbol", "ts")
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=True)


def test_windows_longer_than_usual_are_identical_too(spark):
    from conftest import make_bars, walk

    bars = make_bars(spark, {"HOT": [(*(x / 7 for x in r[:4]), r[4]) for r in walk(3000, 4)]})
    a, b = (frame(features_vpa.vpa_pack(bars, breakout_n=700, **k), "symbol", "ts") for k in ({}, {"max_rows": 900}))
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=True)


def test_a_hot_day_is_cut(spark):
    from conftest import make_bars

    bars = make_bars(spark, {"H": [(1, 1, 1, 1, 1)] * 20_000}, start=1704844800000000000, step=4_000_000_000)
    f = split_series(bars, lookback=10, max_rows=500)
    sizes = f.df.groupBy("_seg").count().toPandas()["count"]
    assert sizes.max() <= 500 + 10 + 2 * 500 // 64 + 8 and sizes.sum() <= 20_000 * (1 + (10 + 2) / 500) + 20 and f.finish().count() == 20_000


def _vwap(spark, rows, n=30):
    from conftest import make_bars

    got = features_core.add_vwap(split_series(make_bars(spark, {"S": [(p, p, p, p, v) for p, v in rows]})), {"vwap": n}).finish()
    return frame(got, "symbol", "ts")["vwap"]


def test_one_large_value_does_not_outlive_its_window(spark):
    assert _vwap(spark, [(1e12, 10**6)] + [(1.1, 1)] * 100).iloc[40:].to_numpy() == pytest.approx(1.1, rel=1e-12)
    got = _vwap(spark, [(105 + i % 3 / 7, 90_000_000) for i in range(1000)] + [(50.05, 3)] * 60)
    assert got.iloc[-10:].to_numpy() == pytest.approx(50.05, rel=1e-12)
    late = _vwap(spark, [(2.0, 5)] * 10 + [(float("inf"), 5)] + [(2.0, 5)] * 60)
    assert late.iloc[45:].to_numpy() == pytest.approx(2.0)


def test_infinite_prices_are_missing_after_ingestion(spark):
    from tapeworks.sources.bars import normalise_bars

    raw = spark.createDataFrame([("A", 1, 1.0, float("inf"), 1.0, float("nan"), 5.0)], "symbol string, ts long, open double, high double, low double, close double, volume double")
    row = normalise_bars(raw).first()
    assert row["open"] == 1.0 and row["high"] is None and row["close"] is None


def test_rolling_errors_forget_an_early_error(spark):
    from tapeworks.operators import drift

    rows = spark.createDataFrame([("S", i, 1e8 if i == 0 else 1.0 + (i % 2) / 100, 1.0) for i in range(200)], "symbol string, ts long, pred double, actual double")
    got = frame(drift.rolling_errors(split_series(rows), "pred", "actual", 20), "symbol", "ts")
    assert got["rolling_mse"].iloc[-1] == pytest.approx(5e-5, rel=1e-9)


@pytest.mark.parametrize("name", ["core", "regime", "vpa"])
def test_row_order_and_partitions_do_not_matter(bars, name):
    fn = PACKS[name]
    same(frame(fn(bars), "symbol", "ts"), frame(fn(bars.repartition(7, "volume")), "symbol", "ts"))


@pytest.mark.parametrize("name", ["regime", "vpa", "ml"])
def test_features_do_not_look_ahead(bars, name):
    cut = bars.agg(F.max("ts")).first()[0] - 100 * 60_000_000_000
    fn = PACKS[name]
    past = bars.where(F.col("ts") <= cut)
    same(frame(fn(past), "symbol", "ts"), frame(fn(bars).where(F.col("ts") <= cut), "symbol", "ts"))


def test_symbols_are_independent(bars):
    one = frame(features_regime.regime_pack(bars.where("symbol = 'MID'")), "symbol", "ts")
    same(one, frame(features_regime.regime_pack(bars).where("symbol = 'MID'"), "symbol", "ts"))


def test_segments_are_bounded(bars):
    f = split_series(bars, lookback=5, lookahead=3, max_rows=40, bucket=10 * 60_000_000_000)
    assert f.split
    sizes = f.df.groupBy("symbol", "_seg").count().toPandas()
    assert sizes["count"].max() <= 40 + 10 + 20 + 20
    core = f.finish()
    assert core.count() == bars.count() and core.select("symbol", "ts").distinct().count() == bars.count()


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("rows", [10_000, 40])
def test_ema_matches_pandas(bars, adjust, rows):
    got = frame(ema(split_series(bars, max_rows=rows, bucket=60_000_000_000), "close", 9, "y", adjust).finish(), "symbol", "ts")
    want = got.groupby("symbol")["close"].transform(lambda s: s.ewm(span=9, adjust=adjust).mean())
    np.testing.assert_allclose(got["y"], want, rtol=1e-9)


@pytest.mark.parametrize("rows", [10_000, 40])
def test_affine_recurrence(bars, rows):
    df = bars.withColumns({"a": (F.col("volume") % 3) / 2.0, "b": F.col("close")})
    got = frame(affine_recurrence(split_series(df, max_rows=rows, bucket=60_000_000_000), "a", "b", "y").finish(), "symbol", "ts")
    for _, g in got.groupby("symbol"):
        y = 0.0
        for a, b, v in zip(g["a"], g["b"], g["y"], strict=True):
            y = a * y + b
            assert v == pytest.approx(y, rel=1e-9)


@pytest.mark.parametrize("n", [5, 20])
def test_rolling_means_match_pandas(bars, n):
    f = split_series(bars).sums((n,), x="close")
    got = frame(f.with_cols(m=f.mean("x", n, 3)).drop_sums().finish(), "symbol", "ts")
    want = got.groupby("symbol")["close"].transform(lambda s: s.rolling(n, min_periods=3).mean())
    np.testing.assert_allclose(got["m"].astype(float), want, rtol=1e-12)


def test_null_prices_count_as_missing(spark, bars):
    holes = bars.withColumn("close", F.when(F.col("volume") % 4 != 0, F.col("close")))
    f = split_series(holes).sums((6,), x="close")
    got = frame(f.with_cols(m=f.mean("x", 6, 2)).drop_sums().finish(), "symbol", "ts")
    want = got.groupby("symbol")["close"].transform(lambda s: s.rolling(6, min_periods=2).mean())
    np.testing.assert_allclose(got["m"].astype(float), want, rtol=1e-9)


def test_affine_scan_equals_a_loop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 15, 16, 17, 300, 5000):
        a, b, first = rng.choice([0.0, 0.5, 1.0, 2.0, -1.5, 0.9], n), rng.normal(size=n), rng.random(n) < 0.02
        b[first & (rng.random(n) < 0.3)] = np.inf  # a series' infinity or missing value stays in the series
        b[first & (rng.random(n) < 0.2)] = np.nan
        for start in (0.0, 3.0):
            slope, offset, new = affine_scan(a, b, first)
            y, passed, want = start, False, []
            for f, x, s in zip(a, b, first):
                y, passed = (x, True) if s else (f * y + x, passed)
                want.append(y)
            got = np.where(new, offset, slope * start + offset)
            np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9 * np.nanmax(np.abs(np.where(np.isfinite(want), want, 0))) if n > 1 else 0)


def test_cross_section_ranks_in_slices(spark, small_segments):
    from tapeworks.operators.features_ml import cross_section

    n = 240
    b = make_bars(spark, {f"S{s:03d}": [(p, p, p, p, 1) for p in (100, 100 + (s * 7) % 90, 100 + (s * s) % 50, 100 + s % 3)[: 2 + s % 3]] for s in range(n)})
    df = cross_section(split_series(b, lookback=3), (1, 2))
    tasks = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert tasks < n / 2  # 240 symbols hold the first time
    got, want = frame(df, "symbol", "ts"), frame(b, "symbol", "ts")
    for k in (1, 2):
        r = want.groupby("symbol")["close"].pct_change(k)
        at = r.groupby(want["ts"])
        rank = at.rank(method="average") / at.transform("count")
        pd.testing.assert_series_equal(got[f"f__cross__ret_percentile_{k}"], rank, check_names=False)
