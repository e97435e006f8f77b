from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in ("x", "c", "n", "component", "i", "v", "d", "count")}) if clash else df


def sample(n=60, dims=6, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.3 * j, 2.0 / (j + 1)) for j in range(dims)]) for i in range(n)]


def awkward(dims=6):
    good = sample(dims=dims)
    return good + [(900, None), (901, []), (902, [1.0] * (dims - 1) + [None]), (903, [math.nan] + [1.0] * (dims - 1)), (904, [math.inf] * dims), (905, [1.0] * (dims + 1)),
                   (None, good[0][1]), (906, good[1][1]), (906, good[1][1]), (907, [-0.0] * dims)] + [(1000 + i, good[2][1]) for i in range(200)]


def direct(rows, dims, k=4):
    """The contract with exact sums and a double eigensolver."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    s = [sum(x[j] for x in fit) for j in range(dims)]
    centred = np.array([[float(Fraction(x[j] * n - s[j], n)) for j in range(dims)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        y = np.array([float(Fraction(a * n - b, n)) for a, b in zip(x, s)]) @ (u / np.sqrt(e))
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, dev, y[c], e[c] / np.trace(centred.T @ centred / n)))
    return out


def test_query_columns_against_direct_computation(spark):
    rows = awkward()
    vectors = w.integer_vectors(table(spark, rows))
    got = w.whiten(vectors, w.fit(vectors)).collect()
    want = direct(rows, 6)
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, dev, y, share = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, dev) and abs(r["explained"] / share - 1) < 1e-10 and r["identity_error"] < 1e-12
        if abs(y) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(r["whitened"] * y))
        assert abs(abs(r["whitened"]) - abs(y)) < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_parts_and_block_size_change_nothing(spark, monkeypatch):
    vectors = w.integer_vectors(table(spark, sample(300, 5)))
    a = w.fit(vectors)
    monkeypatch.setattr(w, "BLOCK", 7)
    b = w.fit(vectors.repartition(9))
    assert (a.n, a.sums, a.trace) == (b.n, b.sums, b.trace) and np.array_equal(a.vectors, b.vectors) and np.array_equal(a.values, b.values)


def test_large_entries_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2.0**e + 2.0 ** (e + 3))) for e in (0, 20, 44)]) for i in range(40)]
    vectors = w.integer_vectors(table(spark, rows))
    xs = sorted({tuple(r["x"]) for r in vectors.collect()})
    n, sums = w._sums(vectors.select("x").distinct())
    assert n == len(xs) and sums == [sum(x[j] for x in xs) for j in range(3)]
    centre = [s // n for s in sums]
    first, second = w._products(vectors.select("x").distinct(), centre)
    assert first == [sum(x[j] - centre[j] for x in xs) for j in range(3)]
    assert all(second[i, j] == sum((x[i] - centre[i]) * (x[j] - centre[j]) for x in xs) for i in range(3) for j in range(3))
    got = w.whiten(vectors, w.fit(vectors)).collect()
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 0)


def test_entries_beyond_a_long(spark):
    vectors = w.integer_vectors(table(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [3.4e38, 5.0])]))
    assert {tuple(r["x"]) for r in vectors.collect()} == {(w.LONG_MAX, 256), (-w.LONG_MAX - 1, 512), (w.LONG_MAX, 1280)}
    assert len(w.whiten(vectors, w.fit(vectors)).collect()) >= 3


@pytest.mark.parametrize("gap", [0.0, 2.0**-30, 2.0**-20, 2.0**-8])
def test_clustered_eigenvalues(gap):
    d = 64
    h = np.eye(d) - np.ones((d, d)) * 2 / d  # exact reflection
    values = np.concatenate([1 + gap * np.arange(4), 3 + gap * np.arange(3), np.arange(5, 5 + d - 7)])
    a = (h * values) @ h
    e, x = w.refined_eigenvectors(a)
    assert np.abs(np.sort(values)[::-1] - e).max() < 1e-13
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(d)).max() < 2e-15
    assert np.abs(a @ wide - wide * e).max() < 1e-13
    if gap >= 2.0**-20:
        true = h[:, np.argsort(-values, kind="stable")]
        assert np.abs(np.abs(x) - np.abs(true)).max() < 1e-18 * 100 / gap + 1e-14


def test_better_than_its_float32_start():
    rng = np.random.default_rng(1)
    b = rng.normal(size=(200, 40))
    a = b.T @ b
    e, x = w.refined_eigenvectors(a)
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    off = lambda v: np.abs(v.T @ a @ v - np.diag(np.diag(v.T @ a @ v))).max() / np.abs(a).max()
    assert off(start) > 1e-8 and off(x) < 1e-14


def test_no_spread_and_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        vectors = w.integer_vectors(table(spark, rows))
        assert w.whiten(vectors, w.fit(vectors)).collect() == []
    line = w.integer_vectors(table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)]))
    assert {r["component"] for r in w.whiten(line, w.fit(line)).collect()} == {1}
