"""The registry of queries is consistent, and a sample of them equals its SQL on the smallest tables."""

from __future__ import annotations

import importlib
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_entry_has_rows(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["e04_core_pack", "e16_19_avwap_pack", "f06_premarket_shortlist", "i07_state_durations", "m03_round_trips", "o07_position_risk"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    check = importlib.import_module("check_oracle")
    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    idx = [names.index(c) for c in cols]
    got = sorted((tuple(check.norm(r[c]) for c in cols) for r in df.collect()), key=check.key)
    want = sorted((tuple(check.norm(r[i]) for i in idx) for r in res.fetchall()), key=check.key)
    assert got == want


def test_packs_without_windows(bars):
    from tapeworks.operators.features_ml import price_momentum
    from tapeworks.operators.series import split_series

    out = price_momentum(split_series(bars), (1,), (), ()).finish()
    assert out.columns == [*bars.columns, "f__mom__roc_1"] and out.count() == bars.count()


def test_every_query_runs(spark):
    """Every registered query of the library on the smallest tables, some side by side; the corpus queries have tests of their own."""
    entry = importlib.import_module("__spark_entry__")
    failed = {}

    def run(item) -> None:
        try:
            item[1](spark, SF).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            failed[item[0]] = str(e)[:300]

    own = [(n, fn) for n, fn in entry.queries().items() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(run, own))
    assert not failed
