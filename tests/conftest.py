from __future__ import annotations

import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

MIN = 60_000_000_000
# 2024-01-09 09:30 in New York
OPEN = 1704810600000000000


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tapeworks.shipping import ship_package

    ship_package(s)
    yield s


@pytest.fixture
def small_segments(spark):
    """Cut every series longer than 40 rows."""
    spark.conf.set("spark.tapeworks.segmentRows", "40")
    yield
    spark.conf.unset("spark.tapeworks.segmentRows")


def make_bars(spark, rows: dict[str, list[tuple]], start: int = OPEN, step: int = MIN):
    """{symbol: [(open, high, low, close, volume), ...]} at one-minute steps."""
    data = [(s, start + i * step, *map(float, r[:4]), int(r[4])) for s, rs in rows.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(data, "symbol string, ts long, open double, high double, low double, close double, volume long")


def walk(n: int, seed: int) -> list[tuple]:
    """Deterministic price path without a random generator."""
    out, p = [], 1000 + seed * 37
    for i in range(n):
        o = p
        p = max(50, p + ((i * 7919 + seed * 104729) % 41) - 20)
        hi, lo = max(o, p) + (i * 31 + seed) % 5, min(o, p) - (i * 17 + seed) % 5
        out.append((o, hi, lo, p, (i * 53 + seed * 11) % 97))
    return out


@pytest.fixture
def bars(spark):
    # one long symbol with most of the rows, one ordinary, one of a single row
    return make_bars(spark, {"HOT": walk(230, 1), "MID": walk(60, 2), "ONE": walk(1, 3)})


def frame(df, *keys) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
