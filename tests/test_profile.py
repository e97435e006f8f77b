"""The rolling volume profile against plain histograms."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from conftest import frame, make_bars, walk

from tapeworks.operators import features_profile as fp


def direct(rows, step, window):
    out = []
    for i in range(len(rows)):
        hist = Counter()
        for r in rows[max(0, i - window + 1) : i + 1]:
            lo, hi = int(np.floor(r[2] / step)), int(np.ceil(r[1] / step))
            for b in range(lo, hi):
                hist[b] += int(np.floor(r[4] / max(hi - lo, 1) * fp.SCALE + 0.5))
        volume = sum(hist.values())
        if i + 1 < fp.MIN_BARS or not volume:
            out.append((None,) * 3)
            continue
        centre = lambda b: b * step + step / 2
        poc = centre(min(b for b in hist if hist[b] == max(hist.values())))
        cum, at = 0, {}
        for b in range(min(hist), max(hist) + 1):
            cum += hist[b]
            for share in (fp.LOW_SHARE, fp.HIGH_SHARE):
                if share not in at and cum / volume >= share:
                    at[share] = centre(b)
        out.append((poc, max(at[fp.HIGH_SHARE], poc), min(at[fp.LOW_SHARE], poc)))
    return out


@pytest.mark.parametrize("batch", [10_000, 13])
@pytest.mark.parametrize(("step", "window"), [(1.0, 25), (3.0, 60), (0.5, 7)])
def test_profile_equals_plain_histograms(spark, batch, step, window):
    series = {"A": walk(150, 1), "B": walk(30, 2), "C": walk(3, 4)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = frame(fp.profile_pack(make_bars(spark, series), step, window), "symbol", "ts")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [x for rows in series.values() for x in direct(rows, step, window)]
    cols = ["f__profile__poc", "f__profile__vah", "f__profile__val"]
    assert [tuple(None if np.isnan(v) else v for v in r) for r in got[cols].to_numpy(float)] == want


def test_segments_equal_the_whole(spark):
    bars = make_bars(spark, {"A": walk(230, 1)})
    whole, cut = (frame(fp.profile_pack(bars, 2.0, 30, max_rows=n), "symbol", "ts") for n in (10_000, 60))
    assert whole.equals(cut)


def test_a_bar_of_any_price_needs_no_more_memory(spark):
    rows = walk(60, 1) + [(1e9, 4e12, 1.0, 1e9, 50)] + walk(60, 2)
    got = frame(fp.profile_pack(make_bars(spark, {"A": rows}), 0.01, 20), "symbol", "ts")
    assert got["f__profile__poc"].notna().sum() == 121 - 19
