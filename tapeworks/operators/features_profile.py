"""Rolling volume profile: point of control and value area over the last ``window`` bars.

Each bar spreads its volume evenly over the price bins it spans.  Weights are fixed-point integers, so the
rolling histogram can be updated by adding and removing bars without drift and ties are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import flag
from .series import Frame, scan_rows, split_series

SCALE = 1 << 20
LOW_SHARE, HIGH_SHARE, MIN_BARS = 0.15, 0.85, 20
CELLS = 2_000_000


def _share_bin(share: float, volume: np.ndarray, edges: np.ndarray, height: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """First bin at which the summed volume reaches a share of the whole: the interval between two edges first, then the bin inside it."""
    rows = np.arange(len(height))
    at = (upto / volume[:, None] >= share).argmax(axis=1)
    h, width = np.maximum(height[rows, at], 1), np.diff(edges)[at]
    before = upto[rows, at] - height[rows, at] * width
    k = np.clip(np.ceil((share * volume - before) / h) - 1, 0, width - 1).astype(np.int64)
    k -= (k > 0) & ((before + h * k) / volume >= share)  # the estimate is at most one bin off
    k += (k < width - 1) & ((before + h * (k + 1)) / volume < share)
    return edges[at] + k


def _profile(low: np.ndarray, high: np.ndarray, volume: np.ndarray, held: int, seen: int, step: float, window: int) -> list[np.ndarray]:
    """Point of control, value area high and low of the rows from ``held`` on; ``seen`` rows of the series came before those at hand.

    A bar's volume lies evenly between two edges, so the histogram of a window is constant between neighbouring edges of its bars and is kept at
    the edges only: its size follows from the number of bars, whatever their prices and the step.
    """
    n = len(low)
    usable = ~(np.isnan(low) | np.isnan(high) | np.isnan(volume))
    lo, hi = (np.where(usable, f(x / step), 0).astype(np.int64) for f, x in ((np.floor, low), (np.ceil, high)))
    weight = np.floor(np.where(usable, volume, 0) / np.maximum(hi - lo, 1) * SCALE + 0.5).astype(np.int64)
    weight[hi <= lo] = 0
    out = [np.full(n - held, np.nan) for _ in range(3)]
    block = max(64, int((CELLS / 2) ** 0.5) - window)
    for start in range(held, n, block):
        end, first = min(n, start + block), max(0, start - window + 1)
        edges, at = np.unique(np.concatenate((lo[first:end], hi[first:end])), return_inverse=True)
        if len(edges) < 2:
            continue
        m = end - first
        change = np.zeros((m, len(edges)), dtype=np.int64)
        r = np.arange(m)
        np.add.at(change, (r, at[:m]), weight[first:end])
        np.add.at(change, (r, at[m:]), -weight[first:end])
        total = np.cumsum(np.cumsum(change[:, :-1], axis=1), axis=0)
        now = np.arange(start, end) - first
        height = total[now]
        old = now - window
        height[old >= 0] -= total[old[old >= 0]]
        upto = np.cumsum(height * np.diff(edges), axis=1)
        ok = (seen + np.arange(start, end) + 1 >= MIN_BARS) & (upto[:, -1] > 0)
        whole = np.where(upto[:, -1] > 0, upto[:, -1], 1)
        poc = edges[height.argmax(axis=1)] * step + step / 2
        val, vah = (_share_bin(share, whole, edges, height, upto) * step + step / 2 for share in (LOW_SHARE, HIGH_SHARE))
        for x, y in zip(out, (poc, np.maximum(vah, poc), np.minimum(val, poc))):
            x[start - held : end - held] = np.where(ok, y, np.nan)
    return out


def add_profile(f: Frame, step: float = 0.1, window: int = 100) -> Frame:
    """Needs window - 1 halo rows; the first bars of a series (fewer than 20 seen) have no profile.  Rows stream through in order, three columns
    of them are read and the last window of a series is all that is kept."""
    names = ["f__profile__poc", "f__profile__vah", "f__profile__val"]

    def update(first: np.ndarray, columns: list[np.ndarray], carry: list) -> list[np.ndarray]:
        before, seen = carry or ([np.empty(0)] * 3, 0)
        starts = np.unique(np.append(0, np.nonzero(first)[0]))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(first)]):
            if first[a]:
                before, seen = [np.empty(0)] * 3, 0
            rows = [np.append(x, c[a:b]) for x, c in zip(before, columns)]
            held = len(before[0])
            out.append(_profile(*rows, held, seen, step, window))
            keep = max(0, len(rows[0]) - (window - 1))
            before, seen = [x[keep:] for x in rows], seen + keep
        carry[:] = [before, seen]
        return [np.concatenate(x) for x in zip(*out)]

    out = Frame(scan_rows(f, ["low", "high", "volume"], update, names, halo=True).drop("_k"), f.keys, f.order, f.split)
    close, vah, val = F.col("close"), F.col("f__profile__vah"), F.col("f__profile__val")
    out = out.with_cols(
        f__profile__above_value=flag(close > vah), f__profile__below_value=flag(close < val),
        _out=F.when(vah.isNotNull(), (close > vah) | (close < val)),
    )
    # Re-entry: inside now, outside at the last bar that had a profile.
    out = out.running({"_was_out": ("last", F.col("_out"))}, inclusive=False)
    inside = flag((close >= val) & (close <= vah))
    return out.with_cols(f__profile__value_acceptance=inside & flag(F.col("_was_out"))).drop("_out", "_was_out")


def profile_pack(bars: DataFrame, step: float = 0.1, window: int = 100, max_rows: int | None = None) -> DataFrame:
    return add_profile(split_series(bars, lookback=window + MIN_BARS, max_rows=max_rows), step, window).finish()
