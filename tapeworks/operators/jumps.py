"""Array forms of state machines over one series: where a state is entered, left and entered again, without a loop over rows.

A machine that waits, holds and waits again is a map from the row it is entered at to the row it is entered at next.  Such maps are composed with
themselves (1, 2, 4, ... steps), so the rows actually entered from a start are found in about log2(entries) gathers.  Positions run from 0 to n, and
n stands for "never".
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def next_true(mask: np.ndarray) -> np.ndarray:
    """For every position, and n: the first position at or after it where the mask holds."""
    n = len(mask)
    at = np.append(np.where(mask, np.arange(n), n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def orbit(step: np.ndarray, start: int) -> np.ndarray:
    """Positions visited from ``start`` by ``step`` (positions 0..n; it only moves forward, n is left out)."""
    n = len(step) - 1
    seen = np.array([start] if start < n else [], np.int64)
    while len(seen):
        new = step[seen]
        inside = new[new < n]
        seen = np.concatenate((seen, inside))
        if len(inside) < len(new):
            break
        step = step[step]
    return seen


def last_of(step: np.ndarray) -> np.ndarray:
    """The last position below n that each position reaches by ``step``; n for n."""
    n = len(step) - 1
    at = np.where(step < n, step, np.arange(n + 1))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def first_offset(candidates: np.ndarray, n: int, most: int, hit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For every candidate position i the first i + j, j = 1..most, that ``hit(i, i + j)`` accepts, else n."""
    out = np.full(len(candidates), n)
    open_ = np.arange(len(candidates))
    for j in range(1, most + 1):
        open_ = open_[candidates[open_] + j < n]
        if not len(open_):
            break
        found = hit(candidates[open_], candidates[open_] + j)
        out[open_[found]] = candidates[open_[found]] + j
        open_ = open_[~found]
    return out


def window_tables(x: np.ndarray, longest: int, pick: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """table[k][i]: ``pick`` (np.fmax or np.fmin: NaN is no value) over x[i : i + 2^k], for powers up to ``longest``; shorter at the end."""
    tables = [np.append(x, np.nan)]
    while 2 ** len(tables) <= longest:
        t, half = tables[-1], 2 ** (len(tables) - 1)
        tables.append(pick(t, np.append(t[half:], np.full(min(half, len(t)), np.nan))))
    return tables


def first_crossing(x: np.ndarray, until: np.ndarray, crosses: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For every i the first position in (i, until[i]) whose value crosses i's own bounds, else ``until[i]``.

    ``crosses(i, high, low)`` says for rows i whether a stretch of values with this maximum and minimum holds a crossing.  Longer stretches without one
    are skipped first: about log2(longest window) steps for all rows at once.
    """
    n = len(x)
    rows = np.arange(n)
    at, until = rows + 1, np.maximum(until, rows + 1)
    longest = int((until - at).max()) if n else 0
    if longest < 1:
        return until
    highs, lows = (window_tables(x, longest, pick) for pick in (np.fmax, np.fmin))
    for k in reversed(range(len(highs))):
        i = rows[at + 2**k <= until]
        clear = ~crosses(i, highs[k][at[i]], lows[k][at[i]])
        at[i[clear]] += 2**k
    return at


class Holdings:
    """Holding from an entry row to the row its exit is due: ``enter`` marks rows a flat machine enters at, ``due`` the exit row of an entry at each row
    (n or later: none in sight)."""

    def __init__(self, enter: np.ndarray, due: np.ndarray):
        self.n = len(enter)
        self.due = np.append(np.minimum(due, self.n), self.n)
        self.next_entry = np.append(next_true(enter), self.n)  # one more: a row after the exit on the last row
        self.step = self.next_entry[np.append(self.due[:-1] + 1, self.n)]
        self.step[self.n] = self.n
        self._last: np.ndarray | None = None

    def entries(self, flat_from: int) -> np.ndarray:
        return orbit(self.step, int(self.next_entry[min(flat_from, self.n)]))

    def last_entry(self, flat_from: int) -> int:
        """The last entry of a machine that is flat from a row on, n without any."""
        if self._last is None:
            self._last = last_of(self.step)
        return int(self._last[self.next_entry[min(flat_from, self.n)]])

    def held(self, entries: np.ndarray) -> np.ndarray:
        """Rows held so far, the entry row included, 0 while flat and on exit rows."""
        out = np.zeros(self.n, np.int64)
        sizes = self.due[entries] - entries
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(entries, sizes) + within] = within + 1
        return out
