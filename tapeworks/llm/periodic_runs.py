"""Runs of a repeated phrase: maximal stretches of consecutive words with a period, found with a suffix automaton and link-cut access.

Words are appended one by one to a suffix automaton whose suffix links form the link-cut tree.  Every state carries the last position where its
strings end.  The states that end at the new word are the path from the new state to the root, and link-cut access walks that path in segments of
one colour: the states whose strings ended last at position ``e``.  With ``length`` the longest string of a segment, the words up to ``e`` and those up to the
new position ``i`` agree on exactly ``length`` words, so the ``length + d`` words up to ``i`` have period ``d = i - e``; from ``length >= d`` on they hold a square.
Then the path gets colour ``i``.  A suffix of a period or more lies last exactly one period back, so every word of a run from its second period on
yields (start, d) of the run, only smallest periods occur, and the last word that does so is the run's end.  Access costs O(log n) amortised segments.

Reported are runs of at least ``MIN_WORDS`` words and ``MIN_POWER`` periods.  The automaton needs to see only ``live_stretches``: in such a run every window
of three words occurs again in the run, so a run lies inside a stretch of windows that occur twice or more in the stretch, and a word that would extend it
would lie in the stretch too.  That is exact, whatever the text, and leaves almost nothing of ordinary prose.

Null and empty texts have no words and no runs; a null doc_id is like any other; repeated rows get equal results; texts of any length are taken whole (one
text is one task's work); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, pick

MIN_WORDS, MIN_POWER = 6, 4
WINDOW = 3


class SuffixLinks:
    """Suffix automaton of a growing sequence; its suffix-link tree is kept as splay trees, one for each path of one colour.

    Lists are indexed by state; 0 stands for no state and 1 is the empty string's.  ``colour`` is valid at the roots of the splay trees.
    """

    def __init__(self) -> None:
        self.after: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        self.left, self.right, self.above, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.size = 1, 0

    def _state(self, after: dict[int, int], length: int, link: int, above: int, colour: int) -> int:
        for column, value in ((self.after, after), (self.length, length), (self.link, link), (self.left, 0), (self.right, 0), (self.above, above), (self.colour, colour)):
            column.append(value)
        return len(self.link) - 1

    def _splay(self, x: int) -> None:
        """Make x the root of its splay tree."""
        left, right, above, colour = self.left, self.right, self.above, self.colour

        def up(x: int) -> None:
            y = above[x]
            z = above[y]
            if left[z] == y and z:
                left[z] = x
            elif right[z] == y and z:
                right[z] = x
            else:
                colour[x] = colour[y]
            if left[y] == x:
                b = left[y] = right[x]
                right[x] = y
            else:
                b = right[y] = left[x]
                left[x] = y
            if b:
                above[b] = y
            above[y], above[x] = x, z

        while True:
            y = above[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = above[y]
            if z and (left[z] == y or right[z] == y):
                up(y if (left[z] == y) == (left[y] == x) else x)
            up(x)

    def _recolour(self, state: int, end: int) -> list[tuple[int, int]]:
        """Colour the path from ``state`` to the root with ``end``; (old colour, longest string) of its segments."""
        left, right, above, colour, length = self.left, self.right, self.above, self.colour, self.length
        segments, below, x = [], 0, state
        while x:
            self._splay(x)
            if x != state:
                segments.append((colour[x], length[x]))
            if right[x]:
                colour[right[x]] = colour[x]  # the deeper part keeps its colour
            right[x] = below
            if below:
                above[below] = x
            below, x = x, above[x]
        colour[below] = end
        self._splay(state)
        return segments

    def append(self, word: int) -> list[tuple[int, int]]:
        """Append a word; (e, length) for the earlier ends e whose words agree with the new end's on ``length`` words, longest first."""
        after, link, length = self.after, self.link, self.length
        at, state = self.size, self.last
        new = self._state({}, at + 1, 0, 0, at)
        while state and word not in after[state]:
            after[state][word] = new
            state = link[state]
        if not state:
            parent = 1
        else:
            parent = after[state][word]
            if length[state] + 1 != length[parent]:
                parent = self._split(parent, length[state] + 1, word, state)
        link[new] = self.above[new] = parent
        self.last, self.size = new, at + 1
        return [s for s in self._recolour(new, at) if s[1]]

    def _split(self, state: int, size: int, word: int, source: int) -> int:
        """The strings of ``state`` of up to ``size`` words become a state of their own, just above it on its path."""
        after = self.after
        self._splay(state)
        clone = self._state(dict(after[state]), size, self.link[state], state, -1)
        shallower = self.left[clone] = self.left[state]
        if shallower:
            self.above[shallower] = clone
        self.left[state] = clone
        self.link[state] = clone
        while source and after[source].get(word) == state:
            after[source][word] = clone
            source = self.link[source]
        return clone


def _runs_of(words: list[int], offset: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch that begins at word ``offset``."""
    tree, open_runs = SuffixLinks(), {}
    for end, word in enumerate(words):
        for e, agreed in tree.append(word):
            period = end - e
            if agreed >= (MIN_POWER - 1) * period and agreed + period >= MIN_WORDS:
                open_runs[end - agreed - period + 1, period] = end
    for (start, period), end in open_runs.items():
        yield offset + start, end - start + 1, period


def _windows(words: np.ndarray) -> np.ndarray:
    """A number for every window of three words, equal for equal windows."""
    n = int(words.max()) + 1
    if n < 1 << 21:
        return (words[:-2] * n + words[1:-1]) * n + words[2:]
    pairs = np.unique(words[:-1] * n + words[1:], return_inverse=True)[1]
    return pairs[:-1] * n + words[2:]


def live_stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges [a, b) of words all of whose windows of three occur twice or more in the same range."""
    if len(words) < MIN_WORDS:
        return []
    windows = _windows(words)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    ids = np.empty(len(windows), np.int64)
    ids[order] = np.cumsum(new) - 1
    part = np.zeros(len(windows), np.int64)  # which stretch a window is in; -1: in none
    while True:
        inside = np.nonzero(part >= 0)[0]
        key = part[inside] * len(windows) + ids[inside]
        _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
        live = np.zeros(len(windows), bool)
        live[inside] = counts[at] > 1
        edges = np.diff(np.concatenate(([0], live.view(np.int8), [0])))
        # neighbouring windows of different stretches are never both inside: a window between them is in none
        starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        wide = ends - starts >= MIN_WORDS - WINDOW + 1
        starts, ends = starts[wide], ends[wide]
        if not len(starts):
            return []
        kept = int((ends - starts).sum())
        if kept == len(inside):
            return [(a, b + WINDOW - 1) for a, b in zip(starts.tolist(), ends.tolist())]
        part = np.full(len(windows), -1, np.int64)
        part[np.repeat(starts, ends - starts) + np.arange(kept) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)] = np.repeat(np.arange(len(starts)), ends - starts)


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of a sequence of hashable words, by start and period."""
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return sorted(r for a, b in live_stretches(ids) for r in _runs_of(ids[a:b].tolist(), a))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()]


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def with_planted_period(doc_id: int | None, words: list) -> list:
    """For a tenth of the documents (by the CRC32 of the doc_id) the words with a repeated phrase for their tail: the whole table's test of the search."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    phrase = words[a : a + p]
    return words[:a] + (phrase * -(-(n - a) // p))[: n - a]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_COLLAPSED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                      ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64())])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and text: the words that no run repeats, joined by one blank."""

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = split_words(text)
        runs = find_runs(words)
        return doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs)).decode()

    return _per_text(docs, row, _COLLAPSED, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def run_digests(docs: DataFrame, change: Callable[[int | None, list], list] = lambda doc_id, words: words) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text, of the changed words."""

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = change(doc_id, split_words(text))
        runs = find_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        longest = (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None)
        lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(), len(words))

    return _per_text(docs, row, _DIGESTS, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
                                          "collapsed_sha256 string, n_words long")


def _per_text(docs: DataFrame, row: Callable[[int | None, str | None], tuple], schema: pa.Schema, spark_schema: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.Table:
        found = [row(d, t.as_py()) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"))]
        columns = list(zip(*found)) if found else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_arrow(pick(docs, doc_id="long", text="string"), run, spark_schema)
