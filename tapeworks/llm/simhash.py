"""Near copies by SimHash: 64-bit fingerprints of word shingles, linked at ``DISTANCE`` or fewer differing bits.

A fingerprint is mapped to the bit counts of its 32 two-bit segments.  The Manhattan distance of two such vectors never exceeds the
number of differing bits, so it serves as a lower bound for a range join on a grid: the segments are cut into ``g`` axes, and when
the distance is 4 or less at least ``g - 4`` axes agree exactly.  Every choice of ``g - 4`` axes is one grid whose cells are the
counts on those axes; near fingerprints share a cell of at least one grid.  Inside a cell, members are ordered by their total
count (a coarser lower bound) and compared only within 4 of it, then by the full Manhattan distance, then bit by bit.  ``g`` depends on the
number of fingerprints and changes only the cost, never the links.

Copies with equal fingerprints are one node, and a cell yields a spanning forest of its links (one row less than members at most),
so a group of k copies makes O(k) rows, not all pairs.  A cell of more than ``CELL`` members is cut into blocks, and each pair of blocks is
a group of its own that any task can take.

Null and empty texts have fingerprint zero and are linked like any other.  A null doc_id never is a component's id unless the
component has no other; ties and repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, fresh, map_arrow, pick, settle
from .components import connected_stars

DISTANCE = 4
SHINGLE = 4
SEED = 42
SEARCH_DISTANCE = 8
SHORT_WORD = 3
SIMILAR_WIDTH, SIMILARITY = 5, 0.8
CELL = 8192
GROUP_HASHES = 8_000_000
BROADCAST_ROWS = 500_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EVEN = 0x5555555555555555


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` words (the whole sequence when shorter), repeats included."""
    return _hashes(text.encode().translate(LOWER).split() if text else [], width)


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the shingles of ``width`` words; of width 0: of the distinct words longer than ``SHORT_WORD`` bytes, or of all if none is."""
    if not words:
        return np.empty(0, np.uint64)
    if not width:
        distinct = set(words)
        return np.array([xxhash.xxh64_intdigest(w, SEED) for w in distinct if len(w) > SHORT_WORD] or [xxhash.xxh64_intdigest(w, SEED) for w in distinct], np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set when more than half of the shingle hashes have it."""
    return _majority(shingle_hashes(text, width))


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, **widths: int) -> DataFrame:
    """doc_id, text_hash and a fingerprint column (signed long) for each name given with its shingle width."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        words = [t.encode().translate(LOWER).split() if t else [] for t in batch.column("text").to_pylist()]
        fps = [pa.array([_majority(_hashes(w, width)) for w in words], pa.int64()) for width in widths.values()]
        return pa.table([batch.column("doc_id"), batch.column("text_hash"), *fps], names=["doc_id", "text_hash", *widths])

    rows = pick(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    return map_arrow(rows, run, ", ".join(["doc_id long", "text_hash long", *(f"{c} long" for c in widths)]))


def axes_for(nodes: int, distance: int = DISTANCE, agreeing: int = 1) -> int:
    """The number of axes with the least expected cost, at least ``agreeing`` of which agree: rows to move against pairs to compare (two-bit
    counts agree with odds 3/8)."""
    def cost(g: int) -> float:
        grids = math.comb(g, distance)
        return grids * nodes * 3e-6 + grids * nodes * nodes / 2 * (3 / 8) ** (32 * (g - distance) / g) * 1e-8

    return min(range(distance + agreeing, distance + 7), key=cost)


def grid_masks(axes: int, distance: int = DISTANCE) -> list[int]:
    """One mask of segment counts per choice of ``axes - distance`` axes."""
    cuts = [round(i * 32 / axes) for i in range(axes + 1)]
    one = [sum(3 << (2 * s) for s in range(a, b)) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(one, axes - distance)]


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, packed where the segments lie."""
    even = np.uint64(EVEN)
    return (fp & even) + ((fp >> np.uint64(1)) & even)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def cell_links(fp: np.ndarray, other: np.ndarray, distance: int = DISTANCE, other_distance: int = 64, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the members of one cell, as positions (member, root).

    Linked are members whose fingerprints differ in ``distance`` bits and whose other fingerprints differ in ``other_distance`` bits at most.
    """
    k = len(fp)
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    label = np.arange(k)
    for a, b, _ in _near(fp[order], other[order], distance, other_distance, rows):
        at, first = np.unique(a, return_index=True)
        for r, s, e in zip(at.tolist(), first.tolist(), [*first[1:].tolist(), len(a)]):
            roots = np.unique(label[b[s:e]])
            if len(roots) > 1 or roots[0] != label[r]:
                roots = np.union1d(roots, label[r : r + 1])
                label[np.isin(label, roots)] = roots[0]
    linked = np.nonzero(label != np.arange(k))[0]
    return order[linked], order[label[linked]]


def cell_partners(fp: np.ndarray, other: np.ndarray, masks: list[int], distance: int, other_distance: int, rows: int = 256) -> np.ndarray:
    """Positions of the members of a cell that ``_near`` links with another one that shares no cell of the grids in ``masks``: of a pair's common
    cells only the first counts."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, other = fp[order], other[order]
    counts, found = segment_counts(fp), np.zeros(len(fp), bool)
    for a, b, _ in _near(fp, other, distance, other_distance, rows):
        apart = counts[a] ^ counts[b]
        for m in masks:
            first = (apart & np.uint64(m)) != 0
            a, b, apart = a[first], b[first], apart[first]
        found[a] = found[b] = True
    return order[found]


def set_links(hashes: np.ndarray, sizes: np.ndarray, near, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions) of the pairs of sets with a Jaccard similarity of ``similarity`` or more, among the pairs that ``near(i)`` (a mask
    over the positions behind i) names.  ``hashes`` holds the sets one after the other; two empty sets are equal."""
    k = len(sizes)
    _, code, held = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = held[code] > 1  # no other member has the rest
    code, owner = code[shared], np.repeat(np.arange(k), sizes)[shared]
    starts = np.searchsorted(owner, np.arange(k + 1))
    mark, label = np.zeros(len(held), bool), np.arange(k)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i in range(k - 1):
        later = np.arange(i + 1, k)
        low, high = np.minimum(sizes[i], sizes[later]), np.maximum(sizes[i], sizes[later])
        later = later[near(i) & (label[later] != label[i]) & ((high == 0) | (low / np.maximum(high, 1) >= similarity))]
        if not len(later):
            continue
        own = code[starts[i] : starts[i + 1]]
        mark[own] = True
        n = starts[later + 1] - starts[later]
        at = np.repeat(starts[later] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.concatenate(([0], np.cumsum(mark[code[at]])))[np.concatenate(([0], np.cumsum(n)))]
        mark[own] = False
        common = np.diff(common)
        union = sizes[i] + sizes[later] - common
        later = later[(union == 0) | (common / np.maximum(union, 1) >= similarity)]
        if len(later):
            roots, first = np.unique(label[later], return_index=True)
            found.append((np.full(len(first), i), later[first]))
            label[np.isin(label, roots)] = label[i]
    return tuple(np.concatenate(x) for x in zip(*found))


def _near(fp: np.ndarray, other: np.ndarray, distance: int, other_distance: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Linked positions (a < b, ordered by a) of members ordered by total count and the bits in which their others differ, block by block."""
    k = len(fp)
    total = np.bitwise_count(fp).astype(np.int64)
    counts, even, one = segment_counts(fp), np.uint64(EVEN), np.uint64(1)
    until = np.searchsorted(total, total + distance, side="right")  # a larger difference in bit totals is a larger distance
    for i in range(0, k, rows):
        j = min(i + rows, k)
        stop = until[j - 1]
        d = counts[i:j, None] ^ counts[None, i:stop]
        low, high = d & even, (d >> one) & even
        near = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low) <= distance  # Manhattan distance of the counts
        a, b = np.nonzero(near)
        keep = a < b
        a, b = a[keep] + i, b[keep] + i
        apart = np.bitwise_count(other[a] ^ other[b])
        apart = apart.sum(axis=1) if apart.ndim > 1 else apart
        exact = (np.bitwise_count(fp[a] ^ fp[b]) <= distance) & (apart <= other_distance)
        yield a[exact], b[exact], apart[exact]


def _cell_worker(find):
    """Batches sorted by (cell, block) to links found by ``find`` (fp and other of a cell to positions): runs of equal keys are cells; the last one
    waits for the next batch."""

    def links(cell, block, node, *columns, last: bool):
        change = np.nonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]))[0] + 1
        starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(cell)]))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        big = ends - starts > 1
        out = []
        for s, e in zip(starts[big].tolist(), ends[big].tolist()):
            a, b = find(*(c[s:e] for c in columns))
            if len(a):
                out.append((node[s:e][a], node[s:e][b]))
        return out, change[-1] if len(change) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(last: bool):
            cols = [np.concatenate(x) for x in zip(*held)]
            found, tail = links(*cols, last=last)
            held[:] = [] if last else [tuple(c[tail:] for c in cols)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "node", "fp", "other")]
                same = held and held[0][0][0] == cols[0][-1] and held[0][1][0] == cols[1][-1]
                held.append((*cols[:3], cols[3].view(np.uint64), cols[4].view(np.uint64)))
                if not same:
                    yield from emit(last=False)
        if held:
            yield from emit(last=True)

    return run


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE, other_distance: int = 64, cell: int = CELL, agreeing: int = 1) -> DataFrame:
    """Links (a, b) that connect exactly the nodes (columns node, fp, other; one row each) that ``cell_links`` links."""
    masks = grid_masks(axes_for(nodes.count(), distance, agreeing), distance)
    grouped = _in_cells(nodes, masks, cell, ())
    return grouped.select("cell", "block", "node", "fp", "other").mapInArrow(_cell_worker(lambda fp, other: cell_links(fp, other, distance, other_distance)), "a long, b long")


def _in_cells(nodes: DataFrame, masks: list[int], cell: int, more: tuple[str, ...]) -> DataFrame:
    """One row a node and cell (grid, cell, block, and the node's columns), cells too large cut into pairs of blocks, each cell in one sorted stretch."""
    fp = F.col("fp")
    next_bit = F.shiftrightunsigned(fp, 1)
    ones, twos = fp.bitwiseXOR(next_bit).bitwiseAND(F.lit(EVEN)), fp.bitwiseAND(next_bit).bitwiseAND(F.lit(EVEN))
    counts = ones.bitwiseOR(F.shiftleft(twos, 1))
    cells = F.array(*(F.xxhash64(F.lit(i), counts.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))
    rows = nodes.select("node", "fp", "other", *more, F.posexplode(cells).alias("grid", "cell"))
    large = settle(_split_counts(rows.groupBy("cell").agg(F.count("*").alias("k")), cell, "cell"))
    placed = _in_blocks(rows, large, "cell")
    return placed.repartition("cell", "block").sortWithinPartitions("cell", "block")


def _split_counts(groups: DataFrame, limit: int, *keys: str) -> DataFrame:
    """Groups (``keys`` and their weight k) beyond the limit, with the number n of blocks to cut them into: two blocks meet in a task."""
    return groups.filter(F.col("k") > limit).select(*keys, F.ceil(F.col("k") * 2 / limit).cast("int").alias("n"))


def _in_blocks(rows: DataFrame, large: DataFrame, *keys: str) -> DataFrame:
    """rows with a block: 0, or in large groups one row for every pair of blocks (i <= j, as i * n + j) that holds the node's own."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j) * F.col("n") + F.greatest(own, j))
    block = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)
    joined = rows.join(broadcast_bounded(large, BROADCAST_ROWS), list(keys), "left")
    return joined.select(*rows.columns, F.explode(block).alias("block"))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...], listed: str | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of every run of equal keys with two rows or more, of batches sorted by the keys; of a list column its sizes and its values in sequence."""
    held: list[tuple[np.ndarray, ...]] = []

    def runs(last: bool) -> Iterator[tuple[np.ndarray, ...]]:
        cols = [np.concatenate(x) for x in zip(*held)]
        n = len(cols[0])
        new = np.zeros(n - 1, bool)
        for c in cols[: len(keys)]:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.nonzero(new)[0] + 1).tolist(), n]
        until = len(cuts) - 1 if last else len(cuts) - 2
        offsets = np.concatenate(([0], np.cumsum(cols[len(keys) + len(columns)]))) if listed else None
        for s, e in zip(cuts[:until], cuts[1 : until + 1]):
            if e - s > 1:
                out = [c[s:e] for c in cols[len(keys) : len(keys) + len(columns)]]
                yield (*out, cols[-2][s:e], cols[-1][offsets[s] : offsets[e]]) if listed else tuple(out)
        tail = cuts[until]
        held[:] = [] if last else [(*(c[tail:] for c in cols[: len(keys) + len(columns) + bool(listed)]), *((cols[-1][offsets[tail] :],) if listed else ()))]

    for batch in batches:
        if batch.num_rows:
            more = ()
            if listed:
                values = batch.column(listed)
                more = (np.diff(values.offsets.to_numpy()), values.flatten().to_numpy(zero_copy_only=False))
            cols = (*(batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, *columns)), *more)
            same = held and all(held[-1][i][-1] == cols[i][-1] for i in range(len(keys)))
            held.append(cols)
            if not same:
                yield from runs(last=False)
    if held:
        yield from runs(last=True)


def _batches(found: Iterator[tuple[np.ndarray, ...]], names: list[str], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small results put together."""
    held, n = [], 0
    for columns in found:
        held.append(columns)
        n += len(columns[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def proposed_groups(nodes: DataFrame, distance: int, other_distance: int, cell: int = CELL) -> DataFrame:
    """(cell, block, node): for every pair of nodes (columns node, fp, other, far) within both distances the first cell that holds both, with all such nodes.

    Pairs stay in the task that compares them, so a cell gives one row a member at most.
    """
    masks = grid_masks(axes_for(nodes.count(), distance, 2), distance)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for key, block, grid, node, fp, other, far in _groups(batches, ("cell", "block"), ("cell", "block", "grid", "node", "fp", "other", "far")):
            prints = np.stack((other.view(np.uint64), far.view(np.uint64)), axis=1)
            at = cell_partners(fp.view(np.uint64), prints, masks[: int(grid[0])], distance, other_distance)
            if len(at):
                yield key[at], block[at], node[at]

    names = ["cell", "block", "node"]
    rows = _in_cells(nodes, masks, cell, ("far",)).select("cell", "block", "grid", "node", "fp", "other", "far")
    return rows.mapInArrow(lambda batches: _batches(found(batches), names), "cell long, block int, node long")


def _nodes(prints: DataFrame) -> DataFrame:
    return settle(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("other").alias("other"), F.min("doc_id").alias("first_id")))


def _classes(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``prints`` (doc_id, text_hash, node, fp, other) with component_id and the component's root node."""
    rooted = _rooted(nodes, links, "root").select("node", "first_id", "root")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("node", "component_id", "root")
    return prints.join(classes, "node").select("doc_id", "text_hash", "fp", "component_id", "root")


def _rooted(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """nodes with the root of their component, their own where nothing links them."""
    stars = connected_stars(links).select(F.col("node").alias("member"), F.col("root").alias("found"))
    return nodes.join(stars, F.col("node") == F.col("member"), "left").withColumn(name, F.coalesce("found", "node")).drop("member", "found")


def near_copies(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest doc_id reachable over links, its own included) and root for every row."""
    prints = settle(fingerprints(docs, fp=width)).select("doc_id", "text_hash", F.col("fp").alias("node"), "fp", F.col("fp").alias("other"))
    nodes = _nodes(prints)
    return _classes(prints, nodes, fingerprint_links(nodes, distance))


def _far(h: np.ndarray) -> int:
    """A second fingerprint of the same hashes, independent of the first."""
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return _majority(mixed ^ (mixed >> np.uint64(32)))


def _search_prints(words: list[bytes], width: int) -> tuple[int, int, int, np.ndarray]:
    """Fingerprint of the distinct words, two fingerprints of the shingles, and the shingles' hashes."""
    h = _hashes(words, width)
    return _majority(_hashes(words, 0)), _majority(h), _far(h), h


def search_prints(docs: DataFrame, width: int = SIMILAR_WIDTH) -> DataFrame:
    """doc_id, text_hash, fp, other and far of every row."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        prints = [_search_prints(t.encode().translate(LOWER).split() if t else [], width)[:3] for t in batch.column("text").to_pylist()]
        fps = [pa.array(c, pa.int64()) for c in (zip(*prints) if prints else [[]] * 3)]
        return pa.table([batch.column("doc_id"), batch.column("text_hash"), *fps], names=["doc_id", "text_hash", "fp", "other", "far"])

    rows = pick(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    return map_arrow(rows, run, "doc_id long, text_hash long, fp long, other long, far long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, fp, other, far and shingles (their distinct hashes) of every text whose hash is a node of ``wanted``."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        prints = [_search_prints(t.encode().translate(LOWER).split() if t else [], width) for t in batch.column("text").to_pylist()]
        fps = [pa.array(c, pa.int64()) for c in (list(zip(*prints))[:3] if prints else [[]] * 3)]
        sets = pa.array([np.unique(p[3]).view(np.int64) for p in prints], pa.list_(pa.int64()))
        return pa.table([batch.column("node"), *fps, sets], names=["node", "fp", "other", "far", "shingles"])

    rows = pick(docs, text="string").withColumn("node", F.xxhash64("text"))
    texts = rows.join(broadcast_bounded(wanted, BROADCAST_ROWS), "node", "left_semi").dropDuplicates(["node"])
    return map_arrow(texts.select("node", "text"), run, "node long, fp long, other long, far long, shingles array<long>")


def verified_links(docs: DataFrame, groups: DataFrame, distance: int, other_distance: int, width: int, similarity: float, hashes: int = GROUP_HASHES) -> DataFrame:
    """Links (a, b; text hashes) that connect exactly the texts of a group (cell, block, node) that lie within both distances and whose sets of
    shingles have a Jaccard similarity of ``similarity`` or more: a spanning forest of each group, compared in groups of ``hashes`` shingles."""
    keys = ("cell", "part")
    sets = settle(shingle_sets(docs, settle(groups.select("node").distinct()), width))
    rows = groups.withColumnRenamed("block", "part")
    weights = rows.join(sets.select("node", F.size("shingles").alias("m")), "node").groupBy(*keys).agg(F.sum("m").alias("k"))
    placed = _in_blocks(rows, settle(_split_counts(weights, hashes, *keys)), *keys).join(sets, "node")
    grouped = placed.repartition(*keys, "block").sortWithinPartitions(*keys, "block")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        columns = ("node", "fp", "other", "far")
        for node, fp, other, far, sizes, values in _groups(batches, (*keys, "block"), columns, "shingles"):
            fp, prints = fp.view(np.uint64), np.stack((other.view(np.uint64), far.view(np.uint64)), axis=1)

            def near(i: int, fp=fp, prints=prints) -> np.ndarray:
                return (np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= distance) & (np.bitwise_count(prints[i] ^ prints[i + 1 :]).sum(axis=1) <= other_distance)

            a, b = set_links(values, sizes, near, similarity)
            if len(a):
                yield node[a], node[b]

    rows = grouped.select(*keys, "block", "node", "fp", "other", "far", "shingles")
    return rows.mapInArrow(lambda batches: _batches(found(batches), ["a", "b"]), "a long, b long")


def similar_texts(docs: DataFrame, distance: int = SEARCH_DISTANCE, width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The same columns for texts whose sets of shingles of ``width`` words have a Jaccard similarity of ``similarity`` or more.

    One changed word changes five five-word shingles, so fingerprints of such shingles lie 7 to 14 bits apart at a similarity of 0.8: too far for a
    selective grid.  The search therefore runs on fingerprints of the distinct words, within ``distance`` bits, and only proposes pairs; two fingerprints of
    shingles that lie further apart than three standard deviations allow are left out.  Fingerprints of word sets crowd the cells of a single axis, so
    two axes agree at least.  A pair is proposed in the first cell that holds both, and no pair is ever a row: the cell's task names the texts that have a
    partner there, their sets are brought to the cell, and the proposed pairs are verified on the sets.  Only a spanning forest leaves the task, so
    k texts of a cell give k rows at most, refused or not, and the result is the components of all verified proposals.
    """
    bits, odds = 128, math.acos(2 * similarity / (1 + similarity)) / math.pi
    other = math.ceil(bits * odds + 3 * math.sqrt(bits * odds * (1 - odds)))
    prints = settle(search_prints(docs, width)).withColumn("node", F.col("text_hash"))
    nodes = settle(prints.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "other", "far")), F.min("doc_id").alias("first_id")))
    groups = settle(proposed_groups(nodes, distance, other))
    return _classes(prints, nodes, settle(verified_links(docs, groups, distance, other, width, similarity)))


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each group in ``found`` (near_copies or similar_texts): that with the smallest doc_id (nulls last, then by text hash); a
    repeated row stays once."""
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("first_id"), F.col("k.text_hash").alias("first_text"))
    th = fresh(docs, "text_hash")
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(first, rows["doc_id"].cast("long").eqNullSafe(first["first_id"]) & (rows[th] == first["first_text"]), "left_semi")
    return kept.dropDuplicates(["doc_id", th]).drop(th)
