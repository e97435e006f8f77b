from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from corpus_cases import CLASHING, awkward, docs_of, prose

from tapeworks.llm import components, simhash


def direct_fingerprint(text: str | None, width: int) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n: int, linked) -> list[int]:
    """Smallest member of each member's group."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if linked(i, j) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def variants() -> list[tuple]:
    rows = [(i, prose(90, i), "en", "s", 0) for i in range(20)]
    rows += [(50 + i, prose(90, 4).replace(" ", "  ").upper(), "en", "s", 0) for i in range(4)]
    rows += [(70 + i, prose(400, 9) + f" tail{i}", "en", "s", 0) for i in range(30)]
    return rows


def test_fingerprints(spark):
    rows = awkward()
    got = simhash.fingerprints(docs_of(spark, rows), four=4, one=1).collect()
    want = {t: (direct_fingerprint(t, 4), direct_fingerprint(t, 1)) for _, t, *_ in rows if t is None or len(t) < 5000}
    assert len(got) == len(rows)
    by_id = {(r["doc_id"], r["four"] % 2**64, r["one"] % 2**64) for r in got}
    assert all((i, *want[t]) in by_id for i, t, *_ in rows if t in want)


def test_components_equal_all_pairs(spark):
    rows = variants() + awkward()
    got = simhash.near_copies(docs_of(spark, rows)).select("doc_id", "text_hash", "fp", "component_id").collect()
    fps = [r["fp"] % 2**64 for r in got]
    label = groups(len(got), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for k in set(label):
        members = [r for r, x in zip(got, label) if x == k]
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        assert {r["component_id"] for r in members} == {min(ids) if ids else None}


def test_grid_finds_every_link_at_every_distance(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    points = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(62, rng.integers(1, 9), replace=False):
                x ^= 1 << int(bit)
            points.add(x)
    points = sorted(points)
    for distance, cell in ((4, 8192), (4, 10), (7, 8192)):
        nodes = spark.createDataFrame([(p, p, p) for p in points], "node long, fp long, other long")
        stars = {r["node"]: r["root"] for r in components.connected_stars(simhash.fingerprint_links(nodes, distance, cell=cell)).collect()}
        label = groups(len(points), lambda i, j: (points[i] ^ points[j]).bit_count() <= distance)
        assert [stars.get(p, p) for p in points] == [points[x] for x in label]


def test_lower_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 4000, dtype=np.int64).view(np.uint64) for _ in range(2))
    x, y = simhash.segment_counts(a), simhash.segment_counts(b)
    manhattan = sum(np.abs((x >> np.uint64(2 * i) & np.uint64(3)).astype(int) - (y >> np.uint64(2 * i) & np.uint64(3)).astype(int)) for i in range(32))
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_one_of_each_group_stays(spark):
    rows = variants() + awkward() + [(900, prose(400, 9).replace("stone", "wooden", 1), "en", "s", 0)]
    docs = docs_of(spark, rows)
    found = simhash.similar_texts(docs)
    kept = simhash.drop_near_copies(docs, found)
    got = kept.collect()
    assert kept.columns == docs.columns and all(r[c] == f"own {c}" for r in got for c in CLASHING)
    ids = [r["doc_id"] for r in got]
    assert len(set(ids) & set(range(70, 100))) == 1 and 900 not in ids and set(range(20)) <= set(ids) and not set(ids) & {50, 51, 52, 53}
    assert sum(r["text"] == prose(63, 3) for r in got) == 1 and 105 not in ids
    assert simhash.drop_near_copies(docs_of(spark, []), simhash.similar_texts(docs_of(spark, []))).collect() == []


def test_similar_texts_are_linked_on_their_shingles(spark):
    base = " ".join(prose(400, 31).split())
    texts = [base]
    for seed in range(60):
        w = base.split()
        for k in range(2 + seed % 15):
            w[(seed * 37 + k * 23) % 400] = f"new{seed % 7}x{k}"
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert any(0.6 < jaccard(i, j) < 0.8 for i in range(60) for j in range(i)), "pairs that only the fingerprints take for copies"
    fps = [simhash._search_prints(t.encode().translate(simhash.LOWER).split(), 5)[:3] for t in texts]
    bits = lambda i, j, c: ((fps[i][c] ^ fps[j][c]) % 2**64).bit_count()
    near = lambda i, j: bits(i, j, 0) <= 8 and bits(i, j, 1) + bits(i, j, 2) <= 32
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs_of(spark, rows)).collect()}
    want = groups(len(texts), lambda i, j: near(i, j) and jaccard(i, j) >= 0.8)
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < len(texts)


def refused_variants(k):
    """k texts of 400 words with the same 14 places filled by words of their own: near in words, at 0.7 with each other."""
    base = [f"{w}{i % 90}" for i, w in enumerate(" ".join(prose(400, 31).split()).split())]
    return [" ".join(f"own{i}n{n}" if n % 28 == 5 else w for n, w in enumerate(base)) for i in range(k)]


def test_refused_variants_make_no_pairs(spark):
    rows, classes = {}, {}
    for k in (100, 200, 400):
        docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(refused_variants(k))])
        nodes = simhash.search_prints(docs).withColumnRenamed("text_hash", "node")
        rows[k] = simhash.proposed_groups(nodes, 8, 32).count()
        classes[k] = simhash.similar_texts(docs).select("root").distinct().count()
    assert classes == {k: k for k in classes}
    assert all(k / 4 < n <= 45 * k for k, n in rows.items()) and rows[400] <= 2.6 * rows[200]


@pytest.mark.parametrize("hashes", [200, 8_000_000])
def test_links_of_sets_equal_all_pairs(spark, hashes):
    rng = np.random.default_rng(3)
    texts = [""] + [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(8)]
    for t in texts[1:5]:
        w = t.split()
        texts += [" ".join(w[: i * 3] + [f"n{i}"] + w[i * 3 + 1 :]) for i in range(1, 12)]
    docs = docs_of(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    nodes = simhash.search_prints(docs).withColumnRenamed("text_hash", "node").collect()
    groups_ = spark.createDataFrame([(1, 0, r["node"]) for r in nodes], "cell long, block int, node long")
    links = simhash.verified_links(docs, groups_, 64, 128, 5, 0.8, hashes=hashes).collect()
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    of = {r["node"]: r["doc_id"] for r in nodes}
    label = groups(len(texts), lambda i, j: not sets[i] and not sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    edges = {(of[r["a"]], of[r["b"]]) for r in links}
    joined = groups(len(texts), lambda i, j: (i, j) in edges or (j, i) in edges)
    assert joined == label and len(set(label)) < len(texts)


def test_links_of_a_dense_cell_are_a_forest():
    fp = np.arange(2000, dtype=np.uint64)
    a, b = simhash.cell_links(fp, fp)
    assert len(a) == 1999 and len(set(a.tolist())) == 1999


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(120)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, None), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_stars(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 121)}, **{1000 + i: 1000 for i in range(1, 300)}}
