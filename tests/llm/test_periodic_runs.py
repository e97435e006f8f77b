from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from corpus_cases import awkward, docs_of, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import periodic_runs as p


def brute(seq, least=6, power=4):
    """Runs by comparing the sequence with itself at every distance."""
    n, found = len(seq), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, power * q) and not any(q % r == 0 and (i, length) == found.get((i, r)) for r in range(1, q)):
                found[i, q] = (i, length)
            i = j + 1
    # the smallest period of each stretch
    best = {}
    for (i, q), (_, length) in found.items():
        best[i, length] = min(q, best.get((i, length), q))
    return sorted((i, length, q) for (i, length), q in best.items())


def smallest_period(seq):
    return next(q for q in range(1, len(seq) + 1) if all(a == b for a, b in zip(seq, seq[q:])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_small_alphabets(seq):
    runs = p.find_runs(seq)
    assert runs == brute(seq)
    assert all(smallest_period(seq[s : s + n]) == q for s, n, q in runs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.integers(1, 9)), max_size=8))
def test_repeated_phrases(parts):
    seq = [w for phrase, times in parts for w in phrase * times]
    assert p.find_runs(seq) == brute(seq)


def test_every_earlier_end_and_its_agreement():
    rng = random.Random(7)
    for _ in range(60):
        seq = [rng.randrange(3) for _ in range(60)]
        tree = p.SuffixLinks()
        for i, w in enumerate(seq):
            agreed = [next((k for k in range(e + 1) if seq[e - k] != seq[i - k]), e + 1) for e in range(i)]
            want, best = [], 0
            for e in reversed(range(i)):
                if agreed[e] > best:
                    best = agreed[e]
                    want.append((e, best))
            assert tree.append(w) == want[::-1]


def test_long_sequences():
    base = [f"w{i * i % 997}" for i in range(2000)]
    seq = base + ["a"] * 500 + ["x", "y", "z"] * 400 + base[:700] * 5 + ["end"]
    runs = p.find_runs(seq)
    assert (2000, 500, 1) in runs and (2500, 1200, 3) in runs and (3700, 3500, 700) in runs
    fib = ["a", "b"]
    while len(fib) < 16:
        fib.append(fib[-1] + fib[-2])
    word = list(fib[-1])[:1200]
    assert p.find_runs(word * 2) == brute(word * 2)


def direct(doc_id, text):
    seq = words(text)
    if doc_id is not None and seq:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(seq)
        if h % 10 == 0:
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            seq = [seq[i] if i < a else seq[a + (i - a) % q] for i in range(n)]
    runs = brute(seq) if len(seq) < 3000 else p.find_runs(seq)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(seq) if i not in gone)))


def test_query_columns_against_direct_search(spark):
    rows = awkward() + [(1000 + i, " ".join(["ab", "cd", "é"][: 1 + i % 3] * (2 + i % 7)) + " tail" * (i % 9), "en", "s", 1) for i in range(300)]
    got = p.run_digests(docs_of(spark, rows), p.with_planted_period).drop("n_words").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(direct(r[0], r[1])) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 50


def test_collapsed_text(spark):
    rows = [(1, "go a b a b a b a b a b home", "en", "s", 1), (2, None, "en", "s", 1), (3, "no no no no no no", None, None, None)]
    got = {r["doc_id"]: r for r in p.collapse_runs(docs_of(spark, rows)).collect()}
    assert got[1]["text"] == "go a b home" and [tuple(r) for r in got[1]["runs"]] == [(1, 10, 2)]
    assert got[2]["text"] == "" and got[2]["n_words"] == 0 and got[3]["text"] == "no"


@pytest.mark.parametrize("fn", [p.run_digests, p.collapse_runs])
def test_empty_table(spark, fn):
    assert fn(docs_of(spark, [])).collect() == []
