from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from corpus_cases import CLASHING, awkward, docs_of, prose, words
from pyspark.sql import functions as F

from tapeworks.llm import mixing


def direct_targets(sizes: dict) -> dict:
    """Share, stop at the cap, share the excess again, until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5000, "é": 70, None: 900, "": 3, "c": 0}, {"a": 10}, {None: 0, "z": 0}, {f"s{i}": (i * 37) % 101 for i in range(25)}):
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = direct_targets(sizes)
        assert len(rows) == len(sizes) and all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in rows)


def many(n=400):
    return [(i, prose(20 + i % 50, i), "en", f"s{i % 5}", 0) for i in range(n)] + awkward()


def test_words_taken_are_near_the_targets(spark):
    docs = docs_of(spark, many())
    rows, names = mixing.with_draws(docs, shards=6)
    got = rows.collect()
    assert len(got) == len(many()) and names["draws"] == "draws_"
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        w = len(words(r["text"]))
        size[r["source"]] += w
        taken[r["source"]] += w * len(r["draws_"])
        target[r["source"]] = r["target_"]
        assert len(r["draws_"]) <= 2 and all(r[c] == f"own {c}" for c in CLASHING)
    want = direct_targets(dict(size))
    longest = {s: max(len(words(t)) for _, t, _, x, _ in many() if x == s) for s in size}
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    again = mixing.with_draws(docs.repartition(3), shards=6)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_hold_equal_numbers_of_blocks(spark):
    docs = docs_of(spark, many(), clash=False)
    table = mixing.block_draws(docs, shards=6, blocks=64).collect()
    per_shard, seen = Counter(), set()
    for r in table:
        for d in r["draws"]:
            per_shard[d["shard"]] += 1
            assert (r["source"], r["block"], d["pass"]) not in seen
            seen.add((r["source"], r["block"], d["pass"]))
    assert len(per_shard) == 6 and max(per_shard.values()) - min(per_shard.values()) <= 3
    mixed = mixing.mix(docs, shards=6)
    assert mixed.columns == [*docs.columns, "shard", "mix_key"]
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hypergeometric_law(spark):
    cases = ((50, 20, 15), (300, 7, 200), (8, 8, 3), (9, 0, 4), (0, 0, 0), (5000, 2400, 2500))
    for total, good, drawn in cases:
        rows = spark.range(3000).select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), mixing._unit("id")).alias("k")).collect()
        k = np.array([r.k for r in rows])
        want = np.random.default_rng(0).hypergeometric(good, total - good, drawn, 3000) if total else np.zeros(1)
        assert k.min() >= max(0, drawn + good - total) and k.max() <= min(drawn, good)
        assert abs(k.mean() - want.mean()) < 5 * want.std() / 3000**0.5 + 1e-9 and abs(k.std() - want.std()) < 0.1 * want.std() + 1e-9


def test_quotas_are_split_exactly(spark):
    quotas = [500, 100, 0, 37, 2]
    rows = mixing.split_quotas(spark.createDataFrame([(quotas,)], "q array<bigint>"), 7).collect()
    assert sorted(r["shard"] for r in rows) == list(range(7)) and [sum(x) for x in zip(*(r["q"] for r in rows))] == quotas
    totals = [sum(r["q"]) for r in rows]
    assert max(totals) - min(totals) <= 3


def test_empty_and_single(spark, tmp_path):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    one = docs_of(spark, [(1, "a b c", "en", "x", 0)], clash=False)
    assert len(mixing.mix(one, shards=1).collect()) in (1, 2)
    mixing.write_mix(docs_of(spark, many(60), clash=False), str(tmp_path / "m"), shards=3)
    counts = defaultdict(int)
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        counts[r["shard"]] += 1
    assert set(counts) == {0, 1, 2}
