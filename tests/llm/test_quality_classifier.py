from __future__ import annotations

import numpy as np
from corpus_cases import CLASHING, awkward, docs_of, held_out, prose

from tapeworks.llm import quality_classifier as q


def labelled(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        rows.append((i, prose(70 + i % 40, i) if good else " ".join([prose(3, i).split()[0].upper() + "!!"] * (60 + i % 20)), "en", "s", 0))
        labels.append((i, int(good), 0))
    return docs_of(spark, rows, clash=False), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = q.quality_scores(docs, q.fit(docs, labels)).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.98


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(spark, 120)
    lied = labels.rdd.map(lambda r: (r["doc_id"], r["quality"], 0)).collect()
    lied = spark.createDataFrame([(i, 1 - y if held_out(i) else y, t) for i, y, t in lied], labels.schema)
    a, b = (sorted(map(tuple, q.quality_scores(docs, q.fit(docs, x)).collect())) for x in (labels, lied))
    assert a == b


def test_votes_match_a_direct_computation(spark):
    docs, labels = labelled(spark, 90)
    model = q.fit(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = model.scores(texts)
    z = model.latent(np.stack([q.features(t) for t in texts]))
    for i, v in enumerate(z):
        c = model.vectors @ v
        near = np.argsort(-c, kind="stable")[: q.NEIGHBOURS]
        w = np.maximum(c[near], 1e-6) ** 4
        if np.sort(c)[-q.NEIGHBOURS - 1] < c[near[-1]] - 1e-6:  # no tie at the border
            assert abs(got[i] - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_awkward_rows(spark):
    docs, labels = labelled(spark, 60)
    model = q.fit(docs, labels)
    odd = docs_of(spark, awkward())
    got = q.quality_scores(odd, model).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (100, 101)}
    assert len(empty) == 1
    kept = q.keep_good(odd, model)
    assert kept.columns == odd.columns and all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHING)
    assert q.quality_scores(docs_of(spark, []), model).collect() == []
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0)], labels.schema)
    assert {r["score"] for r in q.quality_scores(docs, q.fit(docs, nulls)).collect()} == {0.5}
    assert q.fit(docs_of(spark, []), labels).labels.size == 0
