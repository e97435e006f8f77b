from __future__ import annotations

from collections import Counter

from corpus_cases import awkward, docs_of, prose, words

from tapeworks.llm import quality_rules as q


def repeats(text: str) -> int:
    w = words(text)
    c = Counter(zip(w, w[1:], w[2:]))
    return len({p + k for p in range(len(w) - 2) if c[tuple(w[p : p + 3])] > 1 for k in range(3)})


def test_counts_of_one_text():
    text = "a b c a b c x\na b c a b c x\n\n # é|\n"
    n_words, chars, symbols, dup, rep, lines, caps = q.text_stats(text)
    assert (n_words, chars, symbols, dup, lines, caps) == (16, 17, 2, 1, 3, 0) and rep == repeats(text) == 14
    for seed in range(6):
        t = prose(300, seed) + "\n" + prose(50, seed)
        assert q.text_stats(t)[4] == repeats(t) and q.text_stats(t)[0] == len(words(t))
    assert q.text_stats(None) == q.text_stats("") == (0,) * 7


def test_awkward_rows(spark):
    rows = q.quality_rules(docs_of(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    by = {r["doc_id"]: r for r in rows}
    for i in (100, 101, 102):
        assert by[i]["n_words"] == 0 and by[i]["base_failed"] and not by[i]["kept"]
    assert by[103]["n_words"] == 40000 and by[104]["base_failed"]
    assert q.quality_rules(docs_of(spark, [])).collect() == []


def test_limits_follow_the_group(spark):
    rows = [(i, prose(80, i % 40), "en", "plain", 0) for i in range(240)]
    rows += [(1000 + i, prose(80, i % 40).replace(" ", " # "), "en", "tables", 0) for i in range(240)] + [(5000, prose(80, 3).replace(" ", " # "), "en", "plain", 0)]
    got = {r["doc_id"]: r for r in q.quality_rules(docs_of(spark, rows, clash=False)).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in list(range(240)) + list(range(1000, 1240)))
    assert not got[5000]["kept"] and "symbols" in got[5000]["failed"]


def test_sketch_quantiles_are_close_and_merge(spark):
    values = [(f"s{i % 3}", float((i * 7919) % 1000) / 10) for i in range(3000)]
    stats = spark.createDataFrame([("en", s, int(v * 10), 10, 0, 0, 0, 1, 0) for s, v in values],
                                  "lang string, source string, word_chars long, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long")
    sketch = q.ratio_sketches(stats)
    merged = q.sketch_quantiles(sketch, ["lang", "ratio"], {"m": 0.5}).filter("ratio = 'word_length'").first()
    exact = sorted(v for _, v in values)[1499]
    assert merged["rows"] == 3000 and abs(merged["m"] - exact) <= 0.011 * exact
