from __future__ import annotations

import re

from corpus_cases import CLASHING, awkward, docs_of, prose

from tapeworks.llm import line_dedup


def direct(rows: list[tuple]) -> dict:
    """Texts of distinct ids in id order, nulls last, with later repeats of three content lines taken out."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(lines[a] for a in at[k : k + 3])
            if w in seen:
                gone |= set(at[k : k + 3])
            seen.add(w)
        out[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def cases() -> list[tuple]:
    shared = "first shared line\nsecond shared line\n\nthird shared line\nfourth shared line"
    rows = [(i, prose(40 + i, i) + "\n" + shared + "\n" + prose(30, 100 + i), "en", "s", 0) for i in range(12)]
    rows += [(50, "x\ny\nz\nx\ny\nz\nx\ny", "en", "s", 0), (51, "a\nb", "en", "s", 0), (52, "a\nb\nc\n", "en", "s", 0), (53, "b\n \na\nb\nc\n\n", "en", "s", 0)]
    return rows


def test_equals_a_direct_computation(spark):
    rows = cases() + [(r[0] + 1000, *r[1:]) for r in awkward() if r[0] is not None]
    docs = docs_of(spark, rows)
    result = line_dedup.dedup_lines(docs)
    assert result.columns == [*docs.columns, "n_lines_", "n_removed_"]
    want, got = direct(rows), result.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_removed_"]) == want[r["doc_id"]], r["doc_id"]
        assert all(r[c] == f"own {c}" for c in CLASHING)


def test_same_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rows = cases()
    want = direct(rows)
    assert all((r["text"], r["n_removed"]) == want[r["doc_id"]] for r in line_dedup.dedup_lines(docs_of(spark, rows, clash=False)).collect())


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a\nb\nc", "en", "s", 0), (None, "q\na\nb\nc", "en", "s", 0), (9, "a\nb\nc", "en", "s", 0), (None, None, None, None, None)]
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect())
    assert got == [("9", "a\nb\nc"), ("None", ""), ("None", ""), ("None", "q")]
    assert line_dedup.dedup_lines(docs_of(spark, [])).collect() == []
