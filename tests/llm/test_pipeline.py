"""The pipeline's stages against what they are to keep, and the registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import importlib
import sys
from collections import Counter
from pathlib import Path

import pytest
from corpus_cases import docs_of, prose

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_planted_rows(spark, tmp_path):
    import corpus_pipeline as c

    question = prose(45, 4242)
    rows = [(i, prose(90, i), "en", f"s{i % 3}", 0) for i in range(90)]
    rows += [(200 + i, " ".join([f"WORD{i}!!"] * 80), "en", "s0", 0) for i in range(45)]
    rows += [(300, prose(90, 5), "en", "s1", 0), (301, prose(90, 6).replace("river", "brook"), "en", "s1", 0), (302, prose(60, 900) + "\n" + question, "en", "s2", 0)]
    docs_of(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows if i < 245], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS if name != "shards" else out.columns == [*COLUMNS, "shard", "slot"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = Counter(r["doc_id"] for r in docs.collect())
    assert set(after["quality"]) == set(range(90)) | {300, 301, 302}
    assert 300 not in after["near_copies"] and set(range(90)) <= set(after["near_copies"]) and 302 in after["near_copies"]
    assert set(after["leaks"]) == set(after["near_copies"]) - {302}
    assert set(after["mix"]) <= set(after["leaks"]) and max(after["mix"].values()) <= 2 and after["shards"] == after["mix"]
    final = spark.read.parquet(str(tmp_path / "shards")).collect()
    slots = {(r["shard"], r["slot"]) for r in final}
    assert len(slots) == len(final)
    again = c.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in again) == Counter((r["doc_id"], r["shard"]) for r in final)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    docs_of(spark, [], clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert c.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_url_filter", "op6_line_dedup", "op8_warc"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    check = importlib.import_module("check_oracle")
    from tapeworks.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(ORACLES[name])
    idx = [[d[0] for d in res.description].index(c) for c in cols]
    got = sorted((tuple(check.norm(r[c]) for c in cols) for r in df.collect()), key=check.key)
    assert got == sorted((tuple(check.norm(r[i]) for i in idx) for r in res.fetchall()), key=check.key)


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
