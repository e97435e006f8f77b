from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from corpus_cases import awkward, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeworks.llm import token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = token_files.Encoder(VOCABULARY)
PLAIN = Tokenizer.from_file(VOCABULARY)
ODD = ["  two  blanks \n\n and\tTabs\r\n", "a b c　d", "x<|endoftext|>y", "don't we'll 12 3.4 ???", "\n", " ", "tail \n ", "ünï €uro 日本 語", "a \n\n b\n \n c", "\x1c x \x85 y"]


def expected(rows):
    return [(i, [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]


def test_chunks_encode_like_whole_texts():
    encode = token_files.Encoder(VOCABULARY)
    texts = ODD + [r[1] or "" for r in awkward()]
    want = [ids[:-1] for _, ids in expected([(0, t) for t in texts])]
    assert [x.tolist() for x in encode(pa.array(texts))] == want
    assert [encode(pa.array([t]))[0].tolist() for t in texts] == want
    assert [x.tolist() for x in encode(pa.array([None, "a", None]))] == [[], [64], []]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'.,-12aé日"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_texts_encode_like_whole_texts(texts):
    assert [x.tolist() for x in ENCODER(pa.array(texts, pa.string()))] == [ids[:-1] for _, ids in expected([(0, t) for t in texts])]


def test_a_full_store_drops_old_chunks(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_CHUNKS", 30)
    encode = token_files.Encoder(VOCABULARY)
    texts = [r[1] or "" for r in awkward()][:24]
    assert [encode(pa.array([t]))[0].tolist() for t in texts] == [ids[:-1] for _, ids in expected([(0, t) for t in texts])]


def test_round_trip_of_awkward_rows(spark, tmp_path):
    rows = awkward() + [(1000 + i, t, "en", "s0", 1) for i, t in enumerate(ODD)]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs_of(spark, rows), path, VOCABULARY, 2, files=5)
    got = token_files.read_tokens(spark, path).collect()
    want = expected([(r[0], r[1]) for r in rows])
    assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in got) == sorted((repr(i), ids) for i, ids in want)
    got.sort(key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    crc = {(r["start"]): r["ids_crc32"] for r in token_files.ids_digest(token_files.read_tokens(spark, path)).collect()}
    assert crc == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got}


def scanned(df) -> int:
    """Rows the file scan of an executed query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, found = [plan.executedPlan() if "Adaptive" in plan.nodeName() else plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan orc"):
            found += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_readers_skip_row_groups_and_split_by_stripe(spark, tmp_path):
    rows = [(2 * i, f"word{i * 7919 % 1000} and {i} more {'x' * (i % 50)}", "en", "s", 1) for i in range(20000)]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs_of(spark, rows, clash=False), path, VOCABULARY, 2, files=2, stripe_bytes=1 << 16, index_rows=1000)
    whole = {r["doc_id"]: r for r in token_files.read_tokens(spark, path).collect()}
    assert len(whole) == 20000
    some = token_files.read_tokens(spark, path, [4000, 4001, 30002])
    found = {r["doc_id"]: r for r in some.collect()}
    assert found == {d: whole[d] for d in (4000, 30002)}
    assert 0 < scanned(some) <= 4000
    # an id inside the files' spans that no document has: the Bloom filters leave little to read
    assert scanned(token_files.read_tokens(spark, path, [4001])) <= 1000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        sizes = token_files.read_tokens(spark, path).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 20000 and sum(s > 0 for s in sizes) > 2


@pytest.mark.parametrize("files", [None, 3])
def test_empty_table(spark, tmp_path, files):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs_of(spark, []), path, VOCABULARY, 2, files=files)
    assert token_files.ids_digest(token_files.read_tokens(spark, path)).collect() == []
    assert token_files.read_tokens(spark, path, [1]).collect() == []
