from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from corpus_cases import CLASHING, awkward, docs_of
from pyspark.sql import functions as F

from tapeworks.llm import sharding


def test_slots_have_no_gaps_and_columns_survive(spark):
    docs = docs_of(spark, awkward())
    got = sharding.shuffle_shards(docs, 5, bucket_bytes=3000)
    assert got.columns[: len(docs.columns)] == docs.columns and got.columns[-2:] == ["shard_", "slot_"]
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in awkward())
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard_"]].append(r["slot_"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_depends_on_key_and_count_only(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (1, 2, 7, 40):
        rows = ids.select(sharding.shard_of(F.col("doc_id"), n).alias("a"), sharding.shard_of(F.col("doc_id"), n + 1).alias("b")).collect()
        assert all(r.a == r.b or r.b == n for r in rows) and {r.a for r in rows} == set(range(n))
        counts = Counter(r.b for r in rows)
        assert all(abs(c - 4000 / (n + 1)) < 6 * (4000 / (n + 1)) ** 0.5 for c in counts.values())


def test_same_order_whatever_the_partitions(spark):
    docs = docs_of(spark, awkward(), clash=False)
    a = sharding.shuffle_shards(docs, 3, bucket_bytes=2000).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = sharding.shuffle_shards(docs.repartition(7), 3, bucket_bytes=2000).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(str, a)) == sorted(map(str, b))
    plan = sharding.shuffle_shards(docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_permutation_is_not_the_order_of_ids(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shuffle_shards(docs, 2).orderBy("shard", "slot").collect()
    first = [r.doc_id for r in rows if r.shard == 0]
    rising = sum(a < b for a, b in zip(first, first[1:])) / len(first)
    assert 0.4 < rising < 0.6


@pytest.mark.parametrize("shards", [1, 4])
def test_empty_table(spark, shards, tmp_path):
    empty = docs_of(spark, [])
    assert sharding.shuffle_shards(empty, shards).collect() == []
    docs = docs_of(spark, awkward(), clash=False)
    sharding.write_shards(docs, str(tmp_path / "out"), shards)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(awkward())


def test_query_moves_whole_records(spark):
    from tapeworks.llm import queries

    plan = queries.QUERIES["op1_sharding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    gathered = next(line for line in plan.splitlines() if "collect_list" in line)
    # before, sizes and checksums were taken first and the texts stayed behind
    assert "crc32" in plan[:plan.index(gathered)] and "crc32" not in plan[plan.index(gathered):]
