"""The corpus pipeline: quality, near copies, benchmark leaks, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's documents.
All but the last return the columns of documents; the last adds the shard and the place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import decontamination, mixing, quality_classifier, sharding, simhash
from tapeworks.llm.common import shared_folder
from tapeworks.shipping import ship_package

SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours vote to be good."""
    ship_package(spark)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group whose five-word shingles have a similarity of 0.8 or more."""
    ship_package(spark)
    return simhash.drop_near_copies(docs, simhash.similar_texts(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, its numbers, names and units aside."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources draw them."""
    return mixing.mix(docs).select(*docs.columns)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, each shard in random order."""
    return sharding.shuffle_shards(docs, SHARDS)


STAGES = [("quality", keep_quality), ("near_copies", drop_copies), ("leaks", drop_leaks), ("mix", mix_sources), ("shards", make_shards)]

#: fingerprints, seeded hashes and trained scores have no SQL form; tests compare each stage with a direct computation
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every intermediate table is written to the folder the cluster shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark, 'pipeline')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
