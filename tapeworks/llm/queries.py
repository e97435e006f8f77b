"""One query per operator over its whole table; each derives its digest columns from the operator's output."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from . import decontamination, line_dedup, mixing, periodic_runs, pii, quality_classifier, quality_rules, sharding, simhash, token_files, url_filter, warc, whitening
from .common import shared_folder, words_in
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole records move; the digest columns are taken from the sharded records
    mixed = sharding.shuffle_shards(table(spark, sf_dir, "documents"), 40)
    return mixed.select("doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                        F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(F.col("doc_id"), 41).alias("grown_shard"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_personal(table(spark, sf_dir, "documents")))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", words_in(F.col("text")).alias("size"))
    rows, names = mixing.with_draws(docs)
    draws = F.col(names["draws"])
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(draws)).alias("taken"),
                       F.transform(draws, lambda d: d["shard"]).alias("shards"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archive(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_windows", "n_matched", "containment", "n_changed")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.integer_vectors(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(vectors, whitening.fit(vectors, components=4))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), periodic_runs.with_planted_period)


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark, 'tokens')}/ids"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.ids_digest(token_files.read_tokens(spark, path))
