"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes into buckets of ``bucket_bytes`` on average: doc_id and the number of shards alone decide the
shard (jump hashing, so one more shard takes rows only into itself), a second hash over doc_id and text the bucket inside the shard.
Pass two shuffles each bucket on its own: one partition holds one bucket, its records are put in a fixed order and permuted by
Spark's ``shuffle`` function, which draws a Fisher-Yates permutation from the seed plus the partition's number.  The number of records in the
buckets before it gives a record's slot, so slots of a shard are gapless and no sort spans a shard.

Everything is DataFrame functions; the result is the same after a rerun or a lost executor.  The largest unit a task holds is a bucket.
Rows equal in doc_id and text share a bucket; the number of buckets grows with the total bytes, not with any key's.

Sizes are UTF-8 bytes plus 16; a null text has none and the checksum of the empty text.  A null doc_id is a key like any other.  Repeated
rows get a slot each; an empty table gives an empty result; all columns pass through, derived names avoid those that exist.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, settle

OVERHEAD = 16
BUCKET_BYTES = 32 * 2**20
SEED = 20240109


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _unit(*key: Column) -> Column:
    """A seeded hash as a number in (0, 1]."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + 1) / F.lit(float(2**53))


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """Jump hashing: from bucket b the key jumps to floor((b + 1) / r) with r in (0, 1] from the hash of (doc_id, b), until that is
    beyond the last shard.  log(shards) jumps are expected; the bound on the number of jumps is far beyond any likely number,
    and the law (one more shard takes rows only into itself) holds for any bound."""
    jumps = 24 + 4 * math.ceil(math.log(max(2, shards)))
    step = lambda b, _: F.when(
        F.floor((b + 1) / _unit(doc_id, b, F.lit(seed))) < shards, F.floor((b + 1) / _unit(doc_id, b, F.lit(seed)))).otherwise(b)
    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), F.lit(0).cast("long"), step).cast("int")


def placed(docs: DataFrame, shards: int, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> tuple[DataFrame, int, dict[str, str]]:
    """docs with shard and bucket columns, the buckets per shard, and the names of those columns."""
    names = {x: fresh(docs, x) for x in ("shard", "bucket")}
    total = docs.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    each = max(1, math.ceil(total / shards / bucket_bytes))
    rows = docs.withColumn(names["shard"], shard_of(F.col("doc_id"), shards, seed))
    inside = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.lit(each)).cast("int") if each > 1 else F.lit(0)
    return rows.withColumn(names["bucket"], F.col(names["shard"]) * each + inside), each, names


def shuffle_shards(docs: DataFrame, shards: int, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """The given columns (all by default) with ``shard`` and ``slot``; each output partition is one bucket in slot order."""
    rows, each, names = placed(docs, shards, bucket_bytes, seed)
    shard, bucket = names["shard"], names["bucket"]
    per_shard = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(shard, bucket).agg(F.count("*").alias("n"))
    first = settle(counts.select(F.col(bucket).alias("bucket"), F.coalesce(F.sum("n").over(per_shard), F.lit(0)).alias("before")))
    carried = [F.col(c) for c in (carry or docs.columns)]
    hashed = [c for c, t in docs.select(*carried).dtypes if "map<" not in t and "variant" not in t]
    record = F.struct(F.xxhash64("doc_id", "text", *hashed, F.lit(seed + 2)).alias("_order"), F.struct(*carried).alias("_row"))
    # the bucket's first slot travels with the records as one more row, so that no join moves the texts again
    blank = F.lit(None).cast(rows.select(record.alias("r")).schema["r"].dataType)
    stream = (rows.select(F.col(bucket).alias("bucket"), record.alias("r"), F.lit(None).cast("long").alias("before"))
              .unionByName(first.select("bucket", blank.alias("r"), "before")))
    gathered = (stream.repartitionById(shards * each, F.col("bucket").cast("int")).groupBy("bucket")
                .agg(F.collect_list("r").alias("rs"), F.max("before").alias("before")))
    mixed = gathered.select("bucket", "before", F.posexplode(F.shuffle(F.array_sort("rs", _by_order), seed)).alias("at", "r"))
    return mixed.select("r._row.*", F.floor(F.col("bucket") / each).cast("int").alias(shard), (F.col("before") + F.col("at")).alias(fresh(docs, "slot")))


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0)


def write_shards(docs: DataFrame, path: str, shards: int, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """One folder per shard, one file per bucket, rows in slot order."""
    shard = fresh(docs, "shard")
    shuffle_shards(docs, shards, bucket_bytes, seed).write.mode("overwrite").partitionBy(shard).parquet(path)
