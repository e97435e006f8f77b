"""Set operations on tables: unions, intersections, differences, replication, first difference, row hashes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("symbol").intersect(b.select("symbol"))


def missing_symbols(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.select("symbol").distinct().join(present.select("symbol"), "symbol", "left_anti")


def oversample(df: DataFrame, label: str, ratio_cap: int, seed: int, key: Iterable[str], target_share: float = 1.0) -> DataFrame:
    """Repeat directional rows up to ``ratio_cap`` times so that they approach the neutral count.

    Copies are drawn by a seeded hash of (row key, copy number), so the choice does not depend on
    partitioning; how many copies are wanted follows from two global counts.
    """
    counts = df.agg(
        F.sum((F.col(label) != 0).cast("long")).alias("_dir"), F.sum((F.col(label) == 0).cast("long")).alias("_neu"))
    from .joins import attach_one_row

    full = attach_one_row(df.where(F.col(label) != 0), counts)
    wanted = F.least(F.col("_neu") * F.lit(target_share) / F.col("_dir"), F.lit(float(ratio_cap)))
    extra = F.greatest(wanted - 1.0, F.lit(0.0))
    copies = full.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max(ratio_cap - 1, 1)))))
    unit = (F.pmod(F.xxhash64(F.lit(seed), *key, "_copy"), F.lit(1_000_003).cast("long")) / 1_000_003.0)
    # Copy number k is kept whole while extra >= k, by chance for the fraction, else dropped.
    keep = extra - (F.col("_copy") - 1)
    chosen = copies.where((keep >= 1.0) | ((keep > 0) & (unit < keep)))
    return df.withColumn("copy", F.lit(0)).unionByName(
        chosen.select(*df.columns, F.col("_copy").cast("int").alias("copy")))


def first_difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The earliest key at which two tables differ (a row missing on one side differs); no row if equal."""
    left = a.select(*keys, F.struct(*values).alias("left_values"))
    right = b.select(*keys, F.struct(*values).alias("right_values"))
    diff = left.join(right, keys, "full_outer").where(~F.col("left_values").eqNullSafe(F.col("right_values")))
    return diff.orderBy(*keys).limit(1)


def row_hash(df: DataFrame, columns: Iterable[str] | None = None, digits: int = 6) -> Column:
    """Hash of a row's canonical JSON: doubles rounded, columns in name order."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in sorted(columns or df.columns):
        x = F.col(c)
        parts.append((F.round(x, digits) if isinstance(fields[c], (T.DoubleType, T.FloatType)) else x).alias(c))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def table_hash(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: order-independent hash of a table (any row order or partitioning gives the same value).

    Row hashes are folded by exclusive or, by sum and by count, so repeated rows do not cancel.
    """
    h = F.conv(F.substring(row_hash(df, columns), 1, 15), 16, 10).cast("long")
    folded = df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return folded.select(F.col("n").alias("rows"), F.sha2(F.concat_ws("|", "n", "x", "s"), 256).alias("hash"))


def column_hashes(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(column, hash) for each column together with the row key."""
    return union_all([table_hash(df.select(*key, c)).select(F.lit(c).alias("column"), "hash") for c in columns])


def combined_checksum(*hashes: str) -> str:
    import hashlib

    return hashlib.sha256("|".join(hashes).encode()).hexdigest()
