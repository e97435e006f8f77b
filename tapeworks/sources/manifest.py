"""Dataset manifests as hash trees: rows to (month, symbol) leaves, leaves to months, months to one root.

Two versions are compared from the root down, so equal months are never opened, and a manifest is brought up to date by hashing only the months whose
files changed.  Trees are tables (level, month, symbol, rows, first_ts, last_ts, hash); a month and a root have no symbol, the root no month.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import event_time
from ..operators.joins import attach_one_row, lookup_join
from ..operators.series import settle
from ..operators.setops import union_all

LEAF, MONTH, ROOT = "leaf", "month", "root"


def month_of(ts: str = "ts") -> Column:
    return F.date_format(event_time(ts), "yyyy-MM")


def canonical(df: DataFrame, columns: Iterable[str]) -> Column:
    """A row as text: columns in the given order, doubles in millionths (as they print from 1e15 on, NaN and infinities too), null as ``~``."""
    parts = []
    for c in columns:
        x = F.col(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            x = x.cast("double")
            small = F.floor(x * 1e6 + 0.5).cast("decimal(38,0)").cast("string")
            x = F.when(F.abs(x) < 1e15, small).otherwise(x.cast("string"))
        parts.append(F.coalesce(x.cast("string"), F.lit("~")))
    return F.concat_ws("|", *parts)


def leaf_hashes(df: DataFrame, columns: Iterable[str], symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """One row per (month, symbol): rows, range and a hash that no order of rows or files changes and repeated rows do.

    One scan of the named columns, one exchange of partial sums.
    """
    h = F.conv(F.substring(F.sha2(canonical(df, [symbol, ts, *columns]), 256), 1, 15), 16, 10).cast("long")
    rows = df.select(month_of(ts).alias("month"), F.col(symbol).alias("symbol"), F.col(ts).alias("_ts"), h.alias("_h"))
    found = rows.groupBy("month", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"),
        F.bit_xor("_h").alias("_x"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"))
    return found.select("month", "symbol", "rows", "first_ts", "last_ts", F.sha2(F.concat_ws("|", "rows", "_x", "_s"), 256).alias("hash"))


def _node(children: Column) -> Column:
    named = F.transform(F.array_sort(F.collect_list(children)), lambda c: F.concat_ws(":", F.coalesce(c["name"], F.lit("~")), c["hash"]))
    return F.sha2(F.array_join(named, ","), 256)


def hash_tree(leaves: DataFrame) -> DataFrame:
    """Leaves, months and root as one table.  A month gathers one hash per symbol, the root one per month."""
    sums = (F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    months = leaves.groupBy("month").agg(*sums, _node(F.struct(F.col("symbol").alias("name"), "hash")).alias("hash"))
    root = months.agg(*sums, _node(F.struct(F.col("month").alias("name"), "hash")).alias("hash"))
    return union_all([
        leaves.select(F.lit(LEAF).alias("level"), "month", "symbol", "rows", "first_ts", "last_ts", "hash"),
        months.select(F.lit(MONTH).alias("level"), "month", "rows", "first_ts", "last_ts", "hash"),
        root.select(F.lit(ROOT).alias("level"), F.coalesce("rows", F.lit(0)).alias("rows"), "first_ts", "last_ts", "hash")])


def changed_months(old: DataFrame, new: DataFrame) -> DataFrame:
    """(month, change): months ``added``, ``removed`` or ``changed`` between two trees; none are read where the roots agree."""
    return _changes(*(t.where(F.col("level") == MONTH).select("month", "hash") for t in (old, new)), ["month"])


def changed_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(month, symbol, change) of the leaves below changed months; the others are not compared."""
    where = changed_months(old, new).select("month")
    sides = [lookup_join(t.where(F.col("level") == LEAF).select("month", "symbol", "hash"), where, ["month"], "left_semi") for t in (old, new)]
    return _changes(*sides, ["month", "symbol"])


def _changes(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    a = old.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("hash").alias("_old"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = new.withColumnRenamed("hash", "_new").join(a, same, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.select(*[F.when(F.col("_new").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in on], kind.alias("change"))


def file_stamps(spark: SparkSession, root: str) -> DataFrame:
    """(month, stamp): names, sizes and times of a month's files in a dataset partitioned by ``month``, taken from file metadata; no column is read."""
    files = spark.read.parquet(root).select(F.col("month").cast("string").alias("month"), "_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("at")).distinct()
    named = F.struct(F.col("file_path").alias("name"), F.concat_ws(":", "file_size", "at").alias("hash"))
    return files.groupBy("month").agg(_node(named).alias("stamp"))


def write_tree(spark: SparkSession, root: str, path: str, columns: Iterable[str]) -> None:
    """Leaves and file stamps of the dataset at ``root``, new, below ``path``."""
    columns = list(columns)
    file_stamps(spark, root).write.mode("errorifexists").parquet(f"{path}/stamps")
    leaf_hashes(spark.read.parquet(root), columns).write.mode("errorifexists").parquet(f"{path}/leaves")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return hash_tree(spark.read.parquet(f"{path}/leaves"))


def refresh_tree(spark: SparkSession, root: str, old: str, new: str, columns: Iterable[str]) -> list[str]:
    """Write the tree of ``root`` to ``new``, hashing only months whose files differ from those of the tree at ``old``; returns these months.

    Leaves of months whose files are the same are taken over, those of months without files are left out.  The list of months goes through the driver.
    """
    stamps, before = settle(file_stamps(spark, root)), spark.read.parquet(f"{old}/stamps").withColumnRenamed("stamp", "_was")
    stale = [r["month"] for r in stamps.join(before, "month", "left").where(~F.col("stamp").eqNullSafe(F.col("_was"))).select("month").collect()]
    fresh = leaf_hashes(spark.read.parquet(root).where(F.col("month").cast("string").isin(stale)), list(columns))
    # a month folder holds the rows of its month
    held = spark.read.parquet(f"{old}/leaves").join(F.broadcast(stamps.where(~F.col("month").isin(stale)).select("month")), "month", "left_semi")
    stamps.write.mode("errorifexists").parquet(f"{new}/stamps")
    held.unionByName(fresh).write.mode("errorifexists").parquet(f"{new}/leaves")
    return sorted(stale)


def text_hash(value: object) -> str:
    """Hash of a configuration's canonical JSON: keys in order, no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def full_manifest(df: DataFrame, features: list[str], target: str, config: dict, universe: DataFrame, splits: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: rows, range, data hash (root of the tree), configuration, feature and universe hashes, and per split its range and rows.

    ``universe`` has symbol, close and volume of the selected symbols; ``splits`` maps names to inclusive dates.  The feature hash covers the
    feature columns and their values; the universe hash symbols, prices in cents and volumes.
    """
    data = hash_tree(leaf_hashes(df, [*features, target])).where(F.col("level") == ROOT)
    head = data.select("rows", "first_ts", "last_ts", F.col("hash").alias("data_hash"))
    values = hash_tree(leaf_hashes(df, features)).where(F.col("level") == ROOT)
    head = attach_one_row(head, values.select(F.sha2(F.concat_ws("|", F.lit(text_hash(features)), "hash"), 256).alias("features_hash")))
    cents = F.floor(F.col("close") * 100 + 0.5).cast("long").cast("string")
    row = F.struct(F.col("symbol").alias("name"), F.concat_ws("|", F.coalesce(cents, F.lit("~")), F.coalesce(F.col("volume").cast("long").cast("string"), F.lit("~"))).alias("hash"))
    head = attach_one_row(head, universe.agg(F.count(F.lit(1)).alias("symbols"), _node(row).alias("universe_hash")))
    day = F.date_format(event_time("ts"), "yyyy-MM-dd")
    inside = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(day.between(*span)).alias(f"{name}_rows") for name, span in splits.items()]).drop("_n")
    head = attach_one_row(head, inside) if splits else head
    return head.withColumns({"config_hash": F.lit(text_hash({"config": config, "splits": splits})), "features": F.lit(",".join(features)), "target": F.lit(target),
                             **{f"{name}_range": F.lit("..".join(span)) for name, span in splits.items()}})
