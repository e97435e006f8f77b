"""Exact quantiles of groups of any size, by radix select.

``percentile`` keeps every distinct value of a group in one task, and ranking moves and sorts the values.  Here no value moves: a value's order is cut
into digits, most significant first, and every round counts one digit of the rows that still matter, map side, for all groups and all wanted ranks
at once.  The histogram of a round (at most ``DIGITS`` bins a group and wanted bin) says which bin holds each wanted rank; the next round looks
into those bins only.  The first digit is sign and magnitude in steps of ``STEPS`` a factor of e; the others cut the interval between the
smallest and the largest value of a bin into ``DIGITS`` equal parts.  Both are monotone in the value, so bins are in order.  A bin of the first round
spans less than 2^47 neighbouring doubles (a factor of e^(1/44) of 2^52 a binade), and each further round divides that by 2^16, so after four rounds
at most a bin is one value and the answer is exact; bins of one value need no further round, and prices or counts need two.  A round reads the input
once and keeps its few wanted bins (checkpointed); rows meet them in broadcast joins when they are counted few, else in shuffled ones.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import settle

#: digits of a round, rounds, steps of the first digit and where its zero lies (beyond the largest magnitude, ln(2^1074) steps)
DIGITS, ROUNDS, STEPS, MIDDLE = 1 << 16, 4, 44, 40_000
BROADCAST_ROWS = 500_000


def exact_percentiles(df: DataFrame, keys: Iterable[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with the linearly interpolated quantiles named in ``probs``; NULLs are ignored."""
    return order_statistics(df, keys, value, {name: (lambda total, p=p: (total - 1) * F.lit(float(p))) for name, p in probs.items()})


def kth_largest(df: DataFrame, keys: Iterable[str], value: str, k: Column, name: str) -> DataFrame:
    """The k-th largest value per group (the smallest one where a group has fewer); k may use key columns."""
    return order_statistics(df, keys, value, {name: lambda total: F.greatest(total - k, F.lit(0)).cast("double")})


def _magnitude(v: Column) -> Column:
    """First digit: monotone in the value, zero for zeros; infinities and NaN (the largest) have digits of their own."""
    size = F.floor(F.log(F.abs(v)) * STEPS) + MIDDLE
    of_sign = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))
    return F.when(F.isnan(v), 2 * MIDDLE + 1).when(F.abs(v) == float("inf"), F.signum(v) * 2 * MIDDLE).otherwise(of_sign).cast("int")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Further digits: which of ``DIGITS`` equal parts of [low, high] holds the value."""
    share = (v - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(low < high, F.least(F.floor(share * DIGITS), F.lit(DIGITS - 1))).otherwise(F.lit(0)).cast("int")


def order_statistics(df: DataFrame, keys: Iterable[str], value: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at (fractional) zero-based positions of each group's sorted values.

    A position is a function of the group size; between two ranks the value is interpolated linearly.  -0.0 equals 0.0; NaN is the largest value.
    """
    keys = list(keys)
    by = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    v = F.col("_v")
    rows = rows.select(*by, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).withColumn("_d0", _magnitude(v))

    def holds(at: Column) -> Column:
        start, end = F.col("_before"), F.col("_before") + F.col("_n")
        return (F.ceil(at) >= start) & (F.floor(at) < end) & ((F.floor(at) >= start) | (F.ceil(at) < end))

    def wanted(rows: DataFrame, digits: list[str], *known: str) -> DataFrame:
        """Bins that hold a wanted rank: their digits, number, smallest and largest value, rows before them, and the group's size."""
        parent, digit = [*by, *digits[:-1]], digits[-1]
        bins = rows.groupBy(*parent, digit).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
                                                *(F.first(c).alias(c) for c in known))
        inside = Window.partitionBy(*parent)
        earlier = F.sum("_n").over(inside.orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        bins = bins.withColumn("_start", earlier)
        bins = (bins.withColumn("_before", F.col("_before") + F.col("_start")) if known else
                bins.withColumnsRenamed({"_start": "_before"}).withColumn("_total", F.sum("_n").over(inside)))
        any_rank = reduce(operator.or_, (holds(fn(F.col("_total"))) for fn in positions.values()))
        return bins.where(any_rank).select(*by, *digits, "_n", "_low", "_high", "_before", "_total")

    digits, result = ["_d0"], ["_n", "_low", "_high", "_before", "_total"]
    found = settle(wanted(rows, digits))
    single = found.where("_low = _high").select(*by, *result)
    for i in range(1, ROUNDS):
        open_ = found.where("_low < _high")
        n_open = open_.limit(BROADCAST_ROWS + 1).count()
        if not n_open:
            break
        inner = open_.select(*by, *digits, F.col("_low").alias("_l"), F.col("_high").alias("_h"), "_before", "_total")
        if n_open <= BROADCAST_ROWS:
            inner = F.broadcast(inner)
        rows = rows.select(*by, "_v", *digits).join(inner, [*by, *digits]).withColumn(f"_d{i}", _part(v, F.col("_l"), F.col("_h")))
        digits = [*digits, f"_d{i}"]
        found = settle(wanted(rows, digits, "_before", "_total"))
        single = single.unionByName(found.where("_low = _high").select(*by, *result))
    start, end = F.col("_before"), F.col("_before") + F.col("_n")
    aggs = []
    for name, fn in positions.items():
        at = fn(F.col("_total"))
        lo, hi = F.floor(at), F.ceil(at)
        low, high = (F.max(F.when((r >= start) & (r < end), F.col("_low"))) for r in (lo, hi))
        aggs.append(F.when(low == high, low).otherwise(low + (high - low) * F.max(at - lo)).alias(name))
    return single.groupBy(*by).agg(*aggs).drop("_all")


def running_by_value(df: DataFrame, value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per distinct value with each measure's sum at the value and over all smaller values (NULLs are left out).

    Values are combined map side, dealt to ranges and sorted within them, so a task's share shrinks with the number of partitions.  The ranges are
    written once (checkpointed); a running sum streams through each, and what lies in earlier ranges is a sum over one row a range.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(*[F.sum(x).alias(n) for n, x in measures.items()])
    placed = settle(per.repartitionByRange("value").sortWithinPartitions("value").withColumn("_p", F.spark_partition_id()))
    names = list(measures)
    below = [f"{n}_below" for n in names]
    schema = T.StructType([*placed.schema.fields, *(T.StructField(b, placed.schema[n].dataType) for b, n in zip(below, names, strict=True))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        before, last = dict.fromkeys(names, 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("value").to_numpy(zero_copy_only=False)
            if (at[1:] < at[:-1]).any() or (last is not None and at[0] < last):
                raise RuntimeError("values of a range arrived out of order")
            last, new = at[-1], []
            for n in names:
                x = batch.column(n).fill_null(0).to_numpy(zero_copy_only=False)
                upto = before[n] + np.cumsum(x)
                new.append(pa.array(upto - x, batch.column(n).type))
                before[n] = upto[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *below])

    local = placed.mapInArrow(run, schema)
    early = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = placed.groupBy("_p").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    carry = totals.select("_p", *[F.coalesce(F.sum(f"_t_{n}").over(early), F.lit(0)).alias(f"_c_{n}") for n in names])
    out = local.join(F.broadcast(carry), "_p")
    return out.select("value", *names, *[(F.col(f"_c_{n}") + F.col(b)).alias(b) for n, b in zip(names, below, strict=True)])
