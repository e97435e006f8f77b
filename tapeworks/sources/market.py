"""Wide market context: one row per time with a column per (benchmark, field)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import bucket_ns
from ..operators.series import split_series


def market_context(bars: DataFrame, symbols: list[str], fields: Iterable[str] = ("open", "close"), width_ns: int | None = None) -> DataFrame:
    """Benchmarks side by side, last value per bucket, carried forward over gaps.

    The pivot values are given, so no extra job looks for them; the table has one row per bucket.
    """
    fields = list(fields)
    ts = bucket_ns("ts", width_ns) if width_ns else F.col("ts")
    rows = bars.where(F.col("symbol").isin(*symbols)).withColumn("_b", ts)
    wide = rows.groupBy("_b").pivot("symbol", symbols).agg(*[F.max_by(f, "ts").alias(f) for f in fields])
    if len(fields) == 1:
        wide = wide.withColumnsRenamed({s: f"{s}_{fields[0]}" for s in symbols})
    names = [f"{s}_{f}" for s in symbols for f in fields]
    f = split_series(wide.withColumnRenamed("_b", "ts").withColumn("_all", F.lit(0)), ["_all"])
    f = f.running({f"_f_{i}": ("last", F.col(f"`{n}`")) for i, n in enumerate(names)})
    out = f.finish().select("ts", *[F.col(f"_f_{i}").alias(n) for i, n in enumerate(names)])
    return out.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())
