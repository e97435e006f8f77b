"""Bars from ticks, and coarser bars from finer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import MINUTE_NS, bucket_ns


def bars_from_ticks(ticks: DataFrame, width_ns: int, price: str = "price", size: str = "size",
                    ts: str = "ts", tie: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, ts, price, size) -> OHLCV bars; ``tie`` orders ticks with equal time."""
    pos = F.struct(ts, *tie)
    return ticks.groupBy("symbol", bucket_ns(ts, width_ns).alias("bar_ts")).agg(
        F.min_by(price, pos).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, pos).alias("close"),
        F.sum(size).cast("long").alias("volume"),
    ).withColumnRenamed("bar_ts", "ts")


def resample(bars: DataFrame, width_ns: int, extra: dict[str, str] | None = None,
             keep_empty: bool = False) -> DataFrame:
    """OHLCV bars of ``width_ns`` per symbol, combined map side before the shuffle.

    ``extra`` maps further columns to ``first``, ``last``, ``max``, ``min``, ``sum`` or ``mean``.
    With ``keep_empty`` the buckets between a symbol's first and last bar that hold no bar are emitted
    with NULL prices and volume 0.
    """
    fns: dict[str, Column] = {
        "open": F.min_by("open", "ts"), "high": F.max("high"), "low": F.min("low"),
        "close": F.max_by("close", "ts"), "volume": F.sum("volume"),
    }
    for name, how in (extra or {}).items():
        fns[name] = {
            "first": F.min_by(name, F.when(F.col(name).isNotNull(), F.col("ts"))),
            "last": F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ts"))),
            "max": F.max(name), "min": F.min(name), "sum": F.sum(name), "mean": F.avg(name),
        }[how]
    out = bars.groupBy("symbol", bucket_ns("ts", width_ns).alias("bar_ts")).agg(
        *[f.alias(n) for n, f in fns.items()]
    ).withColumnRenamed("bar_ts", "ts")
    return fill_empty_buckets(out, width_ns) if keep_empty else out


def bucket_list(bars: DataFrame, width_ns: int) -> DataFrame:
    """Every (symbol, bucket start) from the symbol's first to its last bar."""
    ends = bars.groupBy("symbol").agg(
        F.min(bucket_ns("ts", width_ns)).alias("lo"), F.max(bucket_ns("ts", width_ns)).alias("hi")
    )
    # Two explodes (day, then bucket in the day) keep each generated array short.
    day = max(width_ns * 1440, 1440 * MINUTE_NS)
    step = F.lit(width_ns).cast("long")
    days = ends.select("symbol", "lo", "hi", F.explode(F.sequence("lo", "hi", F.lit(day).cast("long"))).alias("d"))
    return days.select(
        "symbol",
        F.explode(F.sequence("d", F.least(F.col("hi"), F.col("d") + F.lit(day - width_ns).cast("long")), step)).alias("ts"),
    )


def fill_empty_buckets(bars: DataFrame, width_ns: int) -> DataFrame:
    return bucket_list(bars, width_ns).join(bars, ["symbol", "ts"], "left").withColumn(
        "volume", F.coalesce("volume", F.lit(0).cast("long"))
    )


def with_time_bars(df: DataFrame, width_ns: int) -> DataFrame:
    """Bucket start, end and offset of each row."""
    start = bucket_ns("ts", width_ns)
    return df.withColumns(
        {"bar_start": start, "bar_end": start + F.lit(width_ns).cast("long"), "bar_offset": F.col("ts") - start}
    )


def session_ranges(bars: DataFrame) -> DataFrame:
    """First and last bar of every (symbol, session), and rows before, in and after regular hours."""
    from ..functions.timecols import SESSION_CLOSE, SESSION_OPEN, market_minute, session_date

    m = market_minute("ts")
    n = lambda c: F.sum(c.cast("long"))
    return bars.groupBy("symbol", session_date("ts").alias("session_date")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), n(m < SESSION_OPEN).alias("pre_rows"),
        n((m >= SESSION_OPEN) & (m < SESSION_CLOSE)).alias("regular_rows"), n(m >= SESSION_CLOSE).alias("post_rows"))
