"""Months of a bar dataset held for overlapping windows: loaded when first asked for, released and evicted by use."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import DAY_NS, event_time
from ..operators.setops import union_all
from .bars import dedupe, window_slice


def months_between(start: str, end: str) -> list[str]:
    """``yyyy-MM`` of every month from the one of ``start`` to the one of ``end`` (dates or months, inclusive)."""
    first, last = (int(d[:4]) * 12 + int(d[5:7]) - 1 for d in (start, end))
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]


def write_months(bars: DataFrame, root: str, mode: str = "overwrite", files_per_month: int = 1) -> None:
    """Hive layout by month only, sorted by (symbol, ts); ``files_per_month`` writers share a month by symbol and day."""
    at = event_time("ts")
    part = F.pmod(F.xxhash64("symbol", F.to_date(at)), F.lit(files_per_month))
    out = bars.withColumn("month", F.date_format(at, "yyyy-MM")).withColumn("_part", part)
    out.repartition("month", "_part").sortWithinPartitions("month", "symbol", "ts").drop("_part").write.mode(mode).partitionBy("month").parquet(root)


class _Block:
    """Months loaded together: their rows, and the open windows that read them."""

    def __init__(self, months: list[str], rows: DataFrame):
        self.months, self.rows, self.refs = months, rows, 0


class BarWindow:
    """Bars of one window; while it is open its blocks stay held.  Close it, or use it in a ``with`` statement."""

    def __init__(self, cache: BarWindows, blocks: list[_Block], bars: DataFrame):
        self._cache, self._blocks, self.bars = cache, blocks, bars

    def __enter__(self) -> DataFrame:
        return self.bars

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        blocks, self._blocks = self._blocks, []
        self._cache._release(blocks)


class BarWindows:
    """Windows over a dataset partitioned by ``month`` (``write_months``, ``write_bars``), sharing the months they overlap in.

    The months of a window that are not held yet are loaded as one block: passed through ``prepare`` (one row per symbol and time by default;
    ``normalise_bars`` for raw files) and persisted on the executors, memory first, the rest on their disks, when the window is first read.  A later window reads only the files of
    months not held.  Open windows count as references; at most ``keep`` months stay held without one: the least recently used blocks go first, a block
    in use never.  Lost executors cost a new read of their parts, no result.  Months without files are empty.  The files are those listed at construction
    or by ``refresh``, which forgets what is held without a reference.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 24, prepare: Callable[[DataFrame], DataFrame] = dedupe,
                 level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        if keep < 0:
            raise ValueError("keep must not be negative")
        self._spark, self._root, self._keep, self._prepare, self._level = spark, root, keep, prepare, level
        self._blocks: list[_Block] = []  # least recently used first
        self._files = spark.read.parquet(root)

    @property
    def held(self) -> list[str]:
        """Months held now, those of the least recently used block first."""
        return [m for b in self._blocks for m in b.months]

    def refresh(self) -> None:
        """List the files anew; blocks in use keep the rows they have."""
        self._files = self._spark.read.parquet(self._root)
        self._evict(0)

    def window(self, start: str, end: str, symbols: Iterable[str] | None = None) -> BarWindow:
        """Rows of the dates ``start`` to ``end`` (``yyyy-MM-dd``, UTC, inclusive), optionally of some symbols."""
        first, last = (_ns(date.fromisoformat(d)) for d in (start, end))
        return self.slice(first, last + DAY_NS - 1, symbols)

    def slice(self, start_ns: int, end_ns: int, symbols: Iterable[str] | None = None) -> BarWindow:
        """``window`` by nanoseconds (UTC, inclusive)."""
        if start_ns > end_ns:
            raise ValueError(f"window ends before it starts: {start_ns} {end_ns}")
        wanted = months_between(_date(start_ns), _date(end_ns))
        held = set(self.held)
        missing = [m for m in wanted if m not in held]
        if missing:
            rows = self._files.where(F.col("month").cast("string").isin(missing)).drop("month")
            self._blocks.append(_Block(missing, self._prepare(rows).persist(self._level)))
        used = [b for b in self._blocks if set(b.months) & set(wanted)]
        self._blocks = [b for b in self._blocks if b not in used] + used
        for b in used:
            b.refs += 1
        return BarWindow(self, used, window_slice(union_all([b.rows for b in used]), start_ns, end_ns, symbols and [s.upper() for s in symbols]))

    def close(self) -> None:
        """Forget every block without a reference."""
        self._evict(0)

    def _release(self, blocks: list[_Block]) -> None:
        for b in blocks:
            b.refs -= 1
        self._evict(self._keep)

    def _evict(self, keep: int) -> None:
        idle = [b for b in self._blocks if b.refs == 0]
        while sum(len(b.months) for b in idle) > keep:
            gone = idle.pop(0)
            self._blocks.remove(gone)
            gone.rows.unpersist()


def _ns(day: date) -> int:
    return (day - date(1970, 1, 1)).days * DAY_NS


def _date(ns: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=ns // DAY_NS)).isoformat()
