"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import settle

__all__ = ["broadcast_bounded", "fresh", "let", "map_arrow", "pick", "settle", "shared_folder", "words_in", "WORD"]

#: What counts as a word in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns with fixed types and nothing else, so that extra columns can't clash with derived ones."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast when it is counted to hold ``rows`` rows at most; otherwise the join shuffles. Give a settled table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema) -> DataFrame:
    """One batch in, one batch out; nothing is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, a scratch folder only where a local session sets none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="tapeworks-llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
