"""Bars -> core features -> the busiest symbols of every bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.features_core import core_pack


def ranked_bars(bars: DataFrame, top_n: int = 3) -> DataFrame:
    feats = core_pack(bars)
    w = Window.partitionBy("ts").orderBy(F.col("f__vol__rel_volume_30").desc(), F.col("symbol"))
    return feats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
