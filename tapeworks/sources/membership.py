"""Daily universe membership: (trade_date partition, symbol, is_sip)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("sip_only", "no_sip", "all")


def membership_rows(shortlist: DataFrame, universe: DataFrame) -> DataFrame:
    """Every (day, symbol) of the universe with whether the day's shortlist holds it."""
    hit = shortlist.select("trade_date", F.upper("symbol").alias("symbol")).distinct().withColumn("_hit", F.lit(True))
    days = universe.select("trade_date", F.upper("symbol").alias("symbol")).distinct()
    return days.join(hit, ["trade_date", "symbol"], "left").select(
        F.col("trade_date").cast("string").alias("trade_date"), "symbol", F.col("_hit").isNotNull().alias("is_sip"))


def write_membership(rows: DataFrame, root: str) -> None:
    """Replaces only the days present in ``rows``."""
    rows.repartition("trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "trade_date").parquet(root)


def read_membership(spark: SparkSession, root: str, start: str, end: str, mode: str = "sip_only") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # The partition value stays text, as the range is compared as text.
    schema = "symbol string, is_sip boolean, trade_date string"
    df = spark.read.schema(schema).parquet(root).where(F.col("trade_date").between(start, end))
    if mode == "sip_only":
        return df.where("is_sip")
    return df.where(~F.col("is_sip")) if mode == "no_sip" else df
