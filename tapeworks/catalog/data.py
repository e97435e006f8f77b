"""Bar, fill, prediction and other time-series tables derived from the given tables.

Prices are whole cents held in DOUBLE, volumes are whole numbers: sums are then exact in any order, so a
result does not depend on how Spark or the SQL engine splits the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mathcols import half_up
from ..functions.timecols import DAY_NS, MINUTE_NS, to_ns
from ..operators.resample import bars_from_ticks

BAR_NS = 30 * MINUTE_NS
WEEK_NS = 7 * DAY_NS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # The stored times carry no zone and mean UTC; local market time is derived from that.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event: symbol = event type and user cohort, size from the JSON counter."""
    e = table(spark, sf, "events")
    return e.select(
        F.upper(F.concat_ws("-", "event_type", F.floor(F.col("user_id") / 150).cast("string"))).alias("symbol"),
        to_ns("ts").alias("ts"),
        F.floor(F.col("value") * 100.0 + 0.5).cast("double").alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("size"),
        "event_id",
    )


def bars_e(spark: SparkSession, sf: str, width: int = BAR_NS) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf), width, tie=("event_id",))


def bars_l(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars per supplier from line items."""
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        to_ns("l_shipdate").alias("ts"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0 + 0.5).cast("double").alias("price"),
        F.col("l_quantity").cast("long").alias("size"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    return bars_from_ticks(li, WEEK_NS, tie=("l_orderkey", "l_linenumber", "l_partkey", "price", "size"))


def bench(spark: SparkSession, sf: str) -> DataFrame:
    """One market-wide series over all events, hourly."""
    return bars_from_ticks(ticks(spark, sf).withColumn("symbol", F.lit("MKT")), 60 * MINUTE_NS, tie=("event_id",))


def fixed(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded half up (coarser when large), integers as LONG: the form both engines agree on."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = c.cast("double")
            c = F.when(F.abs(x) < 1e4, half_up(x, digits)).when(F.abs(x) < 1e10, half_up(x, 2)).otherwise(half_up(x, 0))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- the same tables in SQL -------------------------------------------------------------------

TICKS = """tk AS (SELECT upper(event_type || '-' || CAST(user_id // 150 AS VARCHAR)) AS symbol,
  epoch_us(ts) * 1000 AS ts, floor(value * 100.0 + 0.5) AS price,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS size, event_id FROM events)"""


def _bars(name: str, src: str, width: int, symbol: str, tie: str) -> str:
    return f"""{name} AS (SELECT symbol, ts, open, high, low, close, volume FROM (
  SELECT {symbol} AS symbol, ts - ts % {width} AS ts, first(price ORDER BY {src}.ts, {tie}) AS open,
  max(price) AS high, min(price) AS low, last(price ORDER BY {src}.ts, {tie}) AS close,
  CAST(sum(size) AS BIGINT) AS volume FROM {src} GROUP BY 1, 2))"""


BARS_E = TICKS + ",\n" + _bars("bars", "tk", BAR_NS, "tk.symbol", "event_id")
BARS_L = """lt AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, epoch_us(l_shipdate) * 1000 AS ts,
  floor(l_extendedprice / l_quantity * 100.0 + 0.5) AS price, CAST(l_quantity AS BIGINT) AS size,
  l_orderkey, l_linenumber, l_partkey FROM lineitem),
""" + _bars("bars", "lt", WEEK_NS, "lt.symbol", "l_orderkey, l_linenumber, l_partkey, price, size")
BENCH = _bars("bench", "tk", 60 * MINUTE_NS, "'MKT'", "event_id")


def rounded(cols: str, sql: str, digits: int = 6) -> str:
    s = f"1e{digits}"
    parts = ", ".join(
        f"CASE WHEN abs({c}) < 1e4 THEN floor({c} * {s} + 0.5) / {s} WHEN abs({c}) < 1e10 THEN floor({c} * 100 + 0.5) / 100 "
        f"ELSE floor({c} + 0.5) END AS {c}" for c in cols.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


def sql(ctes: str, cols: str, body: str, digits: int = 6) -> str:
    inner = rounded(cols, body, digits) if cols else body
    return f"WITH {ctes}\n{inner}" if ctes else inner


W = "PARTITION BY symbol ORDER BY ts"


def roll(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def mp(fn: str, x: str, n: int, k: int, frame: str | None = None) -> str:
    """Aggregate ``fn`` (with {x}) over a rolling frame, NULL below k values."""
    over = frame or roll(n)
    return f"CASE WHEN count({x}) OVER {over} >= {k} THEN {fn.format(x=x)} OVER {over} END"
