"""Bar files: hive-partitioned parquet (``symbol=X/month=YYYY-MM``) and plain per-symbol month files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathcols import no_nan
from ..functions.timecols import MARKET_TZ, event_time, infer_epoch_ns
from ..operators.quality import bar_rules, checked

# Short column names of raw files and the names they stand for.
SHORT_NAMES = {"t": "ts", "T": "symbol", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume",
               "vw": "vwap", "n": "trades"}
PRICES = ("open", "high", "low", "close")


def normalise_bars(df: DataFrame) -> DataFrame:
    """Any accepted spelling of a bar table to the canonical columns.

    Short names are renamed, epoch units recognised, values cast leniently, NaN becomes NULL, a missing
    volume counts as 0, rows with a non-positive time or a negative price are dropped, symbols are upper case.
    """
    # Raw files carry both ``t`` and ``T``, which Spark resolves case-insensitively: rename by position.
    taken = {c for c in df.columns if c in SHORT_NAMES.values()}
    names = [SHORT_NAMES[c] if c in SHORT_NAMES and SHORT_NAMES[c] not in taken else c for c in df.columns]
    df = df.toDF(*[f"_raw_{i}" if names.count(n) > 1 and c == n and c in SHORT_NAMES else n
                   for i, (c, n) in enumerate(zip(df.columns, names, strict=True))])
    have = set(df.columns)
    source: dict[str, Column] = {n: F.col(n) for n in SHORT_NAMES.values() if n in have}
    missing = [c for c in ("ts", "symbol", *PRICES, "volume") if c not in source]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = {
        "symbol": F.upper(F.trim(source["symbol"].cast("string"))),
        "ts": infer_epoch_ns(source["ts"].try_cast("long")),
        **{p: no_nan(source[p].try_cast("double")) for p in PRICES},
        "volume": F.coalesce(F.floor(no_nan(source["volume"].try_cast("double"))), F.lit(0)).cast("long"),
    }
    for extra in ("vwap", "spread", "turnover"):
        if extra in have:
            out[extra] = no_nan(F.col(extra).try_cast("double"))
    if "trades" in source:
        out["trades"] = source["trades"].try_cast("long")
    for text in ("session", "provider"):
        if text in have:
            out[text] = F.col(text).cast("string")
    bars = df.select(*[c.alias(n) for n, c in out.items()])
    priced = [F.coalesce(F.col(p) >= 0, F.lit(True)) for p in PRICES]
    return bars.where((F.col("ts") > 0) & priced[0] & priced[1] & priced[2] & priced[3])


def dedupe(df: DataFrame, keys: Iterable[str] = ("symbol", "ts"), prefer: Iterable[str] = ()) -> DataFrame:
    """One row per key, the first in ``prefer`` order (all other columns break ties), so reruns agree.

    An aggregation, not a window: duplicates are combined before the shuffle.
    """
    keys, prefer = list(keys), list(prefer)
    rest = [c for c in df.columns if c not in keys and c not in prefer]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*prefer, *rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def read_bars(spark: SparkSession, root: str, symbols: Iterable[str] | None = None, start: str | None = None,
              end: str | None = None, columns: Iterable[str] | None = None, by_month: bool = False, skip_corrupt: bool = False,
              validate: bool = False) -> DataFrame:
    """Canonical bars of a hive dataset; symbol and month prune files, the exact dates filter rows.

    ``by_month`` widens the date range to whole months.  A corrupt file is an error unless ``skip_corrupt`` is asked for; what is
    skipped then is in Spark's log.  ``validate`` checks every row as it is read (no further scan): the first one that breaks a bar rule ends the
    job with the rule, symbol and time.
    """
    df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("mergeSchema", "true").parquet(root)
    if symbols is not None:
        df = df.where(F.upper("symbol").isin(*[s.upper() for s in symbols]))
    if start is not None and "month" in df.columns:
        df = df.where(F.col("month").cast("string") >= start[:7])
    if end is not None and "month" in df.columns:
        df = df.where(F.col("month").cast("string") <= end[:7])
    bars = dedupe(normalise_bars(df))
    day = F.date_format(event_time("ts"), "yyyy-MM" if by_month else "yyyy-MM-dd")
    cut = 7 if by_month else 10
    if start is not None:
        bars = bars.where(day >= start[:cut])
    if end is not None:
        bars = bars.where(day <= end[:cut])
    if validate:
        bars = checked(bars, bar_rules())
    if columns is not None:
        keep = ["symbol", "ts", *[c for c in columns if c not in ("symbol", "ts")]]
        bars = bars.select(*[c for c in keep if c in bars.columns])
    return bars


def read_symbol_files(spark: SparkSession, glob: str, skip_corrupt: bool = False) -> DataFrame:
    """Month files without a symbol column, ``{SYM}/{YYYY}/{YYYY-MM}.parquet``: the symbol is in the path."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(glob)
    from_path = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/\d{4}/\d{4}-\d{2}[^/]*\.parquet$", 1)
    symbol = F.coalesce(F.col("symbol"), from_path) if "symbol" in df.columns else from_path
    return normalise_bars(df.withColumn("symbol", symbol))


def write_bars(bars: DataFrame, root: str, mode: str = "append") -> None:
    """Hive layout by symbol and month; rows are spread by (symbol, month) so each file has one writer,
    and a month of a hot symbol is cut further by day."""
    day = F.dayofmonth(event_time("ts"))
    out = bars.withColumn("month", F.date_format(event_time("ts"), "yyyy-MM"))
    out.repartition("symbol", "month", F.floor(day / 4)).sortWithinPartitions("symbol", "month", "ts").write.mode(
        mode
    ).partitionBy("symbol", "month").parquet(root)


def list_symbols(df: DataFrame) -> DataFrame:
    return df.select(F.upper("symbol").alias("symbol")).distinct()


def list_dates(df: DataFrame) -> DataFrame:
    """(symbol, number of dates, first, last) without collecting date lists."""
    d = df.select(F.upper("symbol").alias("symbol"), F.to_date(event_time("ts")).alias("date")).distinct()
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def window_slice(bars: DataFrame, start_ns: int, end_ns: int, symbols: Iterable[str] | None = None) -> DataFrame:
    """Inclusive time slice, optionally of some symbols."""
    out = bars.where(F.col("ts").between(start_ns, end_ns))
    return out.where(F.col("symbol").isin(*symbols)) if symbols is not None else out


def read_feature_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def symbol_list(lines: DataFrame, text: str = "value") -> DataFrame:
    """Candidate symbols from free text: split on commas and blanks, valid tokens only, upper case, distinct."""
    tokens = lines.select(F.explode(F.split(F.col(text), r"[,\s]+")).alias("symbol"))
    return tokens.select(F.upper("symbol").alias("symbol")).where(F.col("symbol").rlike(r"^[A-Z][A-Z0-9.\-]*$")).distinct()


def display_extract(bars: DataFrame) -> DataFrame:
    """Formatted market-time rows for a CSV extract."""
    local = F.from_utc_timestamp(event_time("ts"), MARKET_TZ)
    money = lambda c: F.format_string("%.2f", F.col(c))
    return bars.select(
        F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("Timestamp (ET)"), money("open").alias("Open"),
        money("high").alias("High"), money("low").alias("Low"), money("close").alias("Close"), F.col("volume").alias("Volume"),
    )


def first_files_sample(spark: SparkSession, root: str, n: int) -> DataFrame:
    """All rows of the first n files (by path), with the file each row came from."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(root).withColumn("source_file", F.col("_metadata.file_path"))
    first = df.select("source_file").distinct().orderBy("source_file").limit(n)
    return df.join(F.broadcast(first), "source_file", "left_semi")


def schema_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(family, file count, rows) below a root, plus the merged schema as text."""
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(root)
    files = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("rows"))  # paths are parsed once a file, not once a row
    family = F.regexp_extract(F.regexp_replace("f", F.lit(r"^file:"), F.lit("")), r"([^/]+)/[^/]*$", 1)
    return files.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")).withColumn(
        "schema", F.lit(df.schema.simpleString()))
