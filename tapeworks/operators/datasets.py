"""Labelled data sets, time-ordered splits, purged folds and walk-forward periods."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import DAY_NS, event_time, idiv
from .joins import attach_one_row
from .jumps import orbit
from .labels import big_move_labels
from .series import Frame, split_series

SPLITS = ("train", "valid", "test")


def day_of(ts: Column | str = "ts") -> Column:
    return idiv(F.col(ts) if isinstance(ts, str) else ts, DAY_NS)


def label_distribution(labels: DataFrame, per_symbol: bool = False) -> DataFrame:
    """Counts of short, flat and long labels per day (and symbol)."""
    keys = [*(["symbol"] if per_symbol else []), "day"]
    count = lambda v: F.sum((F.col("label") == v).cast("long"))
    return labels.withColumn("day", day_of()).groupBy(*keys).agg(
        count(-1).alias("short"), count(0).alias("flat"), count(1).alias("long"))


# --- splits -------------------------------------------------------------------------------------------


def _assign(position: Column, n: Column, train: float, valid: float) -> Column:
    """Split by zero-based position within n ordered rows."""
    return F.when(position < F.floor(n * train), "train").when(position < F.floor(n * (train + valid)), "valid").otherwise("test")


def split_by_symbol(df: DataFrame, train: float = 0.7, valid: float = 0.15, min_rows: int = 1,
                    max_rows: int | None = None) -> DataFrame:
    """Adds ``split``: each symbol's earliest rows train, then validation, then test; short symbols are left out."""
    sizes = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    f = split_series(df, max_rows=max_rows).running({"_pos": ("count", F.lit(1))})
    out = f.finish().join(sizes, "symbol")
    return out.withColumn("split", _assign(F.col("_pos") - 1, F.col("_n"), train, valid)).drop("_pos", "_n")


def split_global(df: DataFrame, train: float = 0.7, valid: float = 0.15, max_rows: int | None = None) -> DataFrame:
    """Adds ``split`` by one time order over all symbols (ties by symbol).

    Positions come from row counts per timestamp, so the full table is never sorted in one task.
    """
    per_ts = df.groupBy("ts").agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.lit(0))
    f = split_series(per_ts, ["_all"], max_rows=max_rows).running({"_end": ("sum", F.col("_c"))})
    starts = f.finish().select("ts", (F.col("_end") - F.col("_c")).alias("_start"))
    total = per_ts.agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy("ts").orderBy("symbol")
    out = attach_one_row(df.join(starts, "ts").withColumn("_pos", F.col("_start") + F.row_number().over(w) - 1), total)
    return out.withColumn("split", _assign(F.col("_pos"), F.col("_n"), train, valid)).drop("_start", "_pos", "_n")


def split_statistics(df: DataFrame, features: Iterable[str], target: str) -> DataFrame:
    """Rows, symbols, time range, and mean and deviation of features and target per split."""
    cols = [x for c in [*features, target] for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), *cols)


def split_problems(df: DataFrame) -> DataFrame:
    """(problem, count): symbols whose splits overlap in time or share timestamps; empty splits."""
    ends = df.groupBy("symbol").agg(*[x for s in SPLITS for x in (
        F.min(F.when(F.col("split") == s, F.col("ts"))).alias(f"{s}_lo"), F.max(F.when(F.col("split") == s, F.col("ts"))).alias(f"{s}_hi"))])
    late = lambda a, b: F.coalesce((F.col(f"{a}_hi") >= F.col(f"{b}_lo")).cast("long"), F.lit(0))
    overlap = ends.agg(
        F.sum(late("train", "valid")).alias("train_after_valid"), F.sum(late("valid", "test")).alias("valid_after_test"),
        F.sum(late("train", "test")).alias("train_after_test"),
        *[F.when(F.max(f"{s}_hi").isNull(), 1).otherwise(0).cast("long").alias(f"empty_{s}") for s in SPLITS])
    return overlap.unpivot([], overlap.columns, "problem", "count")


# --- folds --------------------------------------------------------------------------------------------


def trading_days(df: DataFrame) -> list[int]:
    """Sorted day numbers present in the data (one per calendar day: bounded by the length of history)."""
    return [r[0] for r in df.select(day_of().alias("d")).distinct().orderBy("d").collect()]


def purged_folds(days: list[int], n_folds: int, purge_days: int = 0, method: str = "purged_cv",
                 train_days: int | None = None) -> list[dict]:
    """Validation blocks of days with training strictly before them, ``purge_days`` calendar days apart.

    ``rolling_window`` keeps only the latest ``train_days`` days of training; the other methods expand.
    """
    size, folds = len(days) // n_folds, []
    for k in range(n_folds):
        lo, hi = k * size, (k + 1) * size if k < n_folds - 1 else len(days)
        if lo == 0 or lo >= hi:
            continue
        last_train = min(days[lo - 1], days[lo] - purge_days - 1)
        first_train = days[0] if method != "rolling_window" else max(days[0], last_train - (train_days or size) + 1)
        folds.append({"fold": k + 1, "train_from": first_train, "train_to": last_train, "val_from": days[lo], "val_to": days[hi - 1]})
    return folds


MONTH = 30  # days that count as a month in walk-forward periods


def walk_forward_periods(days: list[int], train_months: int, val_months: int, oos_months: int, step_months: int,
                         window: str = "rolling", start: int | None = None) -> list[dict]:
    """Train, validation and out-of-sample day ranges; a month counts 30 days and ends snap to data days.

    A table over the sorted days says for a period that begins on each of them where its parts end and when the next one begins (all by bisection);
    the periods are the rows met from the first day on (or the first from ``start``), as long as all three parts end within the data.
    """
    table = pd.DataFrame({"train_from": np.asarray(days, np.int64)})
    known, n = table["train_from"].to_numpy(), len(table)

    def snapped(target: np.ndarray) -> np.ndarray:
        """First data day at or after each target, as a position; n beyond the data (and for positions beyond it)."""
        return np.searchsorted(known, target)

    def ends(after: np.ndarray, months: int) -> tuple[np.ndarray, np.ndarray]:
        begin = np.append(known, np.iinfo(np.int64).max // 2)[after] + 1
        return begin, snapped(begin + MONTH * months)

    train_end = snapped(known + MONTH * train_months)
    table["val_from"], val_end = ends(train_end, val_months)
    table["oos_from"], oos_end = ends(val_end, oos_months)
    origin = known if window == "rolling" else table["oos_from"].to_numpy()
    following = np.maximum(snapped(origin + MONTH * step_months), np.arange(1, n + 1))
    begins = [] if not n else orbit(np.append(following, n), int(snapped(np.array(start if start is not None else known[0]))) % n)
    for name, end in (("train_to", train_end), ("val_to", val_end), ("oos_to", oos_end)):
        table[name] = np.append(known, -1)[end]
    whole = np.cumprod(oos_end[begins] < n).astype(bool) if len(begins) else []
    met = table.iloc[begins][whole] if len(begins) else table
    order = ["train_from", "train_to", "val_from", "val_to", "oos_from", "oos_to"]
    return [{"fold": i + 1, **row} for i, row in enumerate(met[order].to_dict("records"))]


def fold_rows(df: DataFrame, folds: list[dict]) -> DataFrame:
    """Rows once per (fold, role) they belong to; the few folds are literals, so there is no join."""
    d = day_of()
    parts = []
    for f in folds:
        for role in ("train", "val", "oos"):
            if f"{role}_from" in f:
                parts.append(F.when(d.between(f[f"{role}_from"], f[f"{role}_to"]),
                                    F.struct(F.lit(f["fold"]).alias("fold"), F.lit(role).alias("role"))))
    return df.withColumn("_f", F.explode(F.array_compact(F.array(*parts)))).select("*", "_f.fold", "_f.role").drop("_f")


def fold_report(df: DataFrame, folds: list[dict], common_symbols: bool = True, min_rows: int = 1, min_symbols: int = 1,
                against: str = "val") -> DataFrame:
    """Size and symbols of every fold's two sides; with ``common_symbols`` only symbols on both sides count."""
    tagged = fold_rows(df, folds).where(F.col("role").isin("train", against))
    per = tagged.groupBy("fold", "symbol").agg(
        F.sum((F.col("role") == "train").cast("long")).alias("t"), F.sum((F.col("role") == against).cast("long")).alias("v"))
    if common_symbols:
        per = per.where((F.col("t") > 0) & (F.col("v") > 0))
    g = per.groupBy("fold").agg(
        F.sum("t").alias("train_rows"), F.sum("v").alias(f"{against}_rows"),
        F.sum((F.col("t") > 0).cast("long")).alias("train_symbols"), F.sum((F.col("v") > 0).cast("long")).alias(f"{against}_symbols"))
    return g.where((F.col("train_rows") >= min_rows) & (F.col(f"{against}_rows") >= min_rows)
                   & (F.col("train_symbols") >= min_symbols) & (F.col(f"{against}_symbols") >= min_symbols))


def day_number(text: str) -> int:
    return (date.fromisoformat(text) - date(1970, 1, 1)) // timedelta(days=1)


# --- data sets ----------------------------------------------------------------------------------------


def feature_columns(df: DataFrame, prefixes: tuple[str, ...] = ("f__", "p__", "conf__")) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def numeric_features(df: DataFrame) -> DataFrame:
    """Feature columns as doubles with missing values as 0, other columns unchanged."""
    feats = set(feature_columns(df))
    return df.select(*[
        F.coalesce(F.col(f"`{c}`").cast("int").cast("double") if t == "boolean" else F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(c)
        if c in feats else F.col(f"`{c}`") for c, t in df.dtypes])


def next_return(f: Frame) -> Frame:
    nxt = f.lead("close")
    return f.with_cols(next_return=(nxt - F.col("close")) / F.nullif(F.col("close"), F.lit(0.0)))


def trim_to_window(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from the first day to the last second of the last day; a row without a time is an error."""
    inside = F.col("ts").between(day_number(start) * DAY_NS, (day_number(end) + 1) * DAY_NS - 10**9)
    return df.where(F.when(F.col("ts").isNull(), F.raise_error(F.lit("row without a time")).cast("boolean")).otherwise(inside))


def with_big_move_labels(df: DataFrame, n: int, atr: str, k: float, floor: float, atr_is_return: bool = False, max_rows: int | None = None) -> DataFrame:
    """A data set with forward return, threshold, big move and direction on its own rows: windows over the rows, so nothing is joined."""
    missing = {"symbol", "ts", "close", atr} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return big_move_labels(split_series(df, lookahead=n, max_rows=max_rows), n, atr, k, floor, atr_is_return).finish()


def feature_coverage(df: DataFrame, features: list[str], phase: str = "phase") -> DataFrame:
    """Non-null share of each feature in training and out of sample, and the gap, in one pass."""
    aggs = [F.avg(F.when(F.col(phase) == p, F.col(f"`{c}`").isNotNull().cast("double"))).alias(f"{p}|{c}")
            for p in ("train", "oos") for c in features]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`train|{c}`").alias("train_non_null"),
                              F.col(f"`oos|{c}`").alias("oos_non_null")) for c in features])
    return wide.select(F.inline(rows)).withColumn("abs_gap", F.abs(F.col("train_non_null") - F.col("oos_non_null")))


def class_weights(df: DataFrame, label: str = "label", mix: float = 1.0, lo: float = 0.1, hi: float = 10.0) -> DataFrame:
    """Balanced weights n / (classes * count), tempered by ``mix``, clipped, scaled to mean 1 over classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    balanced = F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
    counts = counts.withColumn("_w", F.least(F.greatest(F.pow(balanced, F.lit(mix)), F.lit(lo)), F.lit(hi)))
    return counts.select(label, "n", (F.col("_w") / F.avg("_w").over(w)).alias("weight"))


def focal_weights(df: DataFrame, label: str = "label", alpha: float = 1.0, gamma: float = 2.0) -> DataFrame:
    """alpha * (1 - class frequency) ^ gamma per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    freq = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("sample_weight", F.lit(alpha) * F.pow(1 - freq, F.lit(gamma)))


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "label", column: str = "weight") -> DataFrame:
    """Attach a per-class weight; one row per class bounds the broadcast."""
    return df.join(F.broadcast(weights.select(label, column)), label, "left")


def training_dataset(bars: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features joined to labels on (symbol, ts), columns in a fixed order."""
    df = features.join(labels.select("symbol", "ts", "label"), ["symbol", "ts"])
    return df.select("symbol", "ts", *sorted(feature_columns(df)), "label")


def time_text(ts: Column) -> Column:
    return F.date_format(event_time(ts), "yyyy-MM-dd")
