"""Volume-weighted price, relative volume, true range and the core pack.

Windows called "minutes" upstream are row counts; they are ROWS frames here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import div_or, zero_to
from ..functions.timecols import utc_minute
from .series import Frame, split_series


def true_range(f: Frame, signed: bool = False) -> Column:
    """Range including the gap from the previous close; ``signed`` keeps the core pack's signed gaps."""
    prev = f.lag("close")
    up, down = F.col("high") - prev, F.col("low") - prev
    if not signed:
        up, down = F.abs(up), F.abs(down)
    return F.greatest(F.col("high") - F.col("low"), up, down)


def _vwap(f: Frame, n: int) -> Column:
    vol = f.total("vol", n, 1)
    return F.when(vol > 0, f.total("pv", n, 1) / F.nullif(vol, F.lit(0))).otherwise(F.col("close"))


def _price_volume(f: Frame) -> dict[str, Column]:
    return {"pv": F.col("close") * F.col("volume"), "vol": F.col("volume")}


def add_vwap(f: Frame, windows: dict[str, int]) -> Frame:
    """Rolling volume-weighted close per output name; the close itself where nothing traded."""
    f = f.sums(windows.values(), **_price_volume(f))
    return f.with_cols(**{out: _vwap(f, n) for out, n in windows.items()}).drop_sums()


def add_atr(f: Frame, windows: dict[str, int], signed_range: bool = False) -> Frame:
    """Rolling mean of the true range per output name."""
    f = f.with_cols(_range=true_range(f, signed_range)).sums(windows.values(), tr="_range")
    return f.with_cols(**{out: f.mean("tr", n, 1) for out, n in windows.items()}).drop("_range").drop_sums()


def warmed_up(frame: Frame, n: int) -> Frame:
    """f__warmup_ok: at least n earlier rows exist, whatever segment they fell into."""
    return frame.with_cols(f__warmup_ok=frame.has_rows(max(n, 1)))


def rel_volume(bars: DataFrame, n: int = 30) -> DataFrame:
    """Volume over the mean volume of the same symbol at the same minute of the day."""
    tod = utc_minute("ts").alias("_tod")
    mean = bars.groupBy("symbol", tod).agg(F.avg("volume").alias("_tod_mean"))
    return _divide(bars.withColumn("_tod", utc_minute("ts")).join(mean, ["symbol", "_tod"]), n)


def tod_volume_profile(bars: DataFrame) -> DataFrame:
    """Minute of day -> mean over symbols of the per-symbol mean volume (at most 1440 rows)."""
    per_symbol = bars.groupBy("symbol", utc_minute("ts").alias("_tod")).agg(F.avg("volume").alias("m"))
    return per_symbol.groupBy("_tod").agg(F.avg("m").alias("_tod_mean"))


def rel_volume_market(bars: DataFrame, n: int = 30) -> DataFrame:
    """Volume over the cross-symbol mean for the minute of the day (the core pack's form)."""
    # 1440 minutes a day bound the right side whatever the data size.
    profile = F.broadcast(tod_volume_profile(bars))
    return _divide(bars.withColumn("_tod", utc_minute("ts")).join(profile, "_tod"), n)


def _divide(df: DataFrame, n: int) -> DataFrame:
    value = F.coalesce(div_or(F.col("volume"), zero_to(F.col("_tod_mean"), 1.0), F.lit(1.0)), F.lit(1.0))
    return df.withColumn(f"f__vol__rel_volume_{n}", value.cast("double")).drop("_tod", "_tod_mean")


def add_core(f: Frame, vwap_n: int, atr_n: int, warm_n: int, signed_range: bool = False) -> Frame:
    f = f.with_cols(_range=true_range(f, signed_range)).sums((vwap_n, atr_n), tr="_range", **_price_volume(f))
    return f.with_cols(**{
        f"f__ta__vwap_{vwap_n}": _vwap(f, vwap_n), f"f__vol__atr_{atr_n}": f.mean("tr", atr_n, 1), "f__warmup_ok": f.has_rows(max(warm_n, 1)),
    }).drop("_range").drop_sums()


def core_pack(bars: DataFrame, vwap_n: int = 30, rvol_n: int = 30, atr_n: int = 30,
              signed_range: bool = False, max_rows: int | None = None) -> DataFrame:
    """VWAP, relative volume, ATR and the warm-up flag: one exchange and one sort for all windows."""
    widest = max(vwap_n, rvol_n, atr_n)
    with_rvol = rel_volume_market(bars, rvol_n)
    frame = split_series(with_rvol, lookback=widest + 1, max_rows=max_rows, count_from=bars)
    return add_core(frame, vwap_n, atr_n, widest, signed_range).finish()
