"""Inputs of the regime rules: normalised volatility, variance ratio, trend strength, band position, stress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import clip, div, flag, pct_change, zero_to
from ..functions.timecols import utc_minute
from .features_core import true_range
from .series import Frame, split_series


def _with_range(f: Frame, windows: set[int]) -> Frame:
    f = f.with_cols(_tr=true_range(f))
    tr = F.col("_tr")
    f = f.with_cols(_vol=div(tr, F.col("close")), _tod=utc_minute("ts"))
    return f.sums(windows, tr="_tr", rel="_vol", v="volume", close="close")


def mod_volatility(f: Frame, n: int = 30, mp: int = 5) -> Frame:
    """Rolling relative range over its own past mean at this minute of the day.

    The past mean uses earlier rows only; before the minute was ever seen, the symbol's past mean stands
    in.  That leaves just the first row of a symbol without a value, so no forward fill is needed.
    """
    f = f.with_cols(_rv=f.mean("rel", n, mp))
    # decimal sums are exact, so the mean of the whole past doesn't depend on where a long series is cut
    vol = F.col("_vol").try_cast("decimal(38,20)")
    f = f.running({"_ts": ("sum", vol), "_tc": ("count", vol)}, extra=("_tod",), inclusive=False)
    f = f.running({"_ss": ("sum", vol), "_sc": ("count", vol)}, inclusive=False)
    base = F.coalesce(*(div(F.col(s).cast("double"), F.col(n)) for s, n in (("_ts", "_tc"), ("_ss", "_sc"))))
    return f.with_cols(**{f"f__regime__mod_vol_{n}": div(F.col("_rv"), base)}).drop("_rv", "_ts", "_tc", "_ss", "_sc")


def variance_ratio(f: Frame, short: int = 10, long: int = 60, mp: int = 3) -> Frame:
    f = f.with_cols(_pc=f.lag("close"))
    f = f.with_cols(_ret=pct_change(F.col("close"), F.col("_pc")))
    f = f.sums((short, long), ret="_ret")
    var = lambda n: F.when(f.seen("ret", n) >= mp, F.var_samp("_ret").over(f.roll(n)))
    f = f.with_cols(_vshort=var(short), _vlong=var(long))
    s, lo = F.col("_vshort"), F.col("_vlong")
    ratio = F.when(lo > 0, div(s, lo)).otherwise(F.lit(1.0))
    return f.with_cols(**{f"f__regime__var_ratio_{short}_{long}": clip(ratio, 0.1, 10.0)}).drop("_pc", "_ret", "_vshort", "_vlong")


def adx_proxy(f: Frame, n: int = 14, mp: int = 3) -> Frame:
    """Directional index from plain rolling means, then its rolling mean (two passes over one sort)."""
    f = f.with_cols(_up=F.col("high") - f.lag("high"), _down=f.lag("low") - F.col("low"))
    up, down = F.col("_up"), F.col("_down")
    f = f.with_cols(
        _pdm=F.when(flag((up > down) & (up > 0)), up).otherwise(F.lit(0.0)),
        _mdm=F.when(flag((down > up) & (down > 0)), down).otherwise(F.lit(0.0)),
    )
    f = f.sums((n,), pdm="_pdm", mdm="_mdm")
    tr = zero_to(f.mean("tr", n, mp), 1.0)
    plus = F.lit(100.0) * (f.mean("pdm", n, mp) / tr)
    minus = F.lit(100.0) * (f.mean("mdm", n, mp) / tr)
    f = f.with_cols(_pdi=plus, _mdi=minus)
    pdi, mdi = F.col("_pdi"), F.col("_mdi")
    f = f.with_cols(_dx=F.lit(100.0) * F.abs(pdi - mdi) / zero_to(pdi + mdi, 1.0))
    f = f.sums((n,), dx="_dx")
    return f.with_cols(**{f"f__regime__adx_proxy_{n}": f.mean("dx", n, mp)}).drop(
        "_up", "_down", "_pdm", "_mdm", "_pdi", "_mdi", "_dx"
    )


def band_position(f: Frame, n: int = 20, k: float = 2.0, mp: int = 5) -> Frame:
    f = f.with_cols(_ma=f.mean("close", n, mp), _sd=F.when(f.seen("close", n) >= mp, F.stddev_samp("close").over(f.roll(n))))
    lower, upper = F.col("_ma") - F.col("_sd") * k, F.col("_ma") + F.col("_sd") * k
    pos = (F.col("close") - lower) / zero_to(upper - lower, 1.0)
    return f.with_cols(**{f"f__regime__band_pos_{n}_{k}": clip(pos, -0.5, 1.5)}).drop("_ma", "_sd")


def stress(f: Frame, vol_n: int = 10, volume_n: int = 10, vol_cut: float = 2.0, volume_cut: float = 3.0,
           mp: int = 3) -> Frame:
    """Largest excess of recent volatility or volume over its own longer mean, once above the cuts."""
    a = div_zero_one(f.mean("rel", vol_n, mp), f.mean("rel", max(vol_n * 6, 30), mp))
    b = div_zero_one(f.mean("v", volume_n, mp), f.mean("v", max(volume_n * 6, 30), mp))
    f = f.with_cols(_vs=a, _ws=b)
    va = F.when(F.col("_vs") >= vol_cut, F.col("_vs") - 1).otherwise(F.lit(0.0))
    vb = F.when(F.col("_ws") >= volume_cut, F.col("_ws") - 1).otherwise(F.lit(0.0))
    score = F.when(F.col("_vs").isNotNull() & F.col("_ws").isNotNull(), clip(F.greatest(va, vb), 0.0, 10.0))
    return f.with_cols(**{f"f__regime__stress_{vol_n}_{volume_n}": score}).drop("_vs", "_ws")


def div_zero_one(a, b):
    return a / zero_to(b, 1.0)


def add_regime_features(f: Frame, vol_n: int = 30, short: int = 10, long: int = 60, adx_n: int = 14,
                        band_n: int = 20, band_k: float = 2.0, stress_n: int = 10,
                        vol_cut: float = 2.0, volume_cut: float = 3.0) -> Frame:
    f = _with_range(f, {vol_n, adx_n, band_n, stress_n, max(stress_n * 6, 30)})
    f = mod_volatility(f, vol_n)
    f = variance_ratio(f, short, long)
    f = adx_proxy(f, adx_n)
    f = band_position(f, band_n, band_k)
    f = stress(f, stress_n, stress_n, vol_cut, volume_cut)
    warm = max(vol_n, long, adx_n, band_n)
    f = f.with_cols(f__regime__warmup_ok=f.has_rows(warm))
    return f.drop("_tr", "_vol", "_tod").drop_sums()


# Windows and cuts of the named variants.
VARIANTS = {
    "basics": {"vol_n": 30, "short": 10, "long": 60, "adx_n": 14, "band_n": 20, "stress_n": 10,
               "vol_cut": 2.0, "volume_cut": 3.0},
    "fast": {"vol_n": 15, "short": 5, "long": 30, "adx_n": 7, "band_n": 10, "stress_n": 5,
             "vol_cut": 1.5, "volume_cut": 2.0},
    "slow": {"vol_n": 60, "short": 20, "long": 120, "adx_n": 28, "band_n": 40, "stress_n": 20,
             "vol_cut": 2.5, "volume_cut": 3.5},
}


def regime_pack(bars: DataFrame, variant: str = "basics", max_rows: int | None = None,
                count_from: DataFrame | None = None) -> DataFrame:
    p = VARIANTS[variant]
    reach = max(p["vol_n"], p["long"], p["stress_n"] * 6, 30, 2 * p["adx_n"]) + 2
    return add_regime_features(split_series(bars, lookback=reach, max_rows=max_rows, count_from=count_from), **p).finish()
