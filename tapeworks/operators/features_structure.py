"""Price structure: gaps, displacement legs, liquidity sweeps; order flow and its volume patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import div, flag, zero_to
from .features_core import add_atr, rel_volume
from .features_vpa import rank_share, recent
from .series import Frame, ema, split_series

TICK = 0.01


def add_fair_value_gaps(f: Frame) -> Frame:
    """State of the series' first bullish and first bearish gap.

    A gap is tracked from the bar that opens it until a later bar trades back into it; later gaps of the
    same direction are ignored, as the tracker upstream never unlocks.  Give a frame keyed by
    (symbol, session_date) to track the first gap of each session instead.
    """
    f = f.with_cols(_h2=f.lag("high", 2), _l2=f.lag("low", 2), _c1=f.lag("close", 1), _c2=f.lag("close", 2))
    h2, l2, c1, c2 = (F.col(x) for x in ("_h2", "_l2", "_c1", "_c2"))
    f = f.with_cols(
        _bull=F.when(flag((F.col("low") > h2) & (c1 > c2)), F.struct(F.col("low").alias("lo"), h2.alias("hi"))),
        _bear=F.when(flag((F.col("high") < l2) & (c1 < c2)), F.struct(l2.alias("lo"), F.col("high").alias("hi"))),
    )
    f = f.running({"_bg": ("first", F.col("_bull")), "_sg": ("first", F.col("_bear"))})
    bg, sg = F.col("_bg"), F.col("_sg")
    f = f.with_cols(
        _bfill=F.when(flag(F.col("low") <= bg["hi"]), F.lit(1)),
        _sfill=F.when(flag(F.col("high") >= sg["lo"]), F.lit(1)),
    )
    f = f.running({"_bdone": ("max", F.col("_bfill")), "_sdone": ("max", F.col("_sfill"))})
    bull = bg.isNotNull() & F.col("_bdone").isNull()
    bear = sg.isNotNull() & F.col("_sdone").isNull()
    return f.with_cols(
        f__ict__fvg_bull_active=bull, f__ict__fvg_bull_lower=F.when(bull, bg["lo"]),
        f__ict__fvg_bull_upper=F.when(bull, bg["hi"]),
        f__ict__fvg_bear_active=bear, f__ict__fvg_bear_lower=F.when(bear, sg["lo"]),
        f__ict__fvg_bear_upper=F.when(bear, sg["hi"]),
    ).drop("_h2", "_l2", "_c1", "_c2", "_bull", "_bear", "_bg", "_sg", "_bfill", "_sfill", "_bdone", "_sdone")


def add_displacement(f: Frame, atr_cut: float = 0.8, volume_cut: float = 1.0) -> Frame:
    """Last wide, heavy bar and the bands inside it.

    The volume test divides volume by relative volume, and the discount zone asks for a close above the
    0.79 band and below the 0.62 band; both are kept as upstream defines them.
    """
    wide = div(F.col("high") - F.col("low"), F.col("f__vol__atr_30")) >= atr_cut
    heavy = div(F.col("volume"), F.col("f__vol__rel_volume_30")) >= volume_cut
    leg = flag(wide & heavy)
    f = f.with_cols(_leg=F.when(leg, F.struct(F.col("high").alias("h"), F.col("low").alias("l"))))
    f = f.running({"_held": ("last", F.col("_leg"))})
    f = f.with_cols(f__ict__disp_high=F.col("_held")["h"], f__ict__disp_low=F.col("_held")["l"])
    hi, lo, close = F.col("f__ict__disp_high"), F.col("f__ict__disp_low"), F.col("close")
    rng = hi - lo
    f = f.with_cols(
        f__ict__pd_discount_top=lo + 0.62 * rng, f__ict__pd_discount_bottom=lo + 0.79 * rng,
        f__ict__pd_premium_bottom=hi - 0.62 * rng, f__ict__pd_premium_top=hi - 0.79 * rng,
    )
    return f.with_cols(
        f__ict__in_discount=flag(close.between(F.col("f__ict__pd_discount_bottom"), F.col("f__ict__pd_discount_top"))),
        f__ict__in_premium=flag(close.between(F.col("f__ict__pd_premium_bottom"), F.col("f__ict__pd_premium_top"))),
    ).drop("_leg", "_held")


def add_sweeps(f: Frame, n: int = 20, tight: float = 0.0002) -> Frame:
    """Break of a near-flat high or low that closes back inside; the swept level is held."""
    f = f.sums((n,), hi="high")
    ready = lambda fn, x: F.when(f.seen("hi", n) >= 10, fn(x).over(f.roll(n)))
    f = f.with_cols(_hx=ready(F.max, "high"), _hn=ready(F.min, "high"), _lx=ready(F.max, "low"), _ln=ready(F.min, "low")).drop_sums()
    # The window as of the previous row is the previous row's window.
    f = f.with_cols(_hm=f.lag("_hx"), _lm=f.lag("_ln"))
    spread = lambda hi, lo: (F.col(hi) - F.col(lo)) / F.greatest(F.col(hi), F.lit(1e-6))
    f = f.with_cols(_eh=flag(spread("_hx", "_hn") <= tight), _el=flag(spread("_lx", "_ln") <= tight))
    hm, lm, close = F.col("_hm"), F.col("_lm"), F.col("close")
    f = f.with_cols(
        f__ict__liq_sweep_high=F.col("_eh") & flag((F.col("high") > hm) & (close < hm)),
        f__ict__liq_sweep_low=F.col("_el") & flag((F.col("low") < lm) & (close > lm)),
    )
    f = f.running({
        "f__ict__liq_sweep_high_level": ("last", F.when(F.col("f__ict__liq_sweep_high"), hm)),
        "f__ict__liq_sweep_low_level": ("last", F.when(F.col("f__ict__liq_sweep_low"), lm)),
    })
    return f.drop("_eh", "_el", "_hm", "_lm", "_hx", "_hn", "_lx", "_ln")


def add_flow(f: Frame, absorb_range: float = 0.6, absorb_body: float = 0.25, climax_pct: float = 0.95,
             climax_range: float = 1.5, climax_wick: float = 0.5) -> Frame:
    """Order-flow imbalance and its volume patterns; wants f__vol__atr_30 and f__vol__atr_14."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    tr = h - lo
    safe = zero_to(tr, TICK)
    f = f.sums((20,), v="volume")
    f = f.with_cols(
        _ofi=(v * (c - o) / safe), _va=f.mean("v", 20, 5), _seen=recent(f, "volume", 50),
        _h1=f.lag("high"), _l1=f.lag("low"), _c1=f.lag("close"), _c3=f.lag("close", 3),
    )
    f = f.with_cols(_vr=rank_share("volume", "_seen", 20))
    va = F.col("_va")
    body, wick = F.abs(c - o), ((h - F.greatest(o, c)) + (F.least(o, c) - lo)) / safe
    heavy = v > 1.5 * va
    return f.with_cols(
        f__flow__ofi=F.col("_ofi") / 1e6,
        f__vpa__absorption=flag((v >= va) & (tr <= absorb_range * F.col("f__vol__atr_30")) & (body <= absorb_body * safe)),
        f__vpa__climax=flag((F.col("_vr") >= climax_pct) & (tr >= climax_range * F.col("f__vol__atr_14")) & (wick > climax_wick)),
        f__vpa__upthrust=flag(heavy & (c > o) & (c > F.col("_h1")) & (F.col("_ofi") > 0)),
        f__vpa__downthrust=flag(heavy & (c < o) & (c < F.col("_l1")) & (F.col("_ofi") < 0)),
        # Whatever branch the upstream test takes, it holds exactly when the three earlier closes moved.
        f__vpa__stopping_volume=flag((v > 2.0 * va) & (F.col("_c1") != F.col("_c3"))),
    ).drop("_va", "_vr", "_seen", "_h1", "_l1", "_c1", "_c3").drop_sums()


def add_flow_trend(f: Frame, span: int = 8) -> Frame:
    """Exponential mean of the imbalance; recursive, so it comes after every bounded window."""
    f = ema(f, "_ofi", span, "_trend")
    return f.with_cols(f__flow__ofi_trend=F.col("_trend") / 1e6).drop("_ofi", "_trend")


def add_stress_contraction(f: Frame, stress: str = "f__regime__stress_10_10") -> Frame:
    return f.with_cols(f__stress__contraction=flag((f.lag(stress) >= 1.0) & (F.col(stress) < 1.0)))


def structure_and_flow_pack(bars: DataFrame, atr_cut: float = 0.8, volume_cut: float = 1.0,
                            max_rows: int | None = None) -> DataFrame:
    """Gaps, displacement, sweeps, order flow and its trend over one shared exchange."""
    f = split_series(rel_volume(bars, 30), lookback=60, max_rows=max_rows, count_from=bars)
    f = add_atr(f, {"f__vol__atr_14": 14, "f__vol__atr_30": 30})
    f = add_fair_value_gaps(f)
    f = add_displacement(f, atr_cut, volume_cut)
    f = add_sweeps(f)
    f = add_flow(f)
    return add_flow_trend(f).finish()
