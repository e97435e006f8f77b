"""Volume-price patterns: a boolean ``p__vpa__*`` and a confidence ``conf__vpa__*`` in [0, 1] per pattern.

All windows are per symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import clip, div, flag
from .series import Frame, split_series

INF = float("inf")


def recent(f: Frame, x: str, n: int) -> Column:
    """The last n non-missing values as a list: n bounds its length."""
    return F.collect_list(x).over(f.roll(n))


def rank_share(x: str, values: str, need: int) -> Column:
    """Average rank of the current value within the list column ``values``, as a share of its length."""
    cur, seen = F.col(x), F.col(values)
    below = F.size(F.filter(seen, lambda v: v < cur))
    same = F.size(F.filter(seen, lambda v: v == cur))
    n = F.size(seen)
    return F.when((n >= need) & cur.isNotNull(), (below + (same + 1) / 2.0) / n)


def growth(x: Column, prev: Column) -> Column:
    """Relative change with growth from zero as infinity and 0 -> 0 missing."""
    return F.when(prev == 0, F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF))).otherwise(div(x - prev, prev))


def add_vpa(f: Frame, spike: float = 2.0, breakout_n: int = 20, absorb_n: int = 5, climax: float = 0.95) -> Frame:
    high, low, close, volume = (F.col(c) for c in ("high", "low", "close", "volume"))
    f = f.sums({20, breakout_n}, v="volume", h="high")
    f = f.with_cols(
        _va=f.mean("v", 20, 10),
        _hx=F.when(f.seen("h", breakout_n) >= 10, F.max("high").over(f.roll(breakout_n))),
        _ln=F.when(f.seen("h", breakout_n) >= 10, F.min("low").over(f.roll(breakout_n))),
        _c1=f.lag("close"), _v1=f.lag("volume"), _body=F.abs(close - F.col("open")),
    )
    f = f.with_cols(_pc=growth(close, F.col("_c1")), _vc=growth(volume.cast("double"), F.col("_v1").cast("double")))
    f = f.with_cols(_ph=f.lag("_hx"), _pl=f.lag("_ln"))
    f = f.with_cols(_ratio=div(volume, F.col("_va")), _vpr=volume / (F.col("_body") + 1e-8))
    f = f.sums({absorb_n, 20}, b="_body")
    f = f.with_cols(
        _bodyavg=f.mean("b", absorb_n, 3),
        _q80=F.when(f.seen("b", 20) >= 10, F.percentile("_vpr", 0.8).over(f.roll(20))),
        _lp=recent(f, "_vpr", 50), _lv=recent(f, "volume", 50),
    )
    f = f.with_cols(_vprank=rank_share("_vpr", "_lp", 20), _vrank=rank_share("volume", "_lv", 20))
    ratio = F.col("_ratio")
    up, down = flag(close > F.col("_ph")), flag(close < F.col("_pl"))
    width = F.col("_ph") - F.col("_pl")
    excess = F.when(up, close - F.col("_ph")).when(down, F.col("_pl") - close).otherwise(F.lit(0.0))
    # A breakout out of a zero-width range is infinitely strong, i.e. confidence 1.
    strength = F.when((up | down) & (width == 0), F.lit(1.0)).when(up | down, clip(div(excess, width) * 2, 0, 1))
    pc, vc = F.col("_pc"), F.col("_vc")
    magnitude = F.when(F.abs(vc) == INF, F.when(pc != 0, F.lit(INF))).otherwise(F.abs(pc) * F.abs(vc))
    f = f.with_cols(
        p__vpa__volume_spike=flag(ratio > spike),
        conf__vpa__volume_spike=clip((ratio - 1.0) / (spike - 1.0), 0, 1),
        p__vpa__price_breakout=up | down,
        conf__vpa__price_breakout=F.coalesce(strength, F.lit(0.0)),
        p__vpa__volume_divergence=flag((pc > 0) & (vc < -0.1)) | flag((pc < 0) & (vc > 0.1)),
        conf__vpa__volume_divergence=clip(magnitude * 5, 0, 1),
        p__vpa__absorption=flag(F.col("_vpr") > F.col("_q80")) & flag(F.col("_body") < F.col("_bodyavg") * 0.5)
        & flag(volume > F.col("_va")),
        conf__vpa__absorption=clip((F.col("_vprank") - 0.8) * 5, 0, 1),
        p__vpa__climax=flag(F.col("_vrank") > climax),
        conf__vpa__climax=clip((F.col("_vrank") - climax) / (1.0 - climax), 0, 1),
    )
    return f.drop("_c1", "_v1", "_hx", "_ln", "_va", "_ph", "_pl", "_pc", "_vc", "_body", "_ratio", "_vpr", "_bodyavg", "_q80", "_vprank", "_vrank", "_lp", "_lv").drop_sums()


def vpa_pack(bars: DataFrame, max_rows: int | None = None, **params: float) -> DataFrame:
    reach = int(params.get("breakout_n", 20) + params.get("absorb_n", 5)) + 60  # each window's row may need the other windows' rows
    return add_vpa(split_series(bars, lookback=reach, max_rows=max_rows), **params).finish()
