"""All enhanced features of a bar table in one chain of windows, without joins between feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features_structure as st
from ..operators.features_anchored import avwap_pack
from ..operators.features_core import add_atr, add_core, rel_volume
from ..operators.features_profile import add_profile
from ..operators.features_regime import add_regime_features
from ..operators.series import split_series


def enhanced_pack(bars: DataFrame, step: float = 0.1, profile_window: int = 100, atr_cut: float = 1.2, volume_cut: float = 1.3,
                  with_regime: bool = False, max_rows: int | None = None) -> DataFrame:
    """Core, anchored prices, profile, structure, flow and stress contraction.

    The profile crosses to Python, so it runs first while rows are narrow; the recursive flow trend runs
    last because it needs no neighbouring rows.
    """
    reach = max(profile_window + 20, 130)
    f = split_series(bars, lookback=reach, max_rows=max_rows)
    f = add_profile(f, step, profile_window)
    f = add_core(f, 30, 30, 30)
    f = add_atr(f, {"f__vol__atr_14": 14})
    if with_regime:
        f = st.add_stress_contraction(add_regime_features(f))
    df = avwap_pack(rel_volume(f.finish(), 30))
    f = split_series(df, lookback=60, max_rows=max_rows, count_from=bars)
    f = st.add_fair_value_gaps(f)
    f = st.add_displacement(f, atr_cut, volume_cut)
    f = st.add_sweeps(f)
    f = st.add_flow(f)
    out = st.add_flow_trend(f).finish()
    return out if with_regime else out.withColumn("f__stress__contraction", F.lit(False))
