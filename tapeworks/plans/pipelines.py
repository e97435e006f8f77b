"""Whole jobs: signal variants over one feature table, learning data per phase, universe to evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import score_predictions
from ..operators import datasets, features_ml, labels, regime, screen, setops, signals, trades
from ..operators.features_core import core_pack
from ..operators.features_regime import regime_pack
from ..operators.joins import lookup_join
from ..operators.series import split_series
from ..sources.membership import membership_rows


def entry_variants(bars: DataFrame, variants: dict[str, dict], top_n: int = 20) -> DataFrame:
    """Signals of several parameter sets over one feature table: (variant, symbol, ts, signal, ...).

    A variant names its policy and parameters; the universe is the top symbols by relative volume per
    timestamp.
    """
    from ..registry import policy

    feats = core_pack(bars)
    universe = screen.top_per_time(feats.select("symbol", "ts", "f__vol__rel_volume_30"), "f__vol__rel_volume_30", top_n).select("ts", "symbol")
    rows = screen.in_universe(feats, universe)
    parts = []
    for name, spec in variants.items():
        params = {k: v for k, v in spec.items() if k != "policy"}
        parts.append(policy(spec["policy"])(rows, **params).withColumn("variant", F.lit(name)))
    return setops.union_all(parts)


def phase_dataset(bars: DataFrame, phases: dict[str, tuple[int, int]], cfg: labels.FirstHitConfig,
                  families: tuple[str, ...] = ("returns_trend", "price_momentum"), market: DataFrame | None = None,
                  market_cols: tuple[str, ...] = ()) -> DataFrame:
    """Features and labels of every phase in one plan; a row belongs to a phase by its day number."""
    src = bars
    if market is not None:
        src = features_ml.with_market(bars, market, market_cols)
    feats = features_ml.ml_pack(src, families)
    data = datasets.training_dataset(bars, feats, labels.first_hit_labels(bars, cfg))
    d = datasets.day_of()
    phase = F.lit(None).cast("string")
    for name, (lo, hi) in phases.items():
        phase = F.when(d.between(lo, hi), name).otherwise(phase)
    return data.withColumn("phase", phase).where(F.col("phase").isNotNull())


def phase_report(dataset: DataFrame, min_per_direction: int, min_total: int) -> DataFrame:
    """Label guard per (phase, symbol)."""
    keyed = dataset.select(F.concat_ws("|", "phase", "symbol").alias("symbol"), "label")
    g = screen.label_guard(keyed, min_per_direction, min_total)
    s = F.split("symbol", "\\|")
    return g.withColumns({"phase": F.lower(s[0]), "symbol": s[1]})


def universe_evaluation(bars: DataFrame, predictions: DataFrame, top_k: int, selection: trades.Selection, horizon: int = 1, cost: float = 0.0) -> DataFrame:
    """Shortlist every day, keep predictions of its symbols, and judge the selected trades per day."""
    from ..functions.timecols import session_date

    short = screen.premarket_shortlist(bars, top_k)
    days = bars.select("symbol", session_date("ts").alias("trade_date"))
    member = membership_rows(short, days).where("is_sip").select(F.to_date("trade_date").alias("trade_date"), "symbol")
    p = predictions.withColumn("trade_date", session_date("ts"))
    kept = lookup_join(p, member, ["trade_date", "symbol"], "left_semi").drop("trade_date")
    f = labels.forward_return(split_series(bars, lookahead=horizon), horizon, out="realized_return")
    realised = f.finish().where(F.col("realized_return").isNotNull())
    t = trades.trade_returns(trades.select_trades(score_predictions(kept), selection), realised, cost)
    return trades.daily_pnl(t)


def market_regime_by_segment(bars: DataFrame) -> DataFrame:
    """Bars to one market-wide regime per timestamp, held within each half day."""
    return regime.segment_signals(regime.classify_market(regime.cross_section_medians(regime_pack(bars))))


def gated_entries(predictions: DataFrame, thresholds: DataFrame, margin: float, min_expected_r: float, per_bar: int, per_symbol_day: int,
                  per_day: int) -> DataFrame:
    """Per-symbol calibrated gate followed by the entry caps."""
    df = lookup_join(predictions, thresholds.select("symbol", "prob_threshold_long", "prob_threshold_short", "min_directional_gap"), ["symbol"], "inner")
    gap, none = F.col("min_directional_gap"), F.lit(0.0)
    g = signals.ml_gate(df, F.col("prob_threshold_long"), F.col("prob_threshold_short"), gap, gap, none, none, margin, min_expected_r)
    return signals.rank_caps(g.where(F.col("reason").isNull()), per_bar, per_symbol_day, per_day)
