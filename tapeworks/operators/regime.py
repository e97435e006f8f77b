"""Market-regime rules per symbol and market wide, session segments, hysteresis, and their monitoring."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mathcols import div, flag, pct_change
from ..functions.timecols import MINUTE_NS, day_half, session_date
from .series import Frame, split_series

# Integer codes of the regimes.
REGIME_CODES = {"BULL": 1, "BEAR": -1, "SIDEWAYS": 2, "STRESS": 3, "OFF": 0}
REGIMES = ("BULL", "BEAR", "SIDEWAYS", "STRESS", "OFF")

MOD_VOL, STRESS, VAR = "f__regime__mod_vol_30", "f__regime__stress_10_10", "f__regime__var_ratio_10_60"
ADX, BAND, WARM = "f__regime__adx_proxy_14", "f__regime__band_pos_20_2.0", "f__regime__warmup_ok"
CORE_INPUTS = (MOD_VOL, STRESS, VAR, ADX, BAND)
EXTRA_INPUTS = ("f__flow__ofi_trend", "f__ict__in_discount", "f__ict__in_premium", "f__profile__value_acceptance")


@dataclass(frozen=True)
class RegimeRules:
    """Thresholds and weights of the rules."""

    var_bull: float = 1.2
    var_bear: float = 0.8
    adx_trend: float = 20.0
    trend_confidence: float = 0.6
    stress_volatility: float = 2.0
    volatility_high: float = 1.6
    volatility_low: float = 0.8
    stress_confidence: float = 0.8
    band_low: float = 0.2
    band_high: float = 0.8
    sideways_confidence: float = 0.5
    var_weight: float = 0.4
    adx_weight: float = 0.3
    volatility_weight: float = 0.2
    flow_cut: float = 0.1
    extra_weight: float = 0.15
    persistence: int = 2
    cooldown_minutes: int = 15


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def _or(x: Column, default: float) -> Column:
    return F.coalesce(x, F.lit(float(default)))


def stress_score(r: RegimeRules, market: bool) -> Column:
    """Excess volatility (weighted down market wide) plus scaled direct stress."""
    excess = F.greatest(_or(q(MOD_VOL), 0.0) - r.stress_volatility, F.lit(0.0))
    return excess * (r.volatility_weight if market else 1.0) + _or(q(STRESS), 0.0) * r.stress_confidence


def base_trend_score(r: RegimeRules) -> Column:
    var, adx = _or(q(VAR), 1.0), _or(q(ADX), 25.0)
    by_var = F.when(var > r.var_bull, F.lit(r.var_weight)).when(var < r.var_bear, F.lit(-r.var_weight)).otherwise(F.lit(0.0))
    by_adx = F.when(adx >= r.adx_trend, (adx - r.adx_trend) / 50.0 * r.adx_weight).otherwise(F.lit(0.0))
    return by_var, by_adx


def _decide(score: Column, sideways: Column, r: RegimeRules) -> dict[str, Column]:
    strong = F.greatest(F.lit(r.trend_confidence), F.least(F.lit(1.0), F.abs(score)))
    regime = F.when(sideways, "SIDEWAYS").when(score > 0.3, "BULL").when(score < -0.3, "BEAR").otherwise("SIDEWAYS")
    trending = ~sideways & (F.abs(score) > 0.3)
    return {"_trend": regime, "_trend_conf": F.when(trending, strong).otherwise(F.lit(r.sideways_confidence))}


def classify_symbols(df: DataFrame, rules: RegimeRules | None = None) -> DataFrame:
    """Stress first, then trend, for every row on its own: adds regime and confidence."""
    r = rules or RegimeRules()
    by_var, by_adx = base_trend_score(r)
    df = df.withColumns({"_stress": stress_score(r, market=False), "trend_score": by_var + by_adx})
    inside = _or(q(BAND), 0.5).between(r.band_low, r.band_high)
    df = df.withColumns(_decide(F.col("trend_score"), inside & (F.abs("trend_score") < 0.3), r))
    hit = F.col("_stress") >= r.stress_confidence
    return df.withColumns({
        "regime": F.when(hit, "STRESS").otherwise(F.col("_trend")),
        "confidence": F.when(hit, F.least(F.lit(1.0), F.col("_stress"))).otherwise(F.col("_trend_conf")),
    }).drop("_stress", "_trend", "_trend_conf")


def cross_section_medians(df: DataFrame) -> DataFrame:
    """Median of every regime input over the warmed-up symbols of a timestamp.

    A group holds one row per symbol, so the exact median is bounded by the number of symbols.
    """
    present = [c for c in (*CORE_INPUTS, *EXTRA_INPUTS) if c in df.columns]
    warm = df.where(F.col(WARM)) if WARM in df.columns else df
    return warm.groupBy("ts").agg(
        F.count(F.lit(1)).alias("symbols"),
        *[F.percentile(q(c).cast("double"), 0.5).alias(c) for c in present])


def classify_market(medians: DataFrame, rules: RegimeRules | None = None) -> DataFrame:
    """Market-wide stress and trend per timestamp; a timestamp lacking a trend input is OFF."""
    r = rules or RegimeRules()
    by_var, by_adx = base_trend_score(r)
    score = F.lit(0.0)
    if "f__flow__ofi_trend" in medians.columns:
        flow = q("f__flow__ofi_trend")
        score = score + F.when(flow >= r.flow_cut, r.extra_weight).when(flow <= -r.flow_cut, -r.extra_weight).otherwise(0.0)
    for name, sign in (("f__ict__in_discount", 0.5), ("f__ict__in_premium", -0.5)):
        if name in medians.columns:
            score = score + F.when(flag(q(name) != 0), sign * r.extra_weight).otherwise(0.0)
    df = medians.withColumns({"stress_score": stress_score(r, market=True), "trend_score": score + by_var + by_adx})
    vol = _or(q(MOD_VOL), 1.0)
    normal = (vol < r.volatility_high) & (vol > r.volatility_low)
    sideways = _or(q(BAND), 0.5).between(r.band_low, r.band_high) & (F.abs("trend_score") < 0.3) & normal
    if "f__profile__value_acceptance" in medians.columns:
        sideways = sideways | (flag(q("f__profile__value_acceptance") >= 0.5) & (F.abs("trend_score") < 0.4))
    df = df.withColumns(_decide(F.col("trend_score"), sideways, r))
    complete = q(VAR).isNotNull() & q(ADX).isNotNull() & q(BAND).isNotNull()
    hit = F.col("stress_score") >= r.stress_confidence
    return df.withColumns({
        "regime": F.when(hit, "STRESS").when(~complete, "OFF").otherwise(F.col("_trend")),
        "confidence": F.when(hit, F.least(F.lit(1.0), F.col("stress_score"))).when(~complete, 0.0).otherwise(F.col("_trend_conf")),
    }).drop("_trend", "_trend_conf")


def segment_signals(market: DataFrame, key: str | None = None) -> DataFrame:
    """One decision per (date, half day): the first one stands until stress appears, stress then stays.

    Windows run over one half day of one key.
    """
    by = [*([key] if key else []), "session_date", "segment"]
    df = market.withColumns({"session_date": session_date("ts"), "segment": day_half("ts")})
    hist = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    now = F.struct("regime", "confidence")
    stressed = F.last(F.when(F.col("regime") == "STRESS", now), ignorenulls=True).over(hist)
    first = F.first(now).over(hist)
    df = df.withColumn("_s", F.coalesce(stressed, first))
    return df.withColumns({"regime": F.col("_s.regime"), "confidence": F.col("_s.confidence")}).drop("_s")


def first_decisions(signals: DataFrame, key: str | None = None) -> DataFrame:
    """The first row of each half day, which is what hysteresis runs on."""
    by = [*([key] if key else []), "session_date", "segment"]
    return signals.groupBy(*by).agg(
        F.min("ts").alias("ts"), F.min_by("regime", "ts").alias("regime"), F.min_by("confidence", "ts").alias("confidence"))


def hysteresis_step(state: dict, ts: int, regime: str, confidence: float, r: RegimeRules) -> tuple[dict, tuple]:
    """One decision through cooldown and persistence; returns the new state and (regime, confidence, count)."""
    last, counts = state["last"], dict(state["counts"])
    current = last[0] if last else "OFF"
    cooling = state["changed"] is not None and ts - state["changed"] < r.cooldown_minutes * MINUTE_NS
    if cooling and regime != current:
        return state, tuple(last) if last else ("OFF", 0.0, 0)
    counts[regime] = counts.get(regime, 0) + 1
    n = counts[regime]
    if n < r.persistence and current != "OFF" and last:
        return {**state, "counts": counts}, (last[0], last[1], n)
    changed = state["changed"]
    if regime != current:
        changed, counts = ts, {regime: n}
    result = (regime, confidence, n)
    return {"last": list(result), "changed": changed, "counts": counts}, result


NEW_STATE = {"last": None, "changed": None, "counts": {}}


def apply_hysteresis(decisions: DataFrame, key: str, rules: RegimeRules | None = None) -> DataFrame:
    """Persistence and cooldown per (key, segment), in time order.

    The input has one row per half day (``first_decisions``), so a group is as long as the history has
    days and one pandas pass per group is bounded.
    """
    r = rules or RegimeRules()
    schema = T.StructType([
        *[decisions.schema[c] for c in (key, "session_date", "segment", "ts")],
        T.StructField("raw_regime", T.StringType()), T.StructField("regime", T.StringType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("persistence_count", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        state, out = dict(NEW_STATE), []
        for ts, regime, conf in zip(pdf["ts"], pdf["regime"], pdf["confidence"], strict=True):
            state, res = hysteresis_step(state, int(ts), regime, float(conf), r)
            out.append(res)
        res = pd.DataFrame(out, columns=["regime", "confidence", "persistence_count"], index=pdf.index)
        return pdf[[key, "session_date", "segment", "ts"]].assign(raw_regime=pdf["regime"]).join(res)

    return decisions.groupBy(key, "segment").applyInPandas(run, schema)


def encode_state(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


# --- monitoring of a regime series (symbol, ts, regime, ...) ------------------------------------------


def _runs(signals: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Maximal runs of one regime per symbol: bars, start, start of the next run (NULL while open)."""
    f = split_series(signals.select("symbol", "ts", "regime"), lookback=1, lookahead=1, max_rows=max_rows)
    f = f.with_cols(_new=F.when(flag(f.lag("regime") == F.col("regime")), 0).otherwise(1), _next=f.lead("ts"))
    df = f.running({"run": ("sum", F.col("_new"))}).finish()
    runs = df.groupBy("symbol", "run", "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("start_ts"), F.max("_next").alias("_mx"), F.count("_next").alias("_cn"))
    return runs.withColumn("end_ts", F.when(F.col("_cn") == F.col("bars"), F.col("_mx"))).drop("_mx", "_cn")


def state_durations(signals: DataFrame) -> DataFrame:
    """Per regime: entries, exits, and lengths of finished runs in bars and minutes."""
    runs = _runs(signals)
    done = F.col("end_ts").isNotNull()
    minutes = F.floor((F.col("end_ts") - F.col("start_ts")) / MINUTE_NS)
    return runs.groupBy("regime").agg(
        F.count(F.lit(1)).alias("entry_count"), F.sum(done.cast("long")).alias("exit_count"),
        F.coalesce(F.sum(F.when(done, F.col("bars"))), F.lit(0)).alias("total_bars"),
        F.coalesce(F.sum(F.when(done, minutes)), F.lit(0)).cast("long").alias("total_minutes"),
        F.avg(F.when(done, F.col("bars"))).alias("avg_bars"),
        F.max(F.when(done, F.col("bars"))).alias("max_bars"), F.min(F.when(done, F.col("bars"))).alias("min_bars"),
        F.min("start_ts").alias("first_entry_ts"), F.max("end_ts").alias("last_exit_ts"))


def _with_previous(signals: DataFrame) -> Frame:
    f = split_series(signals.select("symbol", "ts", "regime"), lookback=1)
    return f.with_cols(prev=f.lag("regime"))


def transition_matrix(signals: DataFrame) -> DataFrame:
    """Counts of changes from one regime (row) to another (column)."""
    moves = _with_previous(signals).finish().where(F.col("prev").isNotNull() & (F.col("prev") != F.col("regime")))
    return moves.groupBy(F.col("prev").alias("from_regime")).pivot("regime", list(REGIMES)).count().na.fill(0).select(
        "from_regime", *[F.col(x).alias(f"to_{x}") for x in REGIMES])


def transition_summary(signals: DataFrame) -> DataFrame:
    """Per symbol: transitions, flips, continuations, stability, minutes between flips."""
    f = _with_previous(signals)
    flip = flag(F.col("prev") != F.col("regime"))
    f = f.with_cols(_flip=flip).running({"_at": ("last", F.when(flip, F.col("ts")))}, inclusive=False)
    gap = F.when(F.col("_flip") & F.col("_at").isNotNull(), F.floor((F.col("ts") - F.col("_at")) / MINUTE_NS))
    df = f.finish().withColumn("_gap", gap).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_transitions"), F.sum(F.col("_flip").cast("long")).alias("regime_flips"),
        F.sum(flag(F.col("prev") == F.col("regime")).cast("long")).alias("same_regime"),
        F.avg("_gap").alias("avg_minutes_between_flips"), F.max("_gap").alias("max_minutes_between_flips"),
        F.min("_gap").alias("min_minutes_between_flips"))
    return df.withColumns({
        "flips_per_hour": F.col("regime_flips") / F.greatest(F.col("total_transitions") / 60.0, F.lit(1.0)),
        "stability_ratio": F.col("same_regime") / F.col("total_transitions")})


def regime_performance(trades: DataFrame) -> DataFrame:
    """Per regime: trades, pnl, win rate, annualised mean over deviation, share of the total pnl."""
    g = trades.groupBy("regime").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("ret").alias("total_pnl"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.avg("ret").alias("avg_return"), F.stddev_pop("ret").alias("_sd"))
    total = F.sum("total_pnl").over(Window.partitionBy(F.lit(0)))  # one row per regime
    return g.withColumns({
        "sharpe": F.when(F.col("trades") > 1, F.col("avg_return") / (F.col("_sd") + 1e-8) * math.sqrt(252)),
        "attribution": F.when(total != 0, F.col("total_pnl") / F.abs(F.nullif(total, F.lit(0.0)))).otherwise(F.lit(0.0))}).drop("_sd")


def health_scores(signals: DataFrame, quality: float | None = None) -> DataFrame:
    """0.4 stability + 0.3 share of valid rows + 0.2 mean confidence + 0.1 share of regimes seen, per symbol."""
    f = split_series(signals, lookback=1)
    df = f.with_cols(_chg=flag(f.lag("regime") != F.col("regime")).cast("long")).finish()
    g = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("_chg").alias("changes"), F.avg("confidence").alias("mean_confidence"),
        F.countDistinct("regime").alias("regimes_seen"), F.avg((F.col("regime") != "OFF").cast("double")).alias("valid_share"))
    stability = 1.0 - F.least(F.col("changes") / F.col("bars"), F.lit(1.0))
    q_ = F.lit(quality) if quality is not None else F.col("valid_share")
    return g.withColumn("health", stability * 0.4 + q_ * 0.3 + F.col("mean_confidence") * 0.2 + F.col("regimes_seen") / 5.0 * 0.1)


def regime_distribution(signals: DataFrame) -> DataFrame:
    g = signals.groupBy("regime").agg(F.count(F.lit(1)).alias("bars"), F.avg("confidence").alias("mean_confidence"))
    return g.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy(F.lit(0))))  # five rows


def detector_statistics(signals: DataFrame) -> DataFrame:
    """Evaluations, changes and change rate per symbol."""
    g = _with_previous(signals).finish().groupBy("symbol").agg(
        F.count(F.lit(1)).alias("evaluations"), F.sum(flag(F.col("prev") != F.col("regime")).cast("long")).alias("changes"))
    return g.withColumn("change_rate", F.col("changes") / F.col("evaluations"))


# --- gates and checks ------------------------------------------------------------------------------


def strategy_gate(df: DataFrame, allowed: dict[str, list[str]], strategy: str = "strategy") -> DataFrame:
    """Adds ``allowed``: stress blocks everything, a regime without a list allows everything."""
    ok = F.lit(True)
    for regime, names in allowed.items():
        if names:
            ok = F.when(F.col("regime") == regime, F.col(strategy).isin(*names)).otherwise(ok)
    return df.withColumn("allowed", F.when(F.col("regime") == "STRESS", F.lit(False)).otherwise(ok))


def _fmt(prefix: str, x: Column, spec: str) -> Column:
    return F.concat(F.lit(prefix), F.format_string(spec, x))


def strategy_checks(df: DataFrame, enabled: list[str], side: str = "side") -> DataFrame:
    """First enabled check that passes, else every check's reason; adds strategy, detail, strategy_ok."""
    long = F.col(side) == "long"
    close, vwap = F.col("close"), F.col("f__anchor__session_avwap")
    other = "f__regime__current"
    fail: dict[str, Column] = {}

    def has(*names: str) -> bool:
        return all(n in df.columns for n in names)

    if "momentum" in enabled:
        var, adx, regime = q(VAR), q(ADX), F.upper(F.coalesce(F.col(other), F.lit("UNKNOWN")))
        ok_regime = F.when(long, regime.isin("BULL", "SIDEWAYS")).otherwise(regime.isin("BEAR", "SIDEWAYS"))
        fail["momentum"] = (
            F.when(~ok_regime, F.concat(F.lit("regime_mismatch:"), regime))
            .when(long & (var < 1.05), _fmt("variance_ratio_low:", var, "%.3f"))
            .when(~long & (var > 0.95), _fmt("variance_ratio_high:", var, "%.3f"))
            .when(adx < 18, _fmt("adx_low:", adx, "%.2f"))
            .when(long & (close <= vwap), F.lit("price_not_above_session_avwap"))
            .when(~long & (close >= vwap), F.lit("price_not_below_session_avwap")))
    if "pullback" in enabled:
        atr = F.col("f__vol__atr_14")
        dev = F.col("f__profile__value_deviation") if has("f__profile__value_deviation") else F.lit(0.0)
        room = F.coalesce(atr, F.lit(0.0))
        fail["pullback"] = (
            F.when(atr <= 0, F.lit("atr_non_positive"))
            .when(long & (close < vwap - room), F.lit("pullback_too_deep"))
            .when(~long & (close > vwap + room), F.lit("rally_too_extended"))
            .when((long & (dev < -2)) | (~long & (dev > 2)), _fmt("value_deviation_excess:", dev, "%.6f")))
    if "value_rotation" in enabled:
        poc = F.col("f__profile__poc")
        missing = poc.isNull() | F.col("f__profile__vah").isNull() | F.col("f__profile__val").isNull() | close.isNull()
        fail["value_rotation"] = (
            F.when(missing, F.lit("value_profile_unavailable"))
            .when(long & (close > poc), F.lit("price_not_below_poc"))
            .when(~long & (close < poc), F.lit("price_not_above_poc")))
    if "sweep_reversion" in enabled:
        swept = F.when(long, F.col("f__ict__liq_sweep_low")).otherwise(F.col("f__ict__liq_sweep_high"))
        flow = F.col("f__flow__ofi_trend")
        fail["sweep_reversion"] = (
            F.when(~flag(swept), F.when(long, "no_liquidity_sweep_low").otherwise("no_liquidity_sweep_high"))
            .when((long & (flow <= 0)) | (~long & (flow >= 0)), _fmt("ofi_not_supportive:", flow, "%.6f"))
            .when(~F.col("f__vpa__absorption"), F.lit("no_absorption")))
    unknown = set(enabled) - set(fail)
    if unknown:
        raise ValueError(f"unknown strategy checks: {sorted(unknown)}")
    if not fail:
        return df.withColumns({"strategy": F.lit("none"), "detail": F.lit("strategy_checks_disabled"), "strategy_ok": F.lit(True)})
    df = df.withColumns({f"_f_{n}": x for n, x in fail.items()})
    name, detail = F.lit("all_failed"), F.concat_ws(";", *[F.concat(F.lit(f"{n}:"), F.col(f"_f_{n}")) for n in fail])
    ok = F.lit(False)
    for n in reversed(list(fail)):
        passed = F.col(f"_f_{n}").isNull()
        name = F.when(passed, n).otherwise(name)
        detail = F.when(passed, f"{n}_valid").otherwise(detail)
        ok = passed | ok
    return df.withColumns({"strategy": name, "detail": detail, "strategy_ok": ok}).drop(*[f"_f_{n}" for n in fail])


def regime_code(regime: Column) -> Column:
    code = F.lit(None).cast("int")
    for name, value in REGIME_CODES.items():
        code = F.when(regime == name, F.lit(value)).otherwise(code)
    return code


def attach_regime_code(bars: DataFrame, market_signals: DataFrame) -> DataFrame:
    """Market-wide regime of the timestamp as an integer on every bar, 0 where there is none."""
    codes = market_signals.select("ts", regime_code(F.col("regime")).alias("regime_code"))
    return bars.join(codes, "ts", "left").withColumn("regime_code", F.coalesce("regime_code", F.lit(0)))


def trend_volatility_regime(f: Frame, periods: tuple[int, ...] = (10, 20, 50), trend_cut: float = 0.02,
                            vol_cut: float = 0.015, volume_cut: float = 1.2) -> Frame:
    """Alternative classifier from weighted multi-period trend, recent deviation and volume ratio."""
    close = F.col("close")
    f = f.with_cols(_r=pct_change(close, f.lag("close")), _n=F.count(F.lit(1)).over(f.roll(max(max(periods), 21))))
    weight = sum(range(1, len(periods) + 1))
    trend = F.lit(0.0)
    for i, p in enumerate(periods):
        trend = trend + pct_change(close, f.lag("close", p - 1)) * ((i + 1) / weight)
    sd = F.coalesce(f.agg(F.stddev_pop, "_r", 20), F.lit(0.0))
    # Mean of the 19 volumes before the current one once 21 bars exist; a 20-bar history uses all of it.
    base = F.avg("volume").over(f.prior(19))
    f = f.with_cols(
        trend_signal=trend,
        volatility_signal=F.when(sd > vol_cut * 2, 2.0).when(sd > vol_cut, 1.0).otherwise(0.0),
        volume_signal=F.when(flag(div(F.col("volume"), base) > volume_cut), 1.0).otherwise(0.0))
    t, v, u = F.col("trend_signal"), F.col("volatility_signal"), F.col("volume_signal")
    known = F.col("_n") >= max(periods)
    regime = (F.when(~known, "SIDEWAYS").when(t > trend_cut, "TRENDING_UP").when(t < -trend_cut, "TRENDING_DOWN")
              .when(v > 1.0, "VOLATILE").when((v < 0.5) & (u < 0.5), "QUIET").otherwise("SIDEWAYS"))
    conf = (F.when(regime.startswith("TRENDING"), F.least(F.lit(1.0), F.abs(t) / trend_cut))
            .when(regime == "VOLATILE", F.least(F.lit(1.0), v / 2.0)).otherwise(F.lit(0.5)))
    return f.with_cols(alt_regime=regime, alt_confidence=conf).drop("_r", "_n")


def threshold_regimes(df: DataFrame) -> DataFrame:
    """Plain threshold classification of rows whose five inputs are all known."""
    ready = df.where(F.forall(F.array(*[q(c).isNotNull() for c in CORE_INPUTS]), lambda x: x))
    return ready.withColumn("regime", F.when((q(STRESS) > 0) | (q(MOD_VOL) >= 2.0), "STRESS")
                            .when((q(VAR) > 1.2) & (q(ADX) >= 25), "BULL").when((q(VAR) < 0.8) & (q(ADX) >= 25), "BEAR")
                            .when((F.abs(q(VAR) - 1.0) <= 0.1) | (q(ADX) < 22), "SIDEWAYS").otherwise("NONE"))


def valid_shares(df: DataFrame) -> DataFrame:
    """Share of rows with a value, and range, per regime input: one pass, then one row per input."""
    parts = []
    for c in CORE_INPUTS:
        parts.append(F.struct(F.lit(c).alias("feature"), F.avg(q(c).isNotNull().cast("double")).alias("valid_share"),
                              F.min(q(c)).alias("low"), F.max(q(c)).alias("high"), F.avg(q(c)).alias("mean")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def compare_with_without(runs: DataFrame) -> DataFrame:
    """Runs with the regime filter against their run without it: differences of return, Sharpe, drawdown."""
    on, off = runs.where("regime_on"), runs.where("not regime_on")
    j = on.alias("a").join(off.alias("b"), F.col("a.run") == F.col("b.run"))
    return j.select(F.col("a.run").alias("run"), *[
        (F.col(f"a.{m}") - F.col(f"b.{m}")).alias(f"{m}_change") for m in ("total_return", "sharpe", "max_drawdown", "trades")])
