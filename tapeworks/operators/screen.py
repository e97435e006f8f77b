"""Universe selection: screens, per-time and per-day shortlists, minute gating, guards and diagnostics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathcols import div, flag
from ..functions.timecols import SECOND_NS, event_time, in_regular_hours, market_time, session_date
from .features_core import rel_volume
from .joins import attach_one_row
from .quantiles import exact_percentiles


@dataclass(frozen=True)
class ScreenConfig:
    top_n: int = 20
    min_price: float = 5.0
    max_price: float = 500.0
    min_relative_volume: float = 1.0
    min_dollar_volume: float = 1_000_000.0
    exclude: tuple[str, ...] = field(default=())


def with_relative_volume(bars: DataFrame) -> DataFrame:
    return rel_volume(bars, 30).withColumnRenamed("f__vol__rel_volume_30", "relative_volume")


def avg_daily_dollar_volume(bars: DataFrame) -> DataFrame:
    daily = bars.groupBy("symbol", F.to_date(event_time("ts")).alias("trade_date")).agg(
        F.sum(F.col("close") * F.col("volume")).alias("dv"))
    return daily.groupBy("symbol").agg(F.avg("dv").alias("avg_daily_dollar_volume"))


def latest_rows(df: DataFrame) -> DataFrame:
    """Last row per symbol by aggregation (combined map side, no sort of whole histories)."""
    rest = [c for c in df.columns if c != "symbol"]
    top = df.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("_r"))
    return top.select("symbol", *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_with_metrics(bars: DataFrame, reference_ts: int | None = None) -> DataFrame:
    if reference_ts is not None:
        bars = bars.where(F.col("ts") <= F.lit(reference_ts))
    return latest_rows(with_relative_volume(bars)).join(avg_daily_dollar_volume(bars), "symbol", "left")


def passes_filters(cfg: ScreenConfig):
    ok = (
        F.col("close").between(cfg.min_price, cfg.max_price)
        & (F.col("relative_volume") >= cfg.min_relative_volume)
        & (F.coalesce("avg_daily_dollar_volume", F.lit(0.0)) >= cfg.min_dollar_volume)
    )
    return flag(ok & ~F.col("symbol").isin(*cfg.exclude)) if cfg.exclude else flag(ok)


def screen_universe(bars: DataFrame, cfg: ScreenConfig, reference_ts: int | None = None) -> DataFrame:
    """Filtered symbols ranked by relative volume, best ``top_n`` (ties by symbol)."""
    kept = latest_with_metrics(bars, reference_ts).where(passes_filters(cfg))
    top = kept.withColumn("dollar_volume", F.col("close") * F.col("volume")).orderBy(
        F.col("relative_volume").desc(), "symbol").limit(cfg.top_n)
    # The rank of a selected symbol depends on selected symbols only, so it is computed on top_n rows.
    w = Window.orderBy(F.col("relative_volume").desc())
    return top.withColumn("rvol_rank", F.rank().over(w).cast("double"))


def top_per_time(df: DataFrame, by: str, n: int, whitelist: DataFrame | None = None) -> DataFrame:
    """Top n symbols of every timestamp; the whitelist is applied after the cut."""
    w = Window.partitionBy("ts").orderBy(F.col(by).desc_nulls_last(), F.col("symbol"))
    top = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(whitelist, "symbol", "left_semi") if whitelist is not None else top


def symbol_stats(bars: DataFrame) -> DataFrame:
    """Median close, mean daily dollar volume and number of days per symbol."""
    med = exact_percentiles(bars, ["symbol"], "close", {"median_close": 0.5})
    daily = bars.groupBy("symbol", F.to_date(event_time("ts")).alias("d")).agg(F.sum(F.col("close") * F.col("volume")).alias("dv"))
    return daily.groupBy("symbol").agg(
        F.avg("dv").alias("mean_daily_dv"), F.count(F.lit(1)).alias("days")).join(med, "symbol")


def eligible_symbols(stats: DataFrame, min_price: float, max_price: float, min_dv: float, min_days: int) -> DataFrame:
    return stats.where(
        F.col("median_close").between(min_price, max_price) & (F.col("mean_daily_dv") >= min_dv) & (F.col("days") >= min_days))


def premarket_metrics(bars: DataFrame, fallback_minutes: int = 20, lookback_days: int = 5) -> DataFrame:
    """One row per (session, symbol): gap to the previous close and premarket dollar volume.

    All sessions are answered in one aggregation.  A session in which no symbol traded before the open uses
    its first ``fallback_minutes`` minutes instead.
    """
    t = market_time("ts")
    h, m = F.hour(t), F.minute(t)
    pre = (h >= 4) & ((h < 9) | ((h == 9) & (m < 30)))
    proxy = (h == 9) & (m >= 30) & (m < 30 + fallback_minutes)
    # The opening and closing prices upstream come from whole hours, 9 to 15 and 9 to 16.
    opened, closed = (h >= 9) & (h < 16), (h >= 9) & (h <= 16)
    ts = F.col("ts")
    daily = bars.groupBy("symbol", session_date("ts").alias("trade_date")).agg(
        F.max_by("close", F.when(pre, ts)).alias("_pc"), F.sum(F.when(pre, F.col("volume"))).alias("_pv"),
        F.max_by("close", F.when(proxy, ts)).alias("_xc"), F.sum(F.when(proxy, F.col("volume"))).alias("_xv"),
        F.min_by("open", F.when(opened, ts)).alias("open"), F.max_by("close", F.when(closed, ts)).alias("_last"),
    )
    by_day = Window.partitionBy("trade_date")
    back = Window.partitionBy("symbol").orderBy(F.unix_date("trade_date")).rangeBetween(-lookback_days, -1)
    has_pre = F.max(F.col("_pv").isNotNull()).over(by_day)
    daily = daily.withColumns({
        "prev_close": F.last("_last", ignorenulls=True).over(back), "_has": has_pre,
    })
    close = F.when(F.col("_has"), F.col("_pc")).otherwise(F.col("_xc"))
    vol = F.when(F.col("_has"), F.col("_pv")).otherwise(F.col("_xv"))
    out = daily.select("trade_date", "symbol", "open", "prev_close", (close * vol).alias("premarket_dv")).where(
        F.col("premarket_dv").isNotNull() & F.col("open").isNotNull() & (F.col("prev_close") > 0))
    return out.withColumn("gap_pct", (F.col("open") - F.col("prev_close")) / F.col("prev_close"))


def cross_z(x, day: Window):
    sd = F.stddev_samp(x).over(day)
    return F.when(sd == 0, F.lit(0.0)).otherwise(div(x - F.avg(x).over(day), sd))


def premarket_shortlist(bars: DataFrame, top_k: int = 10, score_floor: float = 0.0) -> DataFrame:
    """Score 0.6 z(premarket dollar volume) + 0.4 z(absolute gap) within the day; best top_k per day."""
    day = Window.partitionBy("trade_date")
    df = premarket_metrics(bars)
    df = df.withColumn("score", 0.6 * cross_z(F.col("premarket_dv"), day) + 0.4 * cross_z(F.abs("gap_pct"), day))
    if score_floor > 0:
        df = df.where(F.col("score") >= score_floor)
    w = day.orderBy(F.col("score").desc_nulls_last(), "symbol")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def external_shortlist(scores: DataFrame, top_k: int, floor: float = 0.0, symbol: str = "sym") -> DataFrame:
    """Shortlist from an external (date, sym, score) table."""
    w = Window.partitionBy("trade_date").orderBy(F.col("score").desc(), F.upper(symbol))
    return scores.where(F.col("score") >= floor).select(
        "trade_date", F.upper(symbol).alias("symbol"), "score", F.row_number().over(w).alias("rank")
    ).where(F.col("rank") <= top_k)


def broadcast_universe(bars: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(ts, symbol): every regular-hours timestamp of a day with every shortlisted symbol of that day.

    Timestamps are those of any symbol; a day has at most 390 of them and top_k symbols.
    """
    times = bars.where(in_regular_hours("ts")).select(session_date("ts").alias("trade_date"), "ts").distinct()
    return times.join(shortlist.select("trade_date", "symbol"), "trade_date").select("ts", "symbol")


def minute_gate(bars: DataFrame, shortlist: DataFrame, p_hat: DataFrame, threshold: float, minutes: int = 0,
                readings: int | None = None) -> DataFrame:
    """Shortlisted (ts, symbol) whose probability passes and passed at every reading of the last ``minutes``,
    of which there must be at least ``readings`` (default: one per minute)."""
    rth = bars.where(in_regular_hours("ts")).select("symbol", "ts", session_date("ts").alias("trade_date"))
    df = rth.join(shortlist.select("trade_date", "symbol"), ["trade_date", "symbol"], "left_semi")
    df = df.join(p_hat.select("symbol", "ts", "p_hat"), ["symbol", "ts"], "left")
    if minutes > 0:
        w = Window.partitionBy("symbol", "trade_date").orderBy("ts").rangeBetween(-minutes * 60 * SECOND_NS, 0)
        df = df.withColumns({"_min": F.min("p_hat").over(w), "_n": F.count("p_hat").over(w)})
        df = df.where(flag((F.col("_min") >= threshold) & (F.col("_n") >= (readings or minutes))))
    return df.where(flag(F.col("p_hat") >= threshold)).select("ts", "symbol", "p_hat")


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds ``in_universe``: listed at that timestamp, or the timestamp has no list at all."""
    listed = universe.select("ts", "symbol").distinct().withColumn("_hit", F.lit(True))
    times = universe.select("ts").distinct().withColumn("_known", F.lit(True))
    return df.join(listed, ["ts", "symbol"], "left").join(times, "ts", "left").withColumn(
        "in_universe", F.col("_hit").isNotNull() | F.col("_known").isNull()).drop("_hit", "_known")


def membership_days(membership: DataFrame, start: str, end: str, mode: str = "sip_only") -> DataFrame:
    """Days each symbol was a member (or not, or either) in a date range."""
    m = membership.where(F.col("trade_date").between(start, end))
    if mode == "sip_only":
        m = m.where("is_sip")
    elif mode == "no_sip":
        m = m.where(~F.col("is_sip"))
    elif mode != "all":
        raise ValueError(f"unknown mode: {mode}")
    return m.groupBy(F.upper("symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("days"))


def phase_symbols(membership: DataFrame, candidates: DataFrame, start: str, end: str, mode: str = "sip_only",
                  max_symbols: int | None = None) -> DataFrame:
    """Candidates that were members in the phase; the most frequent ``max_symbols`` (ties by symbol)."""
    days = membership_days(membership, start, end, mode).join(
        candidates.select(F.upper("symbol").alias("symbol")).distinct(), "symbol", "left_semi")
    return days.orderBy(F.col("days").desc(), "symbol").limit(max_symbols) if max_symbols else days


def label_guard(labels: DataFrame, min_per_direction: int, min_total: int) -> DataFrame:
    """Directional label counts per symbol, the reasons they fall short, kept or dropped."""
    g = labels.groupBy(F.upper("symbol").alias("symbol")).agg(
        F.sum((F.col("label") == 1).cast("long")).alias("long_labels"),
        F.sum((F.col("label") == -1).cast("long")).alias("short_labels"))
    total = F.col("long_labels") + F.col("short_labels")
    reasons = F.array_compact(F.array(
        F.when(F.col("long_labels") < min_per_direction, F.lit("insufficient_long")),
        F.when(F.col("short_labels") < min_per_direction, F.lit("insufficient_short")),
        F.when(total < min_total, F.lit("insufficient_total"))))
    return g.withColumns({"total_directional": total, "reasons": reasons}).withColumn(
        "status", F.when(F.size("reasons") > 0, F.lit("dropped")).otherwise(F.lit("kept")))


def coverage_days(bars: DataFrame, phases: dict[str, tuple[str, str]]) -> DataFrame:
    """Distinct trading days per symbol, in total and per phase (inclusive date ranges)."""
    days = bars.select("symbol", F.date_format(event_time("ts"), "yyyy-MM-dd").alias("d")).distinct()
    return days.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_days"),
        *[F.sum(F.col("d").between(a, b).cast("long")).alias(f"{p}_days") for p, (a, b) in phases.items()])


def coverage_guard(coverage: DataFrame, minimums: dict[str, int], tolerance: float = 0.0) -> DataFrame:
    """Reasons a symbol's day counts fall below max(minimum, ceil(best * (1 - tolerance)))."""
    tolerance = min(max(tolerance, 0.0), 1.0)
    best = coverage.agg(*[F.max(f"{p}_days").alias(f"_best_{p}") for p in minimums])  # one row
    df = attach_one_row(coverage, best)
    reasons = []
    for p, base in minimums.items():
        top = F.col(f"_best_{p}")
        need = F.when(top == 0, F.lit(base)).otherwise(
            F.greatest(F.lit(base), F.ceil(top * (1.0 - tolerance)))) if tolerance > 0 else F.lit(base)
        reasons.append(F.when((need > 0) & (F.col(f"{p}_days") < need), F.lit(f"insufficient_{p}_days")))
    df = df.withColumn("reasons", F.array_compact(F.array(*reasons))).drop(*[f"_best_{p}" for p in minimums])
    has = lambda p: F.array_contains("reasons", f"insufficient_{p}_days")
    return df.withColumns({
        "drop_training": has("total") | has("train"), "drop_deployment": has("total") | has("oos")})


def universe_report(bars: DataFrame, candidates: DataFrame, cfg: ScreenConfig, phases: dict[str, tuple[str, str]]) -> DataFrame:
    """Every candidate with its metrics, coverage, whether it was selected, and why not."""
    latest = latest_with_metrics(bars)
    ok = latest.where(passes_filters(cfg))
    chosen = ok.orderBy(F.col("relative_volume").desc(), "symbol").limit(cfg.top_n).select("symbol").withColumn("_sel", F.lit(True))
    pool = candidates.select(F.upper("symbol").alias("symbol")).unionByName(latest.select("symbol")).distinct()
    df = pool.join(latest.select("symbol", F.col("close").alias("latest_close"), "relative_volume", "avg_daily_dollar_volume"),
                   "symbol", "left")
    df = df.join(chosen, "symbol", "left").join(coverage_days(bars, phases), "symbol", "left")
    price, rv, dv = F.col("latest_close"), F.col("relative_volume"), F.col("avg_daily_dollar_volume")
    missing = price.isNull()
    excluded = F.col("symbol").isin(*cfg.exclude) if cfg.exclude else F.lit(False)
    passed = flag(price.between(cfg.min_price, cfg.max_price) & (rv >= cfg.min_relative_volume)
                  & (dv >= cfg.min_dollar_volume)) & ~excluded
    selected = F.col("_sel").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(missing, F.lit("missing_data")),
        F.when(price < cfg.min_price, F.lit("price_below_min")),
        F.when(price > cfg.max_price, F.lit("price_above_max")),
        F.when(~missing & ~flag(rv >= cfg.min_relative_volume), F.lit("low_relative_volume")),
        F.when(~missing & ~flag(dv >= cfg.min_dollar_volume), F.lit("low_avg_dollar_volume")),
        F.when(excluded, F.lit("excluded_symbol")),
        F.when(passed & ~selected, F.lit("below_top_n_cut"))))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total_days", *[f"{p}_days" for p in phases])}
    return df.withColumns({"selected": selected, "reasons": reasons, **zero}).drop("_sel")


def universe_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("symbols"), F.min("close").alias("min_price"), F.max("close").alias("max_price"),
        F.avg("avg_daily_dollar_volume").alias("mean_dv"), F.avg("relative_volume").alias("mean_rvol"))


def keep_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    return df.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def drop_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    return df.join(symbols.select("symbol").distinct(), "symbol", "left_anti")


def head_per_symbol(df: DataFrame, n: int, order: Iterable[str] = ("ts",)) -> DataFrame:
    """First n rows of every symbol (top-n is pruned before the shuffle)."""
    w = Window.partitionBy("symbol").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
