"""Bars and predictions to decisions: position folds, cooldown, gates with reasons, caps, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mathcols import clip, div, flag
from ..functions.timecols import DAY_NS, MINUTE_NS, SESSION_CLOSE, idiv, market_minute, utc_minute
from .joins import attach_one_row, lookup_join, next_bar
from .jumps import Holdings, first_offset, last_of, next_true, orbit
from .quantiles import exact_percentiles
from .series import Fold, fold_series, settle

# Rejection reasons and the reporting bucket of each.
REASON_BUCKETS = {
    "max_trades_per_bar_reached": "capacity", "max_open_positions_reached": "capacity",
    "max_entries_reached_global": "capacity", "max_trades_per_symbol_reached": "capacity", "position_exists": "capacity",
    "holding_long": "capacity", "holding_short": "capacity", "risk_budget_exhausted": "risk_budget",
    "risk_unavailable": "risk_budget", "expected_r_low": "expected_r", "time_filter": "tod_profile", "cooldown": "tod_profile",
    "gap_insufficient": "score_margin", "conviction_low": "score_margin", "below_threshold": "probability",
}


def reason_bucket(reason: Column) -> Column:
    """Raw rejection reason to its reporting bucket."""
    r = F.lower(reason)
    out = F.when(r.startswith("bigmove_"), F.lit("bigmove_prob"))
    for bucket in dict.fromkeys(REASON_BUCKETS.values()):
        out = out.when(r.isin(*[k for k, v in REASON_BUCKETS.items() if v == bucket]), bucket)
    return out.when(r.startswith("strategy_check:"), "probability").otherwise("other")


def rejection_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy(reason_bucket(F.col("reason")).alias("bucket")).agg(F.count(F.lit(1)).alias("rejections"))


# --- position folds -----------------------------------------------------------------------------------

POSITION_FIELDS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("signal", T.IntegerType()),
    T.StructField("bars_held", T.IntegerType()), T.StructField("decision", T.StringType())])


def _position_fold(timeout: int) -> Fold:
    """Flat or holding for k bars: enter on ``_enter``, leave on ``_exit`` or after ``timeout`` bars."""
    longest = max(timeout - 1, 1)

    def machine(rows: pd.DataFrame) -> tuple[Holdings, Callable[[int], int]]:
        enter, leave = (rows[c].to_numpy(bool) for c in ("_enter", "_exit"))
        following = next_true(leave)
        due = np.minimum(following[1:], np.arange(len(rows)) + longest)
        # the exit row of a position that was held for k bars before these rows
        return Holdings(enter, due), lambda k: int(min(following[0], max(timeout - k - 1, 0)))

    def run(rows: pd.DataFrame, state: str) -> tuple[pd.DataFrame, str]:
        m, inherited = machine(rows)
        out, left = _held_rows(m, int(state), inherited)
        return rows[["symbol", "ts"]].assign(**out), str(left)

    def exits(rows: pd.DataFrame, states: list[str]) -> list[str]:
        m, inherited = machine(rows)
        return [str(_left_holding(m, int(k), inherited)[0]) for k in states]

    return Fold(run, "0", lambda rows, before: [str(k) for k in range(max(timeout, 2))], exits=exits)


def _left_holding(m: Holdings, k: int, inherited: Callable[[int], int]) -> tuple[int, int]:
    """(bars held after the last row, its entry row: n if flat, -1 if inherited) of a machine entered with k bars held."""
    until = inherited(k) if k else -1
    if until >= m.n:
        return k + m.n, -1
    e = m.last_entry(until + 1)
    return (m.n - e, e) if e < m.n <= m.due[e] else (0, m.n)


def _held_rows(m: Holdings, k: int, inherited: Callable[[int], int]) -> tuple[dict[str, np.ndarray], int]:
    """Columns bars_held, decision and signal of a machine entered with k bars held, and the bars held after the last row."""
    until = inherited(k) if k else -1
    entries = m.entries(until + 1)
    held = m.held(entries)
    if k:
        held[: min(until, m.n)] = k + 1 + np.arange(min(until, m.n))
    decision = np.full(m.n, "hold", object)
    left = np.append(m.due[entries], [until] if k else []).astype(np.int64)
    decision[left[left < m.n]] = "exit"
    decision[entries] = "enter"
    return {"bars_held": held.astype(np.int32), "decision": decision, "signal": (held > 0).astype(np.int32)}, int(held[-1]) if m.n else k


def _positions(bars: DataFrame, enter: Column, leave: Column, timeout: int, max_rows: int | None) -> DataFrame:
    rows = bars.select("symbol", "ts", flag(enter).alias("_enter"), flag(leave).alias("_exit"))
    return fold_series(rows, _position_fold(timeout), POSITION_FIELDS, max_rows=max_rows)


def _tradable(df: DataFrame) -> Column:
    universe = F.col("in_universe") if "in_universe" in df.columns else F.lit(True)
    warm = F.col("f__warmup_ok") if "f__warmup_ok" in df.columns else F.lit(True)
    return universe & warm


def vwap_revert(df: DataFrame, rvol_min: float = 1.0, timeout: int = 10, vwap: str = "f__ta__vwap_30",
                rvol: str = "f__vol__rel_volume_30", max_rows: int | None = None) -> DataFrame:
    """Enter below the VWAP on enough volume; leave back at it or after ``timeout`` bars."""
    c, v = F.col("close"), F.col(vwap)
    return _positions(df, (c < v) & (F.col(rvol) >= rvol_min) & _tradable(df), c >= v, timeout, max_rows)


def vwap_momentum(df: DataFrame, rvol_min: float = 1.0, timeout: int = 10, min_breakout: float = 0.5,
                  vwap: str = "f__ta__vwap_30", rvol: str = "f__vol__rel_volume_30", max_rows: int | None = None) -> DataFrame:
    """Enter on a break above the VWAP by ``min_breakout`` percent; leave on the opposite break or timeout."""
    c, v = F.col("close"), F.col(vwap)
    strength = div(c - v, v)
    cut = min_breakout / 100
    enter = (c > v) & (F.col(rvol) >= rvol_min) & _tradable(df) & (strength > cut)
    return _positions(df, enter, (c <= v) & (strength < -cut), timeout, max_rows)


def vpa_score(df: DataFrame, min_confidence: float = 0.5) -> tuple[Column, Column]:
    """(score, number of active patterns): mean confidence of the active patterns, less for few patterns."""
    names = [c[len("p__vpa__"):] for c in df.columns if c.startswith("p__vpa__")]
    active = [F.col(f"p__vpa__{n}") for n in names]
    count = sum((a.cast("int") for a in active[1:]), active[0].cast("int"))
    conf = sum((F.when(a, F.coalesce(F.col(f"conf__vpa__{n}"), F.lit(0.0))).otherwise(0.0)
                for a, n in zip(active[1:], names[1:], strict=True)),
               F.when(active[0], F.coalesce(F.col(f"conf__vpa__{names[0]}"), F.lit(0.0))).otherwise(0.0))
    mean = conf / F.nullif(count, F.lit(0))
    score = F.when(flag(mean >= min_confidence), mean * F.least(count / 3.0, F.lit(1.0))).otherwise(F.lit(0.0))
    return score, count


SCORED_FIELDS = T.StructType([
    *POSITION_FIELDS.fields, T.StructField("vpa_score", T.DoubleType()), T.StructField("combined_score", T.DoubleType()),
    T.StructField("active_patterns", T.IntegerType())])


def model_vpa_signals(df: DataFrame, model: str = "model_score", threshold: float = 0.6, vpa_weight: float = 0.3,
                      timeout: int = 50, min_confidence: float = 0.5, max_rows: int | None = None) -> DataFrame:
    """Position from a model score blended with the pattern score.

    Leave when the model weakens, when the blend falls below 0.7 of its entry value, or on timeout.
    """
    score, count = vpa_score(df, min_confidence)
    rows = df.select("symbol", "ts", F.col(model).alias("_m"), score.alias("vpa_score"), count.cast("int").alias("active_patterns"))
    rows = rows.withColumn("combined_score", F.col("_m") * (1 - vpa_weight) + F.col("vpa_score") * vpa_weight)

    longest = max(timeout - 1, 1)

    def machine(rows: pd.DataFrame) -> tuple[Holdings, np.ndarray, np.ndarray, Callable[[float], Callable[[int], int]]]:
        m, c = (rows[x].to_numpy(float) for x in ("_m", "combined_score"))
        n = len(rows)
        weak = m < threshold * 0.5
        following = next_true(weak)
        entered = np.nonzero(c >= threshold)[0]
        due = np.full(n, n)
        due[entered] = first_offset(entered, n, longest, lambda e, i: c[i] < c[e] * 0.7)
        due = np.minimum(np.minimum(due, following[1:]), np.arange(n) + longest)

        def inherited(entry: float) -> Callable[[int], int]:
            lower = next_true(c < entry * 0.7)[0]
            return lambda k: int(min(following[0], lower, max(timeout - k - 1, 0)))

        return Holdings(c >= threshold, due), weak, c, inherited

    def run(rows: pd.DataFrame, state: str) -> tuple[pd.DataFrame, str]:
        k, entry = int(state.split("|")[0]), float(state.split("|")[1])
        m, weak, c, inherited = machine(rows)
        out, left = _held_rows(m, k, inherited(entry))
        # what each exit row compares with: the score at the entry
        entries = np.nonzero(out["decision"] == "enter")[0]
        score = np.full(m.n, entry)
        closing = m.due[entries]
        score[closing[closing < m.n]] = c[entries[closing < m.n]]
        why = np.where(weak, "exit_model", np.where(c < score * 0.7, "exit_combined", "exit_timeout"))
        out["decision"] = np.where(out["decision"] == "exit", why, out["decision"])
        return rows[["symbol", "ts", "vpa_score", "combined_score", "active_patterns"]].assign(**out), left_in(m, c, k, entry, inherited)

    def left_in(m: Holdings, c: np.ndarray, k: int, entry: float, inherited: Callable[[float], Callable[[int], int]]) -> str:
        left, at = _left_holding(m, k, inherited(entry))
        return f"{left}|{entry!r}" if at == -1 else f"{left}|{float(c[at])!r}" if left else "0|0.0"

    def exits(rows: pd.DataFrame, states: list[str]) -> list[str]:
        m, _, c, inherited = machine(rows)
        return [left_in(m, c, int(s.split("|")[0]), float(s.split("|")[1]), inherited) for s in states]

    def entries(rows: pd.DataFrame, before: pd.DataFrame) -> list[str]:
        # A position held k bars was entered k rows back, at that row's score.
        scores = before["combined_score"].tolist()
        held = [f"{k}|{scores[-k]!r}" for k in range(1, min(timeout, len(scores) + 1)) if scores[-k] >= threshold]
        return ["0|0.0", *held]

    return fold_series(rows, Fold(run, "0|0.0", entries, lookback=timeout, exits=exits), SCORED_FIELDS, max_rows=max_rows)


def cooldown(signals: DataFrame, minutes: int, max_rows: int | None = None) -> DataFrame:
    """Keep a signal only if the last kept one of the symbol is at least ``minutes`` older (greedy)."""
    gap = minutes * MINUTE_NS
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.LongType())])

    def machine(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Callable[[str], int]]:
        ts = rows["ts"].to_numpy(np.int64)
        n = len(ts)
        step = np.append(np.maximum(np.searchsorted(ts, ts + gap), np.arange(1, n + 1)), n)
        return ts, step, lambda state: int(np.searchsorted(ts, int(state) + gap)) if state else 0

    def run(rows: pd.DataFrame, state: str) -> tuple[pd.DataFrame, str]:
        ts, step, start = machine(rows)
        kept = orbit(step, start(state))
        return rows.iloc[kept][["symbol", "ts"]], str(ts[kept[-1]]) if len(kept) else state

    def exits(rows: pd.DataFrame, states: list[str]) -> list[str]:
        ts, step, start = machine(rows)
        last = last_of(step)
        return [str(ts[last[i]]) if (i := start(s)) < len(ts) else s for s in states]

    def entries(rows: pd.DataFrame, before: pd.DataFrame) -> list[str]:
        first = int(rows["ts"].iloc[0])
        recent = before["ts"][before["ts"] > first - gap]
        return ["", *[str(t) for t in recent]]

    def match(state: str, known: list[str]) -> str:
        # A last signal older than the gap before this segment no longer blocks anything.
        return state if state in known else ""

    kept = fold_series(signals.select("symbol", "ts").distinct(), Fold(run, "", entries, minutes + 1, match, exits), schema, max_rows=max_rows)
    return signals.join(kept, ["symbol", "ts"], "left_semi")


# UTC minutes of the day after which positions are closed, and after which none is opened.
HARD_CLOSE, LAST_ENTRY = 20 * 60 + 55, 19 * 60 + 30
DEVIATION_FIELDS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("side", T.StringType()),
    T.StructField("signal_type", T.StringType()), T.StructField("exit_reason", T.StringType()), T.StructField("close", T.DoubleType()),
    T.StructField("entry_ts", T.LongType()), T.StructField("entry_price", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("stop_loss_pct", T.DoubleType()), T.StructField("take_profit_pct", T.DoubleType())])


def deviation_signals(df: DataFrame, vwap: str = "f__ta__vwap_30", atr: str = "f__vol__atr_14", spacing_minutes: int = 5,
                      enter: float = 0.6, leave: float = 0.1, max_rows: int | None = None) -> DataFrame:
    """Intraday mean reversion around the VWAP with thresholds in the symbol's own deviation units.

    The deviation's standard deviation is taken over the whole input of a symbol, so the thresholds look
    ahead; that is how the rule is defined.  Positions end the same day.
    """
    dev = div(F.col("close") - F.col(vwap), F.col(vwap))
    rows = df.select("symbol", "ts", F.col("close").cast("double").alias("close"), F.col(atr).cast("double").alias("_atr"), dev.alias("_dev"))
    std = rows.groupBy("symbol").agg(F.stddev_samp("_dev").alias("_std"))
    rows = rows.join(std, "symbol").withColumns({"_minute": utc_minute("ts"), "_day": idiv(F.col("ts"), DAY_NS)})
    gap = spacing_minutes * MINUTE_NS

    def side_of(d: float, sd: float, minute: int) -> str:
        if minute >= LAST_ENTRY or not sd > 0 and not sd == 0:
            return ""
        return "long" if d < -sd * enter else "short" if d > sd * enter else ""

    def opened(side: str, price: float, a: float, ts: int, day: int) -> str:
        # a price of zero leaves the fixed limits
        stop, take = (min(a / price, 0.02), min(1.5 * a / price, 0.03)) if price else (0.02, 0.03)
        return f"{side}|{price!r}|{stop!r}|{take!r}|{ts}|{day}|{ts}"

    def why_leave(pos: list, price: float, d: float, sd: float, day: int) -> str | None:
        side, entry, stop, take, sign = pos[0], float(pos[1]), float(pos[2]), float(pos[3]), 1 if pos[0] == "long" else -1
        if day > int(pos[5]):
            return "same_day_forced_close"
        if d * sign > sd * leave:
            return "mean_reversion_exit"
        move = (price - entry) * sign
        if move < -entry * stop:
            return "intraday_stop_loss"
        return "intraday_take_profit" if move > entry * take else None

    def run(rows: pd.DataFrame, state: str) -> tuple[pd.DataFrame, str]:
        out = []
        columns = ("symbol", "ts", "close", "_atr", "_dev", "_std", "_minute", "_day")
        for symbol, ts, price, a, d, sd, minute, day in zip(*[rows[c].tolist() for c in columns], strict=True):
            pos = state.split("|")
            if pos[-1] and ts - int(pos[-1]) < gap:
                continue
            reason = None
            if pos[0]:
                reason = "end_of_day_hard_close" if minute >= HARD_CLOSE else why_leave(pos, price, d, sd, day)
            if reason:
                sure = 1.0 if reason == "end_of_day_hard_close" else 0.8
                out.append((symbol, ts, "sell" if pos[0] == "long" else "buy", "exit", reason, price, int(pos[4]), float(pos[1]), sure, None, None))
                state = f"|{ts}"
            elif not pos[0] and minute < HARD_CLOSE:
                side = side_of(d, sd, minute)
                if side:
                    state = opened(side, price, a, ts, day)
                    _, _, stop, take, *_ = state.split("|")
                    conf = min(abs(d) / sd, 0.9) if sd else 0.9
                    out.append((symbol, ts, "buy" if side == "long" else "sell", "entry", None, price, None, None, conf, float(stop), float(take)))
        frame = pd.DataFrame(out, columns=[f.name for f in DEVIATION_FIELDS.fields])
        return frame.astype({"entry_ts": "Int64"}), state

    def entries(rows: pd.DataFrame, before: pd.DataFrame) -> list[str]:
        # Flat, with or without a recent signal; or holding since any possible entry of the last day.
        first = int(rows["ts"].iloc[0])
        states = ["|", *[f"|{t}" for t in before["ts"] if first - t < gap]]
        if len(before):
            last = before[before["_day"] == before["_day"].iloc[-1]]
            for ts, price, a, d, sd, minute, day in zip(*[last[c].tolist() for c in ("ts", "close", "_atr", "_dev", "_std", "_minute", "_day")], strict=True):
                side = side_of(d, sd, minute)
                if side:
                    states.append(opened(side, price, a, ts, day))
        return states

    def match(state: str, known: list[str]) -> str:
        # A signal longer ago than the spacing no longer matters to a flat state.
        return state if state in known or not state.startswith("|") else "|"

    return fold_series(rows, Fold(run, "|", entries, 1440, match), DEVIATION_FIELDS, max_rows=max_rows)


# --- entries, gates, caps --------------------------------------------------------------------------------


def level_entries(df: DataFrame, kind: str, dev: float = 0.5, stop_atr: float = 1.5) -> DataFrame:
    """Stateless entry candidates with entry side and stop level.

    ``momentum``: the bar's low or high with 1% room; ``pullback``: a number of ATRs away from the session
    price; ``rotation``: a percentage beyond the value area.  Candidates without risk are dropped.
    """
    c, atr = F.col("close"), F.col("f__vol__atr_14")
    if kind == "momentum":
        vwap = F.col("f__anchor__session_avwap")
        df = df.withColumns({"side": F.when(c > vwap, "long").when(c < vwap, "short"),
                             "stop_level": F.when(c > vwap, F.col("low") * 0.99).when(c < vwap, F.col("high") * 1.01)})
    elif kind == "pullback":
        vwap = F.col("f__anchor__session_avwap")
        lo, hi = vwap - atr * dev, vwap + atr * dev
        known = flag((vwap != 0) & (atr != 0))
        df = df.withColumns({"side": F.when(known & (c <= lo), "long").when(known & (c >= hi), "short"),
                             "stop_level": F.when(c <= lo, lo - atr * stop_atr).when(c >= hi, hi + atr * stop_atr)})
    elif kind == "rotation":
        lo, hi = F.col("f__profile__val") * (1 - dev / 100), F.col("f__profile__vah") * (1 + dev / 100)
        known = flag(atr != 0)
        df = df.withColumns({"side": F.when(known & (c <= lo), "long").when(known & (c >= hi), "short"),
                             "stop_level": F.when(c <= lo, lo - atr * stop_atr).when(c >= hi, hi + atr * stop_atr)})
    else:
        raise ValueError(f"unknown entry kind: {kind}")
    risk = F.when(F.col("side") == "long", c - F.col("stop_level")).otherwise(F.col("stop_level") - c)
    return df.withColumn("risk_per_share", risk).where(F.col("side").isNotNull() & (F.col("risk_per_share") > 0))


def time_profile(minute: Column, profiles: list[tuple[str, int, int]]) -> Column:
    """Name of the first profile [start, end) holding the minute (an end before the start wraps midnight);
    the last profile by start when none does."""
    ordered = sorted(profiles, key=lambda p: p[1])
    out = None
    for name, start, end in ordered:
        inside = (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(ordered[-1][0])


def ml_gate(df: DataFrame, prob_long: Column, prob_short: Column, gap_long: Column, gap_short: Column,
            conv_long: Column, conv_short: Column, margin: float, min_expected_r: float) -> DataFrame:
    """Side or rejection reason for every prediction row; thresholds may be columns (per symbol, per time)."""
    pl, ps, pn = F.col("prob_long"), F.col("prob_short"), F.col("prob_neutral")
    gap = F.abs(pl - ps)
    conv = gap * F.greatest(pl, ps)
    long = ((pl >= prob_long) & (pl - F.greatest(ps, pn) >= margin) & (pl > ps) & (gap >= gap_long)
            & ((conv_long == 0) | (conv >= conv_long)))
    short = ((ps >= prob_short) & (ps - F.greatest(pl, pn) >= margin) & (ps > pl) & (gap >= gap_short)
             & ((conv_short == 0) | (conv >= conv_short)))
    least_conv = F.least(F.when(conv_long > 0, conv_long), F.when(conv_short > 0, conv_short))
    side = F.when(flag(long), "long").when(flag(short), "short")
    df = df.withColumns({"directional_gap": gap, "conviction": conv, "side": side})
    reason = (F.when(F.col("side").isNull() & (gap < F.least(gap_long, gap_short)), "gap_insufficient")
              .when(F.col("side").isNull() & flag(conv < least_conv), "conviction_low")
              .when(F.col("side").isNull(), "below_threshold")
              .when(~flag(F.col("expected_r") >= min_expected_r), "expected_r_low"))
    df = df.withColumn("reason", reason)
    score = (F.greatest(pl, ps, pn, F.lit(0.0)) * F.greatest(gap, F.lit(0.0)) * F.greatest(conv, F.lit(0.0))
             * F.greatest(F.col("expected_r"), F.lit(0.0)))
    return df.withColumns({"bucket": F.when(F.col("reason").isNotNull(), reason_bucket(F.col("reason"))), "score": score})


def rank_caps(candidates: DataFrame, per_bar: int, per_symbol_day: int, per_day: int) -> DataFrame:
    """Caps as successive ranks: earliest per (symbol, day), best score per bar, earliest per day."""
    df = candidates.withColumn("_day", idiv(F.col("ts"), DAY_NS))
    best = [F.col("score").desc(), F.col("symbol")]
    for part, order, n in ((["symbol", "_day"], ["ts"], per_symbol_day), (["ts"], best, per_bar), (["_day"], ["ts", *best], per_day)):
        w = Window.partitionBy(*part).orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return df.drop("_rn", "_day")


def greedy_caps(candidates: DataFrame, per_bar: int, per_symbol_day: int, per_day: int) -> DataFrame:
    """Caps as the entry loop applies them: by time, then score; a refused candidate uses no allowance.

    Most candidates can be refused without following the loop.  Of a bar, the allowances of the day's earlier entries refuse at most ``per_day`` rows
    before the bar is full (rows of a symbol beyond its own cap aside), so only the first ``per_bar + per_day`` can enter.  A row among the first
    ``per_bar`` enters unless its symbol or the day is full already, so a symbol's rows after ``per_symbol_day`` such rows never do.
    What is left streams through in order of time; the state carried along is the entries per symbol of the running day.  Reasons of all rows follow from where
    each bar and each day became full.  Rows without a score (null or NaN) come last in their bar; equal rows enter one after another.
    """
    w = Window.partitionBy("ts").orderBy(F.col("score").desc_nulls_last(), "symbol")
    twins = Window.partitionBy("ts", "symbol").orderBy(F.col("score").desc_nulls_last())
    score = F.col("score").cast("double")
    lean = candidates.select("symbol", "ts", F.when(~F.isnan(score), score).alias("score"), idiv(F.col("ts"), DAY_NS).alias("_day"))
    ranked = lean.repartition("ts").withColumn("_k", F.row_number().over(twins)).withColumns({
        "_at": F.row_number().over(w), "_rank": F.sum(F.when(F.col("_k") <= per_symbol_day, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    able = ranked.where((F.col("_k") <= per_symbol_day) & (F.col("_rank") <= per_bar + per_day)).select("_day", "ts", "_at", "symbol", "_rank")
    earlier = Window.partitionBy("_day", "symbol").orderBy("ts", "_at").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce(F.count_if(F.col("_rank") <= per_bar).over(earlier), F.lit(0))
    able = able.withColumn("_sure", sure).where(F.col("_sure") < per_symbol_day).select("_day", "ts", "_at", "symbol")

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        today = bar = None
        day_n = bar_n = 0
        by_symbol: dict[str, int] = {}
        for rows in batches:
            out = []
            for day, ts, at, symbol in rows.itertuples(index=False, name=None):
                if day != today:
                    today, day_n, by_symbol = day, 0, {}
                if ts != bar:
                    bar, bar_n = ts, 0
                if bar_n < per_bar and day_n < per_day and by_symbol.get(symbol, 0) < per_symbol_day:
                    bar_n, day_n = bar_n + 1, day_n + 1
                    by_symbol[symbol] = by_symbol.get(symbol, 0) + 1
                    out.append((day, ts, at, bar_n == per_bar, day_n == per_day))
            yield pd.DataFrame(out, columns=["_day", "ts", "_at", "_bar_full", "_day_full"])

    ordered = able.repartition("_day").sortWithinPartitions("_day", "ts", "_at")
    entered = settle(ordered.mapInPandas(enter, "_day long, ts long, _at int, _bar_full boolean, _day_full boolean"))
    bars = entered.groupBy("ts").agg(F.collect_list("_at").alias("_in"), F.max(F.when(F.col("_bar_full"), F.col("_at"))).alias("_full_at"))
    days = entered.where("_day_full").select("_day", F.struct("ts", "_at").alias("_full"))
    judged = lookup_join(lookup_join(ranked, bars, ["ts"]), days, ["_day"])
    reason = (F.when(F.array_contains("_in", F.col("_at")), F.lit(None).cast("string"))
              .when(F.col("_at") > F.col("_full_at"), "max_trades_per_bar_reached")
              .when(F.struct("ts", "_at") > F.col("_full"), "max_entries_reached_global").otherwise("max_trades_per_symbol_reached"))
    return judged.select("symbol", "ts", reason.alias("block_reason"))


def next_bar_orders(orders: DataFrame, bars: DataFrame, slippage_bps: float = 3.0, max_rows: int | None = None) -> DataFrame:
    """Execute at the next bar's open with slippage; orders on a symbol's last bar are dropped."""
    df = next_bar(orders, bars, {"execution_ts": "ts", "_open": "open"}, max_rows)
    slip = slippage_bps / 10000.0
    price = F.when(F.lower("side") == "short", F.col("_open") * (1.0 - slip)).otherwise(F.col("_open") * (1.0 + slip))
    return df.withColumnRenamed("ts", "signal_ts").withColumn("fill_price", price).drop("_open")


def drop_late_orders(orders: DataFrame, buffer_minutes: int) -> DataFrame:
    """Orders within ``buffer_minutes`` of the session close (or after it) are dropped."""
    return orders.where(market_minute("ts") < SESSION_CLOSE - buffer_minutes)


# --- calibration -----------------------------------------------------------------------------------------

METRICS = ("prob_long", "prob_short", "directional_gap", "conviction", "score_margin")


def metric_summary(df: DataFrame, metrics: tuple[str, ...], quantiles: dict[str, float]) -> DataFrame:
    """Count, mean, deviation, range and quantiles per (symbol, metric) and over all symbols (symbol NULL)."""
    long = df.unpivot(["symbol"], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    moments = [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
               F.min("value").alias("min"), F.max("value").alias("max")]
    per = long.groupBy("symbol", "metric").agg(*moments).join(exact_percentiles(long, ["symbol", "metric"], "value", quantiles),
                                                              ["symbol", "metric"])
    total = long.groupBy("metric").agg(*moments).join(exact_percentiles(long, ["metric"], "value", quantiles), "metric")
    return per.unionByName(total.withColumn("symbol", F.lit(None).cast("string")))


def calibrate(summary: DataFrame, base: dict[str, float], percentiles: dict[str, str], min_samples: int,
              floors: dict[str, float], ceilings: dict[str, float], bias_scale: float = 0.0,
              bias_max: float = 0.05) -> DataFrame:
    """Thresholds per symbol from its quantiles, or the global ones where it has too few samples.

    ``percentiles`` maps threshold name to "metric:quantile column"; floors and ceilings bound the result;
    a symbol whose mean long and short probabilities differ has its side thresholds moved apart.
    """
    pairs = {k: v.split(":") for k, v in percentiles.items()}
    pick: Callable[[str, str], Column] = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    cols = [*[pick(m, q).alias(k) for k, (m, q) in pairs.items()], F.max("n").alias("n"),
            pick("prob_long", "mean").alias("_ml"), pick("prob_short", "mean").alias("_ms")]
    per = summary.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(*cols)
    glob = summary.where(F.col("symbol").isNull()).agg(*[c for c in cols]).select(
        *[F.col(k).alias(f"_g_{k}") for k in (*pairs, "_ml", "_ms")])
    df = attach_one_row(per, glob)
    own = F.col("n") >= min_samples

    def bound(name: str, x: Column) -> Column:
        return clip(x, floors.get(name), ceilings.get(name, 0.999 if name.startswith("prob") else 1.0))

    out = {k: bound(k, F.coalesce(F.when(own, F.col(k)).otherwise(F.col(f"_g_{k}")), F.lit(base[k]))) for k in pairs}
    df = df.withColumns({**out, "source": F.when(own, "symbol").otherwise("global"),
                         "_d": F.when(own, F.col("_ml") - F.col("_ms")).otherwise(F.col("_g__ml") - F.col("_g__ms"))})
    if bias_scale and {"prob_threshold_long", "prob_threshold_short"} <= set(pairs):
        adj = F.when(F.abs("_d") < 1e-6, F.lit(0.0)).otherwise(clip(-F.col("_d") * bias_scale, -bias_max, bias_max))
        df = df.withColumn("_adj", adj)
        for k, sign in (("prob_threshold_long", -1), ("prob_threshold_short", 1)):
            moved = F.greatest(F.col(k) + F.col("_adj") * sign, F.lit(max(0.0, base[k] - bias_max)))
            df = df.withColumn(k, F.when(F.col("_adj") == 0, F.col(k)).otherwise(bound(k, moved)))
    return df.select("symbol", "source", "n", *pairs)
