"""Order-dependent operators against plain Python loops, whole and segmented."""

from __future__ import annotations

import pandas as pd
import pytest
from conftest import MIN, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeworks.operators import labels, regime, signals, trades
from tapeworks.operators.features_core import core_pack


def revert_loop(rows, rvol_min, timeout):
    held, out = 0, []
    for r in rows.itertuples():
        if held:
            held += 1
            if r.close >= r.f__ta__vwap_30 or held >= timeout:
                held = 0
        elif r.close < r.f__ta__vwap_30 and r.f__vol__rel_volume_30 >= rvol_min and r.f__warmup_ok:
            held = 1
        out.append(held)
    return out


@pytest.mark.parametrize("rows", [10_000, 40])
def test_vwap_revert(bars, rows):
    feats = core_pack(bars, 5, 5, 5).withColumnsRenamed(
        {"f__ta__vwap_5": "f__ta__vwap_30", "f__vol__rel_volume_5": "f__vol__rel_volume_30"})
    src = frame(feats, "symbol", "ts")
    got = frame(signals.vwap_revert(feats, 0.3, 4, max_rows=rows), "symbol", "ts")
    want = [h for _, g in src.groupby("symbol") for h in revert_loop(g, 0.3, 4)]
    assert got["bars_held"].tolist() == want and max(want) > 1


def position_loop(enter, leave, timeout, held=0):
    out = []
    for e, x in zip(enter, leave):
        decision = "hold"
        if held:
            held += 1
            if x or held >= timeout:
                held, decision = 0, "exit"
        elif e:
            held, decision = 1, "enter"
        out.append((held, decision))
    return out, held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=40), st.integers(0, 6))
def test_position_machine_equals_a_loop(flags, timeout):
    fold = signals._position_fold(timeout)
    rows = pd.DataFrame({"symbol": "S", "ts": range(len(flags)), "_enter": [bool(a) for a, _ in flags], "_exit": [bool(b) for _, b in flags]})
    states = fold.entries(rows, rows)
    wants = [position_loop(*(zip(*flags) if flags else ((), ())), timeout, int(s)) for s in states]
    assert fold.left_in(rows, states) == [str(held) for _, held in wants]
    for s, (want, held) in zip(states, wants):
        out, left = fold.run(rows, s)
        assert list(zip(out["bars_held"], out["decision"])) == want and left == str(held)
        assert out["signal"].tolist() == [int(h > 0) for h, _ in want]


def scored_loop(m, c, threshold, timeout):
    held, entry, out = 0, 0.0, []
    for a, b in zip(m, c):
        decision = "hold"
        if held:
            if a < threshold * 0.5:
                decision = "exit_model"
            elif b < entry * 0.7:
                decision = "exit_combined"
            elif held + 1 >= timeout:
                decision = "exit_timeout"
            held, entry = (held + 1, entry) if decision == "hold" else (0, 0.0)
        elif b >= threshold:
            held, entry, decision = 1, b, "enter"
        out.append((held, decision))
    return out


@pytest.mark.parametrize("rows", [10_000, 40])
@pytest.mark.parametrize("timeout", [2, 5, 50])
def test_model_positions_equal_a_loop(bars, rows, timeout):
    df = bars.select("symbol", "ts", (F.col("volume") % 23 / 20).alias("model_score"), (F.col("volume") % 3 == 0).alias("p__vpa__x"),
                     F.when(F.col("volume") % 5 > 0, F.col("volume") % 11 / 10).alias("conf__vpa__x"))
    got = frame(signals.model_vpa_signals(df, threshold=0.5, vpa_weight=0.2, timeout=timeout, max_rows=rows), "symbol", "ts")
    model = frame(df, "symbol", "ts")["model_score"]
    want = [r for _, g in got.assign(m=model).groupby("symbol") for r in scored_loop(g["m"], g["combined_score"], 0.5, timeout)]
    assert list(zip(got["bars_held"], got["decision"])) == want
    assert {d for _, d in want} >= {"hold", "enter", "exit_timeout" if timeout == 2 else "exit_combined"}


@pytest.mark.parametrize("rows", [10_000, 40])
@pytest.mark.parametrize("minutes", [0, 3, 25])
def test_cooldown(bars, rows, minutes):
    s = bars.where("volume % 3 = 0").select("symbol", "ts")
    got = frame(signals.cooldown(s, minutes, max_rows=rows), "symbol", "ts")
    want = []
    for sym, g in frame(s, "symbol", "ts").groupby("symbol"):
        last = None
        for ts in g["ts"]:
            if last is None or ts - last >= minutes * MIN:
                want.append((sym, ts))
                last = ts
    assert list(got.itertuples(index=False, name=None)) == want


def _entered(rows, per_bar, per_symbol_day, per_day):
    """The entry loop over (symbol, ts, score) rows: reasons in order of time, score and symbol."""
    out, today, bar = [], None, None
    for s, t, x in sorted(rows, key=lambda r: (r[1], r[2] is None, -(r[2] or 0.0), r[0])):
        if t // (1440 * MIN) != today:
            today, day, by = t // (1440 * MIN), 0, {}
        n = n if t == bar else 0
        bar = t
        why = ("max_trades_per_bar_reached" if n >= per_bar else "max_entries_reached_global" if day >= per_day
               else "max_trades_per_symbol_reached" if by.get(s, 0) >= per_symbol_day else None)
        if why is None:
            n, day, by[s] = n + 1, day + 1, by.get(s, 0) + 1
        out.append((s, t, why or ""))
    return sorted(out)


@pytest.mark.parametrize("caps", [(2, 2, 7), (1, 1, 3), (3, 4, 50), (1, 2, 100)])
def test_greedy_caps(spark, caps):
    few = [(s, t, float((i * 7 + t) % 5)) for t in range(6) for i, s in enumerate("ABCD")]
    # three days: a leader in every bar, ties, repeated rows and a missing score
    many = [(f"S{i}", (d * 1440 + t) * MIN, float((i * 13 + t * t * 7 + d) % 6) + (9 if i == t % 3 else 0)) for d in range(3) for t in range(30) for i in range(9) if (i + t) % 4]
    many += many[::7] + [("S0", 5 * MIN, None), ("ONE", 2000 * MIN, None)]
    for rows in (few, many):
        df = spark.createDataFrame(rows, "symbol string, ts long, score double").repartition(5)
        got = sorted((r.symbol, r.ts, r.block_reason or "") for r in signals.greedy_caps(df, *caps).collect())
        assert got == _entered(rows, *caps)
    assert signals.greedy_caps(df.limit(0), *caps).count() == 0


def test_hysteresis_needs_persistence_and_cooldown(spark):
    day = 24 * 60 * MIN
    seq = ["BULL", "BEAR", "BULL", "BEAR", "BEAR", "SIDEWAYS", "SIDEWAYS"]
    rows = [("A", "AM", f"d{i}", i * day, r, 0.7) for i, r in enumerate(seq)]
    df = spark.createDataFrame(rows, "symbol string, segment string, session_date string, ts long, regime string, confidence double")
    got = frame(regime.apply_hysteresis(df, "symbol"), "ts")
    # the first decision is taken at once; a new regime must be seen twice since the last confirmed change
    assert got["regime"].tolist() == ["BULL", "BULL", "BULL", "BEAR", "BEAR", "BEAR", "SIDEWAYS"]
    quick = df.withColumn("ts", (F.col("ts") / 1440 / 2).cast("long"))
    held = frame(regime.apply_hysteresis(quick, "symbol"), "ts")
    assert held["regime"].tolist() == ["BULL"] * 7


def fills(spark, sides, qty=None):
    rows = [("S", i * MIN, i, s, 10.0 + (i * 7) % 5, (qty or [1] * len(sides))[i], 0.5) for i, s in enumerate(sides)]
    return spark.createDataFrame(rows, "symbol string, ts long, order_id long, side string, price double, quantity long, commission double")


@pytest.mark.parametrize("rows", [10_000, 2])
@pytest.mark.parametrize("sides", ["BSBSBS", "BBSSBS", "BSSSB", "SBSBBBSSB", "BBBB", "BSSBBSSBSBSB"])
def test_round_trips(spark, sides, rows):
    names = ["BUY" if c == "B" else "SELL" for c in sides]
    got = trades.round_trips(fills(spark, names), max_rows=rows).select("entry_order_id", "exit_order_id").toPandas()
    pos, want = None, []
    for i, s in enumerate(names):
        if pos is None or names[pos] == s:
            pos = i
        else:
            want.append((pos, i))
            pos = None
    assert sorted(got.itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("rows", [10_000, 3])
def test_average_cost(spark, rows):
    sides = ["BUY", "BUY", "SELL", "SELL", "SELL", "BUY", "SELL", "BUY", "BUY", "SELL"]
    qty = [3, 2, 1, 2, 5, 4, 1, 2, 7, 6]
    df = fills(spark, sides, qty).withColumn("total_cost", F.col("price") * F.col("quantity"))
    got = frame(trades.average_cost_trips(df, max_rows=rows), "ts")
    pos, cost, want = 0, 0.0, []
    for r in frame(df, "ts").itertuples():
        if r.side == "BUY":
            pos, cost = pos + r.quantity, cost + r.total_cost
        elif pos > 0:
            q = min(r.quantity, pos)
            basis = cost / pos * q
            want.append(r.total_cost - basis)
            pos, cost = pos - q, cost - basis
    assert got["pnl"].tolist() == pytest.approx(want)


def test_balanced_multipliers_move_towards_balance(bars):
    cfg = labels.FirstHitConfig(horizon_minutes=10, multiplier=2.0, atr_return_max=5.0)
    only = bars.where("symbol = 'HOT'")
    m = labels.balance_multipliers(only, cfg, passes=4, min_directional=10, tolerance=0.05, lo=0.1, hi=5.0)

    def gap(mult):
        c = labels.first_hit_labels(only, cfg, mult).groupBy("label").count().toPandas().set_index("label")["count"]
        return abs(c.get(1, 0) / max(c.get(-1, 0), 1) - 1.0)

    assert m.count() == 1 and gap(m) <= gap(None) + 1e-9


def test_majority_label_ties_are_neutral(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", -1), (2, "a", 1), (2, "b", -1)], "ts long, symbol string, label int")
    assert dict(labels.majority_label(df).select("ts", "label").collect()) == {1: 1, 2: 0}


def deviation_loop(g, gap):
    """The rule as a plain loop over one symbol."""
    sd = g["dev"].std()
    out, last, pos = [], None, None
    for r in g.itertuples():
        minute, day = r.ts // MIN % 1440, r.ts // (1440 * MIN)
        if last is not None and r.ts - last < gap:
            continue
        if minute >= 1255:
            if pos:
                out.append((r.ts, "end_of_day_hard_close"))
                last, pos = r.ts, None
            continue
        if pos:
            side, entry, stop, take, eday = pos
            s = 1 if side == "long" else -1
            why = ("same_day_forced_close" if day > eday else "mean_reversion_exit" if r.dev * s > sd * 0.1
                   else "intraday_stop_loss" if (r.close - entry) * s < -entry * stop else "intraday_take_profit" if (r.close - entry) * s > entry * take else None)
            if why:
                out.append((r.ts, why))
                last, pos = r.ts, None
                continue
        if pos is None and minute < 1170 and abs(r.dev) > sd * 0.6:
            side = "long" if r.dev < 0 else "short"
            pos = (side, r.close, min(r.atr / r.close, 0.02), min(1.5 * r.atr / r.close, 0.03), day)
            out.append((r.ts, side))
            last = r.ts
    return out


@pytest.mark.parametrize("rows", [100_000, 60])
def test_deviation_signals(spark, rows):
    from conftest import OPEN, make_bars, walk

    # bars every 20 minutes over several days
    df = make_bars(spark, {"A": walk(400, 1), "B": walk(300, 4)}, start=OPEN, step=20 * MIN)
    df = df.withColumns({"v": F.lit(1000.0) + F.col("volume"), "atr": F.lit(8.0) + F.col("volume") % 7})
    got = frame(signals.deviation_signals(df, "v", "atr", 25, max_rows=rows), "symbol", "ts")
    for sym, g in frame(df, "symbol", "ts").groupby("symbol"):
        want = deviation_loop(g.assign(dev=(g["close"] - g["v"]) / g["v"]), 25 * MIN)
        mine = got[got["symbol"] == sym]
        tag = [r.exit_reason if r.signal_type == "exit" else ("long" if r.side == "buy" else "short") for r in mine.itertuples()]
        assert list(zip(mine["ts"], tag, strict=True)) == want and len(want) > 20


def hit_loop(g, horizon):
    out = []
    for i, r in enumerate(g.itertuples()):
        label = 0
        for later in g.iloc[i + 1 :].itertuples():
            if later.ts > r.ts + horizon:
                break
            move = (later.close - r.close) / r.close
            if move >= r.threshold_long or move <= -r.threshold_short:
                label = 1 if move >= r.threshold_long else -1
                break
        out.append(label if r.close > 0 else 0)
    return out


@pytest.mark.parametrize("rows", [10_000, 60])
@pytest.mark.parametrize("step", [MIN, MIN // 6])
def test_first_hit_labels_equal_a_loop(spark, rows, step):
    from conftest import make_bars, walk

    df = make_bars(spark, {"A": walk(230, 1), "B": walk(90, 5), "C": walk(1, 3)}, step=step)
    cfg = labels.FirstHitConfig(horizon_minutes=7, multiplier=1.5, atr_return_max=5.0)
    got = frame(labels.first_hit_labels(df, cfg, max_rows=rows), "symbol", "ts")
    want = [x for _, g in got.groupby("symbol") for x in hit_loop(g, 7 * MIN)]
    assert got["label"].tolist() == want and set(want) == {-1, 0, 1}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(float("nan")), st.integers(-9, 9).map(float)), max_size=30), st.integers(0, 35), st.integers(1, 9))
def test_first_crossing_equals_a_loop(values, width, bound):
    import numpy as np

    from tapeworks.operators.jumps import first_crossing

    x = np.array(values, float)
    until = np.minimum(np.arange(len(x)) + 1 + width, len(x))
    got = first_crossing(x, until, lambda i, high, low: (high - x[i] >= bound) | (low - x[i] <= -bound))
    want = [next((j for j in range(i + 1, until[i]) if abs(x[j] - x[i]) >= bound), max(until[i], i + 1)) for i in range(len(x))]
    assert got.tolist() == want


@pytest.mark.parametrize("batch", [7, 10_000])
def test_batches_do_not_change_labels(spark, bars, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = frame(labels.first_hit_labels(bars, labels.FirstHitConfig(horizon_minutes=20, atr_return_max=5.0)), "symbol", "ts")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["label"].tolist() == [x for _, g in got.groupby("symbol") for x in hit_loop(g, 20 * MIN)]
