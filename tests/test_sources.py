"""Readers and writers on temporary folders."""

from __future__ import annotations

import json

import pytest
from conftest import MIN, OPEN, frame, make_bars, walk
from pyspark.sql import functions as F

from tapeworks.operators import quality, setops
from tapeworks.operators.datasets import purged_folds, split_by_symbol, split_problems, walk_forward_periods
from tapeworks.operators.joins import apply_overrides, deep_merge, join_unique
from tapeworks.registry import default_registry, policy
from tapeworks.sources import bars as src
from tapeworks.sources import membership, runs


def test_bars_round_trip_prunes_and_filters(spark, bars, tmp_path):
    root = str(tmp_path / "bars")
    src.write_bars(bars, root)
    back = src.read_bars(spark, root, symbols=["mid"], start="2024-01-09", end="2024-01-09")
    assert back.count() == 60 and back.select("symbol").distinct().collect()[0][0] == "MID"
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert src.read_bars(spark, root, start="2024-02-01").count() == 0
    assert src.read_bars(spark, root, columns=["close"]).columns == ["symbol", "ts", "close"]


def test_symbol_from_path(spark, bars, tmp_path):
    rows = bars.where("symbol = 'MID'").drop("symbol").toPandas()
    folder = tmp_path / "MID" / "2024"
    folder.mkdir(parents=True)
    rows.to_parquet(folder / "2024-01.parquet")
    df = src.read_symbol_files(spark, str(tmp_path / "*" / "*" / "*.parquet"))
    assert df.count() == 60 and df.select("symbol").distinct().collect()[0][0] == "MID"


def test_normalise_raw_names_and_units(spark):
    raw = spark.createDataFrame(
        [(OPEN // 1_000_000, "abc", "1.5", 2.0, 1.0, 1.2, 10.7), (OPEN // 1000, "abc", "x", 2.0, -1.0, 1.2, None), (0, "abc", "1", 1.0, 1.0, 1.0, 1.0),
         (OPEN + 60, "abc", "1", float("nan"), 1.0, 1.0, float("nan"))], "t long, T string, o string, h double, l double, c double, v double")
    got = frame(src.normalise_bars(raw), "ts")
    assert got["ts"].tolist() == [OPEN, OPEN + 60] and got["symbol"].unique().tolist() == ["ABC"]
    assert got["volume"].tolist() == [10, 0] and got["high"].isna().tolist() == [False, True]


def test_dedupe_is_deterministic(spark):
    df = spark.createDataFrame([("A", 1, 5.0, 2), ("A", 1, 4.0, 1), ("A", 2, 1.0, 9)], "symbol string, ts long, close double, seq int")
    got = frame(src.dedupe(df.repartition(3), prefer=["seq"]), "ts")
    assert got["close"].tolist() == [4.0, 1.0]


def test_membership_overwrites_only_touched_days(spark, tmp_path):
    root = str(tmp_path / "m")
    rows = spark.createDataFrame([("2024-01-01", "A", True), ("2024-01-02", "A", False)], "trade_date string, symbol string, is_sip boolean")
    membership.write_membership(rows, root)
    membership.write_membership(spark.createDataFrame([("2024-01-02", "B", True)], rows.schema), root)
    both = membership.read_membership(spark, root, "2024-01-01", "2024-01-31", "all")
    assert sorted((r.trade_date, r.symbol) for r in both.collect()) == [("2024-01-01", "A"), ("2024-01-02", "B")]
    with pytest.raises(ValueError):
        membership.read_membership(spark, root, "a", "b", "other")


def test_run_artefacts(spark, tmp_path):
    for run, pnl in (("r1", 1.0), ("r2", -2.0)):
        d = tmp_path / "runs" / run
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(json.dumps({"trading": {"total_trades": 3}, "performance": {"total_return": pnl}}, indent=1))
        spark.createDataFrame([(run, pnl)], "x string, pnl double").coalesce(1).write.parquet(str(d / "trades.parquet"))
    (tmp_path / "exp" / "e1").mkdir(parents=True)
    (tmp_path / "exp" / "e1" / "manifest.json").write_text(json.dumps({"name": "n", "run_ids": ["r1", "r2"]}))
    m = runs.read_run_json(spark, str(tmp_path / "runs"))
    assert dict(m.select("run_id", "performance.total_return").collect()) == {"r1": 1.0, "r2": -2.0}
    e = runs.read_experiments(spark, str(tmp_path / "exp"))
    assert sorted(map(tuple, e.collect())) == [("e1", "r1"), ("e1", "r2")]


def test_csv_features_and_splits(spark, bars, tmp_path):
    df = split_by_symbol(bars.select("symbol", "ts", "close"))
    runs.write_splits(df, str(tmp_path / "d"), "csv")
    back = runs.read_splits(spark, str(tmp_path / "d"), "symbol string, ts long, close double, split string", "csv")
    assert back.count() == df.count()
    assert split_problems(df.where("symbol = 'HOT'")).where("count > 0").count() == 0


def test_schema_inventory_and_first_files(spark, bars, tmp_path):
    bars.repartition(3).write.parquet(str(tmp_path / "fam"))
    inv = src.schema_inventory(spark, str(tmp_path)).collect()[0]
    assert inv["family"] == "fam" and inv["rows"] == bars.count() and inv["files"] >= 2
    assert src.first_files_sample(spark, str(tmp_path), 1).select("source_file").distinct().count() == 1


def test_inventory_parses_paths_once_a_file(spark, bars, tmp_path):
    for name, n in (("a", 2), ("b", 3)):
        bars.repartition(n).write.parquet(str(tmp_path / name))
    inv = src.schema_inventory(spark, str(tmp_path))
    assert [(r.family, r.files, r.rows) for r in inv.orderBy("family").collect()] == [("a", 2, bars.count()), ("b", 3, bars.count())]
    plan = inv._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = max(i for i, line in enumerate(plan) if "Aggregate" in line)  # the aggregation nearest to the files
    assert not any("regexp" in line for line in plan[first + 1 :])


def test_validators(spark, bars):
    assert quality.validate(bars, "bars").where("violations > 0").count() == 0
    with pytest.raises(ValueError):
        quality.validate(bars.drop("open"), "bars")
    with pytest.raises(ValueError):
        quality.validate(bars, "nonsense")
    rejects = spark.createDataFrame([(1, "A", None, "x"), (0, "A", "r", "x")], "ts long, symbol string, reason_code string, limit_name string")
    got = dict(quality.validate(rejects, "risk_rejects").collect())
    assert got["reason_code_missing"] == 1 and got["ts_not_positive"] == 1


def test_join_unique_raises_on_duplicates(spark):
    left = spark.createDataFrame([(1,)], "k int")
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate keys"):
        join_unique(left, dup, ["k"]).collect()


def test_hashes_ignore_order_but_not_values(bars):
    h = lambda df: setops.table_hash(df).first()["hash"]
    assert h(bars) == h(bars.repartition(5, "close"))
    assert h(bars) != h(bars.withColumn("close", F.col("close") + 0.01))
    assert h(bars) != h(bars.unionByName(bars.limit(1)))


def test_folds_never_leak(spark):
    days = list(range(100, 200, 2))
    for f in purged_folds(days, 5, purge_days=4):
        assert f["train_to"] + 4 < f["val_from"] <= f["val_to"]
    for f in walk_forward_periods(list(range(0, 900)), 6, 1, 2, 2):
        assert f["train_to"] < f["val_from"] <= f["val_to"] < f["oos_from"] <= f["oos_to"]


@pytest.mark.parametrize("window", ["rolling", "expanding"])
@pytest.mark.parametrize("gaps", [(1,), (1, 3), (1, 1, 40), (97,)])
def test_walk_forward_rule(window, gaps):
    days = [100]
    while days[-1] < 1500:
        days.append(days[-1] + gaps[len(days) % len(gaps)])
    after = lambda target: min((d for d in days if d >= target), default=None)
    begin, want = days[0], []
    while begin is not None:
        ends = [after(begin + 30 * 4)]
        for months in (2, 1):
            ends.append(after(ends[-1] + 1 + 30 * months) if ends[-1] is not None else None)
        if None in ends:
            break
        want.append((begin, ends[0], ends[0] + 1, ends[1], ends[1] + 1, ends[2]))
        following = after((begin if window == "rolling" else ends[1] + 1) + 30 * 2)
        begin = following if following is None or following > begin else after(begin + 1)
    got = walk_forward_periods(days, 4, 2, 1, 2, window)
    assert [tuple(f[k] for k in ("train_from", "train_to", "val_from", "val_to", "oos_from", "oos_to")) for f in got] == want
    assert [f["fold"] for f in got] == list(range(1, len(want) + 1)) and len(want) > 2
    assert walk_forward_periods([], 4, 2, 1, 2, window) == []
    late = walk_forward_periods(days, 4, 2, 1, 2, window, start=days[3] - 1)
    assert late[0]["train_from"] == after(days[3] - 1)


def test_config_helpers():
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}}
    base = {"a": {"b": 1}}
    assert apply_overrides(base, {"a.b": 3, "x.y": 1}) == {"a": {"b": 3}, "x": {"y": 1}} and base == {"a": {"b": 1}}


def test_registry(spark, bars):
    r = default_registry()
    r.register("twice", lambda df, by=2: df.withColumn("twice", F.col("close") * by))
    r.register_pack("mine", [("twice", {}), ("avwap", {})])
    out = r.apply_config(bars, [{"type": "mine", "params": {}}])
    assert {"twice", "f__anchor__session_avwap"} <= set(out.columns)
    assert r.validate([{"type": "nope"}, {}]) and "mine" in r.names()
    with pytest.raises(ValueError):
        r.apply(bars.drop("volume"), "vpa")
    with pytest.raises(ValueError):
        policy("none")


def test_daylight_saving_sessions(spark):
    # the first trading days after the clocks change in March and November 2024
    from tapeworks.operators.features_anchored import session_anchors

    spring, autumn = 1710163800000000000, 1730730600000000000
    df = make_bars(spark, {"A": walk(2, 1)}, start=spring).unionByName(make_bars(spark, {"B": walk(2, 1)}, start=autumn))
    got = frame(session_anchors(df), "symbol", "ts")
    assert got["session_start_ns"].iloc[0] == spring and got["session_start_ns"].iloc[2] == autumn


def test_validated_load(spark, bars, tmp_path):
    from tapeworks.sources.bars import read_bars, write_bars

    write_bars(bars, str(tmp_path / "good"))
    good = read_bars(spark, str(tmp_path / "good"), validate=True)
    assert good.count() == bars.count()
    low = bars.agg(F.min("ts")).first()[0]
    write_bars(bars.withColumn("high", F.when((F.col("ts") == low) & (F.col("symbol") == "HOT"), F.col("low") - 1).otherwise(F.col("high"))), str(tmp_path / "bad"))
    assert read_bars(spark, str(tmp_path / "bad")).count() == bars.count()
    with pytest.raises(Exception, match=f"invalid row: high_below_low HOT {low}"):
        read_bars(spark, str(tmp_path / "bad"), validate=True).collect()


def test_window_trim_and_labels(spark, bars):
    from tapeworks.operators.datasets import trim_to_window, with_big_move_labels

    day = bars.select(F.date_format(F.timestamp_seconds((F.col("ts") / 10**9).cast("long")), "yyyy-MM-dd")).first()[0]
    assert trim_to_window(bars, day, day).count() == bars.count() and trim_to_window(bars, "2020-01-01", "2020-01-31").count() == 0
    with pytest.raises(Exception, match="without a time"):
        trim_to_window(bars.withColumn("ts", F.lit(None).cast("long")), day, day).collect()
    out = with_big_move_labels(bars.withColumn("atr", F.lit(5.0)), 3, "atr", 1.0, 0.0)
    assert out.count() == bars.count() and out.where("big_move = 1 AND direction = 0 AND forward_return <> 0").count() == 0
    with pytest.raises(ValueError):
        with_big_move_labels(bars, 3, "atr", 1.0, 0.0)


def _daily_bars(spark, days: int = 150, symbols: str = "AB"):
    day = 1440 * MIN
    start = OPEN // day * day
    rows = [(s, start + d * day + k * MIN, 10.0 + k, 11.0 + k, 9.0, 10.5, 100 + d) for s in symbols for d in range(days) for k in range(2)]
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume long")


def test_overlapping_windows_read_only_new_months(spark, tmp_path):
    from tapeworks.sources.windows import BarWindows, write_months

    write_months(_daily_bars(spark), str(tmp_path / "m"), files_per_month=2)
    reads = spark.sparkContext.accumulator(0)

    def counted(rows):
        def see(batches):
            for b in batches:
                reads.add(len(b))
                yield b

        return rows.mapInPandas(see, rows.schema)

    cache = BarWindows(spark, str(tmp_path / "m"), keep=2, prepare=counted)
    with cache.window("2024-01-20", "2024-03-10") as bars:
        assert bars.count() == 2 * 2 * 51 and bars.agg({"volume": "max"}).first()[0] == 161
        first = reads.value
        assert first == 2 * 2 * (23 + 29 + 31)  # whole months, each row once for both actions
        with cache.window("2024-02-15", "2024-04-05", symbols=["a"]) as more:
            assert more.count() == 2 * (15 + 31 + 5)
            assert reads.value - first == 2 * 2 * 30  # April only
        assert cache.held == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert cache.held == ["2024-04"]
    with cache.slice(OPEN, OPEN + 1) as none:
        assert none.count() == 0
    with cache.window("2030-01-01", "2030-02-01") as none:
        assert none.count() == 0
    cache.close()
    assert cache.held == []
    with pytest.raises(ValueError):
        cache.window("2024-02-01", "2024-01-01")


def test_manifest_rehashes_only_changed_months(spark, tmp_path):
    from tapeworks.sources import manifest
    from tapeworks.sources.windows import write_months

    root, cols = str(tmp_path / "m"), ["close", "volume"]
    bars = _daily_bars(spark)
    write_months(bars, root)
    manifest.write_tree(spark, root, str(tmp_path / "t1"), cols)
    old = manifest.read_tree(spark, str(tmp_path / "t1"))
    direct = manifest.hash_tree(manifest.leaf_hashes(bars.repartition(3), cols))
    assert sorted(map(str, old.collect())) == sorted(map(str, direct.collect()))  # files and row order leave no trace
    assert manifest.refresh_tree(spark, root, str(tmp_path / "t1"), str(tmp_path / "t2"), cols) == []

    march = bars.where(manifest.month_of() == "2024-03").withColumn("close", F.col("close") + F.when(F.col("symbol") == "B", 1.0).otherwise(0.0))
    march.write.mode("overwrite").parquet(f"{root}/month=2024-03")
    assert manifest.refresh_tree(spark, root, str(tmp_path / "t2"), str(tmp_path / "t3"), cols) == ["2024-03"]
    new = manifest.read_tree(spark, str(tmp_path / "t3"))
    assert manifest.changed_months(old, new).collect() == [("2024-03", "changed")]
    assert manifest.changed_leaves(old, new).collect() == [("2024-03", "B", "changed")]
    assert manifest.changed_leaves(old, old).count() == 0
    kinds = manifest.changed_leaves(old, manifest.hash_tree(manifest.leaf_hashes(bars.where("symbol = 'A'"), cols)))
    assert {(r.symbol, r.change) for r in kinds.collect()} == {("B", "removed")}


def test_leaf_hashes_see_repeats_nulls_and_odd_values(spark):
    from tapeworks.sources import manifest

    def root(rows):
        df = spark.createDataFrame(rows, "symbol string, ts long, close double")
        return manifest.hash_tree(manifest.leaf_hashes(df, ["close"])).where("level = 'root'").first()["hash"]

    seen = [root(r) for r in ([("A", OPEN, 1.0)], [("A", OPEN, 1.0)] * 2, [("A", OPEN, 1.0)] * 3, [("A", OPEN, None)], [("A", OPEN, float("nan"))],
                              [("A", OPEN, float("inf"))], [(None, OPEN, 1.0)], [("A", OPEN, 1e300)], [])]
    assert len(set(seen)) == len(seen)


def test_full_manifest_changes_with_each_part(spark):
    from tapeworks.sources.manifest import full_manifest

    bars = _daily_bars(spark, 40)
    chosen = spark.createDataFrame([("A", 10.5, 100), ("B", 10.5, 100)], "symbol string, close double, volume long")
    splits = {"train": ("2024-01-09", "2024-01-31"), "oos": ("2024-02-01", "2024-02-10")}

    def of(df=bars, features=("open", "close"), config=None, universe=chosen):
        return full_manifest(df, list(features), "volume", config or {"b": 1, "a": [1, 2]}, universe, splits).first().asDict()

    base = of()
    assert (base["rows"], base["symbols"], base["train_rows"], base["oos_rows"], base["train_range"]) == (160, 2, 92, 40, "2024-01-09..2024-01-31")
    assert of(df=bars.repartition(2), config={"a": [1, 2], "b": 1}) == base
    hashes = [k for k in base if k.endswith("_hash")]
    for part, other in (("config_hash", of(config={"a": 1})), ("universe_hash", of(universe=chosen.limit(1)))):
        assert [k for k in hashes if other[k] != base[k]] == [part]
    moved = of(df=bars.withColumn("volume", bars["volume"] + 1))
    assert [k for k in hashes if moved[k] != base[k]] == ["data_hash"]


def test_raw_milliseconds_are_exact(spark, tmp_path):
    from tapeworks.catalog.tables import raw_ticks

    # through DOUBLE this time would lose a millisecond
    ms = 1704546846418
    t = spark.sql(f"SELECT 2L AS event_id, CAST(timestamp_millis({ms}) AS TIMESTAMP_NTZ) AS ts, 1L AS user_id, 'view' AS event_type, 25.31D AS value, '{{\"k\": 1}}' AS props")
    t.write.parquet(str(tmp_path / "events.parquet"))
    assert raw_ticks(spark, str(tmp_path)).first().t == ms


def test_changed_leaves_derive_the_bars_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["k10_changed_leaves"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # before, each of the two versions derived them anew, once for the months and once for the leaves
    assert "l_shipdate" not in plan and "Exchange" in plan
