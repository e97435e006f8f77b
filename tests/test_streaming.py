"""Streams fed file by file agree with the batch answer; late rows are dropped."""

from __future__ import annotations

from conftest import MIN, OPEN, frame, make_bars, walk
from pyspark.sql import functions as F

from tapeworks.functions.timecols import event_time
from tapeworks.operators import signals
from tapeworks.streaming import jobs


def files(spark, df, path, n):
    """One file per contiguous time slice, so that each micro-batch is one slice."""
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    for i in range(n):
        a, b = lo + (hi - lo + 1) * i // n, lo + (hi - lo + 1) * (i + 1) // n
        df.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ticks(spark):
    b = make_bars(spark, {"A": walk(120, 1), "B": walk(120, 5)})
    return b.select("symbol", "ts", F.col("close").alias("price"), F.col("volume").alias("size"), F.col("ts").alias("seq"), event_time("ts").alias("event_time"))


def test_stream_bars_equal_batch_windows(spark, tmp_path):
    t = ticks(spark)
    got = frame(jobs.run_available(jobs.resample_stream(files(spark, t, str(tmp_path / "t"), 4), "10 minutes", "5 minutes")), "symbol", "start")
    want = t.groupBy("symbol", F.window("event_time", "10 minutes").alias("w")).agg(F.sum("size").alias("volume"), F.max_by("price", "ts").alias("close")).toPandas()
    key = {(r.symbol, r.w["start"]): (r.volume, r.close) for r in want.itertuples()}
    assert len(got) >= 20
    for r in got.itertuples():
        assert key[(r.symbol, r.start.to_pydatetime())] == (r.volume, r.close)


def test_late_ticks_are_dropped(spark, tmp_path):
    t = ticks(spark)
    path = str(tmp_path / "t")
    early = t.where(F.col("ts") < OPEN + 10 * MIN)
    t.where(F.col("ts") >= OPEN + 10 * MIN).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.resample_stream(stream, "10 minutes", "1 minute")
    root = str(tmp_path / "state")

    def drive():
        q = query.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    drive()
    early.coalesce(1).write.mode("append").parquet(path)
    drive()
    out = spark.read.parquet(root + "/out")
    first = early.agg(F.min("event_time")).first()[0]
    assert out.where(F.col("start") <= F.lit(first)).count() == 0 and out.count() > 0


def test_stream_cooldown_equals_batch(spark, tmp_path):
    s = ticks(spark).where("size % 2 = 0").select("symbol", "ts")
    got = frame(jobs.run_available(jobs.cooldown_stream(files(spark, s, str(tmp_path / "s"), 3), 7)), "symbol", "ts")
    assert got.equals(frame(signals.cooldown(s, 7), "symbol", "ts"))


def test_stream_dedupe_across_files(spark, tmp_path):
    t = ticks(spark)
    path = str(tmp_path / "d")
    t.coalesce(1).write.parquet(path)
    t.where("size % 3 = 0").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert jobs.run_available(jobs.dedupe_stream(stream, ["symbol", "ts"])).count() == t.count()


def test_stream_out_of_order_equals_batch(spark, tmp_path):
    """Files that overlap in time, each in no order: the result is that of the sorted rows."""
    s = ticks(spark).where("size % 2 = 0").select("symbol", "ts")
    path = str(tmp_path / "o")
    for i in (1, 0, 3, 2):
        # every file holds a quarter of an hour range, and files of a pair swap places
        s.where(F.floor((F.col("ts") - OPEN) / (30 * MIN)) == i).orderBy(F.rand(i)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    got = frame(jobs.run_available(jobs.cooldown_stream(stream, 7, lateness="60 minutes")), "symbol", "ts")
    last = s.agg(F.max("ts")).first()[0]
    want = frame(signals.cooldown(s, 7), "symbol", "ts")
    want = want[want["ts"] <= last - 60 * MIN].reset_index(drop=True)
    assert got.equals(want) and len(want) > 10


def test_state_of_an_idle_symbol_is_deleted(spark, tmp_path):
    rows = [("OLD", OPEN + i * MIN, True, False) for i in range(3)] + [("NEW", OPEN + i * MIN, i == 0, False) for i in range(0, 600, 20)] + [("OLD", OPEN + 700 * MIN, False, False)]
    df = spark.createDataFrame(rows, "symbol string, ts long, enter boolean, leave boolean")
    out = jobs.run_available(jobs.bars_held_stream(files(spark, df, str(tmp_path / "i"), 7), 10_000, idle="60 minutes"))
    old = frame(out.where("symbol = 'OLD'"), "ts")["bars_held"].tolist()
    new = frame(out.where("symbol = 'NEW'"), "ts")["bars_held"].tolist()
    # the position of the symbol that fell silent is gone, that of the other one is still held
    assert old == [1, 2, 3, 0] and new == list(range(1, 31))


def test_rows_of_equal_time_follow_their_sequence(spark, tmp_path):
    # the entry comes first by sequence and last in the file
    rows = [("A", OPEN, 2, False, True), ("A", OPEN, 1, True, False), ("A", OPEN + MIN, 3, False, False)]
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, enter boolean, leave boolean").coalesce(1)
    out = jobs.run_available(jobs.bars_held_stream(files(spark, df, str(tmp_path / "q"), 1), 10))
    # in the order of the file the position would still be held
    assert sorted((r.ts, r.bars_held) for r in out.collect()) == [(OPEN, 0), (OPEN, 1), (OPEN + MIN, 0)]


def test_state_is_written_by_stretch_not_by_row():
    import pandas as pd

    class Store(dict):
        puts = 0

        def updateValue(self, *a):
            self.puts += 1
            self[a[0] if len(a) == 2 else None] = a[-1]

        def getValue(self, k):
            return self[k]

        update = lambda self, v: self.updateValue(v)
        get = lambda self: self[None]
        exists = lambda self: None in self
        containsKey = lambda self, k: k in self
        removeKey = lambda self, k: self.pop(k)
        keys = lambda self: iter(list(dict.keys(self)))

    class Handle:
        def __init__(self):
            self.value, self.map, self.timers = Store(), Store(), []

        getValueState = lambda self, *a: self.value
        getMapState = lambda self, *a: self.map
        listTimers = lambda self: list(self.timers)
        registerTimer = lambda self, t: self.timers.append(t)
        deleteTimer = lambda self, t: self.timers.remove(t)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    machine = jobs._InOrder(lambda s, rows: ({"n": s["n"] + len(rows)}, rows), {"n": 0}, ["symbol", "ts"], 10**9)
    handle = Handle()
    machine.init(handle)
    start = OPEN // 3_600_000_000_000 * 3_600_000_000_000
    rows = pd.DataFrame({"symbol": "A", "ts": [start + i * 1_000_000_000 for i in reversed(range(3000))]})
    assert not list(machine.handleInputRows(("A",), iter([rows[:2000], rows[2000:]]), At(0)))
    assert handle.map.puts == 1  # before: one a row
    got = [x for ms in (1500, 10_000) for x in machine.handleExpiredTimer(("A",), At(start // 10**6 + ms * 1000), None)]
    assert [len(x) for x in got] == [1501, 1499] and pd.concat(got)["ts"].is_monotonic_increasing and not list(handle.map.keys())
