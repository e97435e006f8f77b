"""Windows over one long series per key, without ever putting a whole hot key into one task.

``Window.partitionBy("symbol")`` sends all rows of a symbol to one task.  That is the right plan while
every symbol is of ordinary length, and hopeless when one symbol holds a third of a large table.
``split_series`` counts rows per (key, time bucket) - two columns, combined map side - and only when a key
exceeds ``max_rows`` cuts that key's series into segments of whole buckets: days, or parts of a day where one day holds too much.  Each segment also receives the
rows just before (``lookback``) and after (``lookahead``) it, marked ``_halo``, so that ROWS frames of bounded
width give exactly the rows they would see over the whole series.  Unbounded frames are answered as
"segment-local running value + carry of all earlier segments" by ``Frame.running``.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import DAY_NS, bucket_ns

SEGMENT_ROWS = 4_000_000
BROADCAST_ROWS = 500_000
_SEG, _HALO, _BUCKET = "_seg", "_halo", "_bucket"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a scratch folder only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tapeworks-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a shared folder")


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate table; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a file in the shared folder: for large tables that are read more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    root = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(root)
    return df.sparkSession.read.schema(df.schema).parquet(root)


def segment_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.tapeworks.segmentRows", str(SEGMENT_ROWS)))


@dataclass(frozen=True)
class Frame:
    """A table together with the partitioning its windows must use."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False

    @property
    def part(self) -> tuple[str, ...]:
        return (*self.keys, _SEG) if self.split else self.keys

    @property
    def core(self) -> Column:
        return ~F.col(_HALO) if self.split else F.lit(True)

    def w(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.part, *extra).orderBy(*self.order)

    def roll(self, n: int) -> WindowSpec:
        return self.w().rowsBetween(-(n - 1), 0)

    def prior(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.w().rowsBetween(-n, -1)

    def lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w())

    def lead(self, c: Column | str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w())

    def agg(self, fn: Callable[[Column], Column], c: Column | str, n: int, mp: int | None = None) -> Column:
        """Rolling aggregate over n rows, NULL until ``mp`` non-missing values (default: n) are seen."""
        x = F.col(c) if isinstance(c, str) else c
        need = n if mp is None else mp
        value = fn(x).over(self.roll(n))
        return value if need <= 1 else F.when(F.count(x).over(self.roll(n)) >= need, value)

    def prior_agg(self, fn: Callable[[Column], Column], c: Column | str, n: int, mp: int) -> Column:
        """``agg`` as of the previous row: the window of n rows ending one row back."""
        x = F.col(c) if isinstance(c, str) else c
        return F.when(F.count(x).over(self.prior(n)) >= mp, fn(x).over(self.prior(n)))

    def sums(self, windows: Iterable[int], **cols: Column | str) -> Frame:
        """Sums and counts over the trailing ``windows`` rows, read by ``total`` and ``mean``.

        A sliding frame re-adds its n rows for every row; a difference of running sums loses small values after a large one, keeps an
        infinity for ever and depends on where a series is cut.  Here the sum of 2m rows is the sum of the last m plus the sum of the m
        before, and a window is put together from such runs: additions of its own rows only, about log2(n) lags over one sort, the same
        value wherever the series is cut.  Whole numbers use differences of running sums, which are exact for them, as counts do.
        Window values are columns of their own here, because Spark evaluates a window expression again for
        every place it is written; combinations that are not read are pruned by the optimizer.
        """
        windows = sorted(set(windows))
        if not windows:
            return self
        hist = self.w().rowsBetween(Window.unboundedPreceding, 0)
        f = self.with_cols(**{f"_val_{name}": F.col(x) if isinstance(x, str) else x for name, x in cols.items()})
        kinds = {name: f.df.schema[f"_val_{name}"].dataType for name in cols}
        whole = {name for name, t in kinds.items() if isinstance(t, T.IntegralType)}
        now = {f"_cnt_{name}": F.count(f"_val_{name}").over(hist) for name in cols}
        now |= {f"_sum_{name}": F.sum(f"_val_{name}").over(hist) for name in whole}
        # _run_<name>_<m>: the sum of the last m rows, m a power of two
        runs = {name: f"_run_{name}_1" for name in cols if name not in whole}
        f = f.with_cols(**now, **{c: F.coalesce(F.col(f"_val_{name}"), F.lit(0.0)) for name, c in runs.items()})
        m = 1
        while runs and 2 * m <= windows[-1]:
            f = f.with_cols(**{f"_run_{name}_{2 * m}": F.col(f"_run_{name}_{m}") + f._back(f"_run_{name}_{m}", m) for name in runs})
            m *= 2
        totals = {}
        for n in windows:
            for name in cols:
                totals[f"_cnt_{name}_{n}"] = F.col(f"_cnt_{name}") - F.coalesce(F.lag(f"_cnt_{name}", n).over(self.w()), F.lit(0))
                if name in whole:
                    totals[f"_sum_{name}_{n}"] = F.col(f"_sum_{name}") - F.coalesce(F.lag(f"_sum_{name}", n).over(self.w()), F.lit(0))
                else:
                    parts, back = [], 0
                    for k in reversed(range(n.bit_length())):
                        if n >> k & 1:
                            parts.append(f._back(f"_run_{name}_{1 << k}", back))
                            back += 1 << k
                    totals[f"_sum_{name}_{n}"] = reduce(operator.add, parts)
        return f.with_cols(**totals).drop(*(c for c in f.df.columns if c.startswith(("_val_", "_run_"))))

    def _back(self, c: str, n: int) -> Column:
        """The value n rows back, zero before the series begins."""
        return F.coalesce(F.lag(c, n).over(self.w()), F.lit(0.0)) if n else F.col(c)

    def seen(self, name: str, n: int) -> Column:
        """Non-missing values of a summed column in the last n rows."""
        return F.col(f"_cnt_{name}_{n}")

    def total(self, name: str, n: int, mp: int | None = None) -> Column:
        """Sum over the last n rows, NULL until ``mp`` (default n) non-missing values are seen."""
        return F.when(self.seen(name, n) >= (n if mp is None else mp), F.col(f"_sum_{name}_{n}"))

    def mean(self, name: str, n: int, mp: int | None = None) -> Column:
        return self.total(name, n, mp) / F.nullif(self.seen(name, n), F.lit(0))

    def drop_sums(self) -> Frame:
        return self.drop(*[c for c in self.df.columns if c.startswith(("_sum_", "_cnt_"))])

    def has_rows(self, n: int) -> Column:
        """At least n earlier rows exist."""
        return F.lag(F.lit(1), n).over(self.w()).isNotNull()

    def with_cols(self, **cols: Column) -> Frame:
        return replace(self, df=self.df.withColumns(cols))

    def drop(self, *names: str) -> Frame:
        return replace(self, df=self.df.drop(*names))

    def finish(self) -> DataFrame:
        return self.df.where(~F.col(_HALO)).drop(_SEG, _HALO) if self.split else self.df

    def running(
        self,
        specs: dict[str, tuple[str, Column]],
        extra: tuple[str, ...] = (),
        inclusive: bool = True,
    ) -> Frame:
        """Running values over the whole series: kind in sum, count, max, min, last, first.

        ``last``/``first`` skip missing values.  ``extra`` narrows the series (for example to one
        minute of the day).  ``inclusive=False`` stops one row short of the current row.
        """
        upto = 0 if inclusive else -1
        w = self.w(*extra).rowsBetween(Window.unboundedPreceding, upto)
        if not self.split:
            return self.with_cols(**{o: _agg(kind, x).over(w) for o, (kind, x) in specs.items()})

        masked = {o: (kind, F.when(self.core, x)) for o, (kind, x) in specs.items()}
        keyed = (*self.keys, *extra)
        ordered = {"last", "first"}
        pos = F.struct(*self.order)
        totals = self.df.groupBy(*keyed, _SEG).agg(
            *[
                (
                    (F.max_by if kind == "last" else F.min_by)(x, F.when(x.isNotNull(), pos))
                    if kind in ordered
                    else _agg(kind, x)
                ).alias(f"_t_{o}")
                for o, (kind, x) in masked.items()
            ]
        )
        before = Window.partitionBy(*keyed).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *keyed,
            _SEG,
            *[_agg("sum" if kind == "count" else kind, F.col(f"_t_{o}")).over(before).alias(f"_c_{o}")
              for o, (kind, _) in masked.items()],
        )
        local = self.df.withColumns({f"_l_{o}": _agg(kind, x).over(w) for o, (kind, x) in masked.items()})
        joined = local.join(carry, [*keyed, _SEG], "left")
        out = joined.withColumns(
            {o: _combine(kind, F.col(f"_c_{o}"), F.col(f"_l_{o}")) for o, (kind, _) in masked.items()}
        ).drop(*[f"_{p}_{o}" for o in masked for p in "cl"])
        return replace(self, df=out)


def _agg(kind: str, x: Column) -> Column:
    if kind == "last":
        return F.last(x, ignorenulls=True)
    if kind == "first":
        return F.first(x, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](x)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull() & local.isNull(), F.lit(None)).otherwise(
            F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry) if kind == "last" else F.coalesce(carry, local)


def segment_layout(
    df: DataFrame, keys: Iterable[str], ts: str, max_rows: int, lookback: int, lookahead: int, bucket: int
) -> DataFrame:
    """(keys, _bucket) -> array of (segment, is halo), for the buckets of keys longer than max_rows only."""
    keys = list(keys)
    per_key = Window.partitionBy(*keys)
    in_order = per_key.orderBy(_BUCKET)
    counts = df.groupBy(*keys, bucket_ns(ts, bucket).alias(_BUCKET)).agg(F.count(F.lit(1)).alias("n"))
    buckets = (
        counts.withColumn("total", F.sum("n").over(per_key))
        .where(F.col("total") > max_rows)
        .withColumn("end", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("seg", F.floor(F.col("start") / max_rows).cast("long"))
    )
    core = buckets.select(*keys, _BUCKET, "seg", F.lit(False).alias("halo"))
    last_seg = F.floor((F.col("end") + lookback - 1) / max_rows).cast("long")
    pieces = [core]
    if lookback > 0:
        # segment numbers in which no bucket starts don't exist and get no rows; one that starts beyond the reach needs none
        starts = buckets.groupBy(*keys, "seg").agg(F.min("start").alias("seg_start"))
        reaching = buckets.where(last_seg > F.col("seg")).select(*keys, _BUCKET, "end", F.explode(F.sequence(F.col("seg") + 1, last_seg)).alias("seg"))
        near = reaching.join(starts, [*keys, "seg"]).where(F.col("seg_start") < F.col("end") + lookback)
        pieces.append(near.select(*keys, _BUCKET, "seg", F.lit(True).alias("halo")))
    if lookahead > 0:
        # A segment ends where the next one starts; with max_rows >= 3 * lookahead at most two
        # earlier segments can reach into a bucket.
        segs = buckets.groupBy(*keys, "seg").agg(F.min("start").alias("seg_start"))
        by_seg = per_key.orderBy("seg")
        segs = segs.withColumns(
            {
                "prev1": F.lag("seg", 1).over(by_seg),
                "prev2": F.lag("seg", 2).over(by_seg),
                "prev2_end": F.lag("seg_start", 1).over(by_seg),
            }
        )
        reach = buckets.join(segs, [*keys, "seg"])
        for prev, end in (("prev1", "seg_start"), ("prev2", "prev2_end")):
            pieces.append(
                reach.where(F.col(prev).isNotNull() & (F.col("start") < F.col(end) + lookahead)).select(
                    *keys, _BUCKET, F.col(prev).alias("seg"), F.lit(True).alias("halo")
                )
            )
    layout = pieces[0]
    for p in pieces[1:]:
        layout = layout.unionByName(p)
    return layout.groupBy(*keys, _BUCKET).agg(
        F.collect_list(F.struct(F.col("seg").alias(_SEG), F.col("halo").alias(_HALO))).alias("_segs")
    )


def bucket_width(df: DataFrame, long_keys: DataFrame, keys: Iterable[str], ts: str, bucket: int, most: int) -> int:
    """The widest time bucket, from ``bucket`` down, of which none holds more than ``most`` rows of a long key.

    Rows of one timestamp can't be parted: they are ties in the order of the series.
    """
    rows = df.join(long_keys.select(*keys), list(keys), "left_semi")
    for parts in (1, 96, 96 * 60, 96 * 60 * 1000, 96 * 60 * 10**6):
        width = max(1, bucket // parts)
        full = rows.groupBy(*keys, bucket_ns(ts, width).alias(_BUCKET)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        if width == 1 or full.limit(1).count() == 0:
            return width
    return 1


def split_series(
    df: DataFrame,
    keys: Iterable[str] = ("symbol",),
    order: Iterable[str] = ("ts",),
    lookback: int = 0,
    lookahead: int | Callable[[], int] = 0,
    max_rows: int | None = None,
    bucket: int = DAY_NS,
    count_from: DataFrame | None = None,
) -> Frame:
    """Frame over df whose window partitions hold about ``max_rows`` rows at most (see module text).

    ``count_from`` is a cheaper table with the same (keys, time) rows to count instead of df.  A ``lookahead`` that takes a count of the data is
    asked for only when a key is long enough to be cut.
    """
    keys, order = tuple(keys), tuple(order)
    limit = max(max_rows or segment_rows(df.sparkSession), lookback, 0 if callable(lookahead) else 3 * lookahead)
    src = df if count_from is None else count_from
    sizes = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if sizes.where(F.col("n") > limit).limit(1).count() == 0:
        return Frame(df, keys, order)
    lookahead = lookahead() if callable(lookahead) else lookahead
    limit = max(limit, 3 * lookahead)
    long_keys = sizes.where(F.col("n") > limit)
    bucket = bucket_width(src, long_keys, keys, order[0], bucket, max(1, limit // 64))
    layout = settle(segment_layout(src, keys, order[0], limit, lookback, lookahead, bucket))
    size = layout.limit(BROADCAST_ROWS + 1).count()
    if size <= BROADCAST_ROWS:
        layout = F.broadcast(layout)
    whole = F.array(F.struct(F.lit(0).cast("long").alias(_SEG), F.lit(False).alias(_HALO)))
    cut = (
        df.withColumn(_BUCKET, bucket_ns(order[0], bucket))
        .join(layout, [*keys, _BUCKET], "left")
        .withColumn("_s", F.explode(F.coalesce("_segs", whole)))
        .select(*df.columns, f"_s.{_SEG}", f"_s.{_HALO}")
    )
    return Frame(cut, keys, order, split=True)


def rows_within(df: DataFrame, keys: Iterable[str], ts: str, horizon: int) -> int:
    """No more rows of a key than this lie within ``horizon`` after any of its rows: twice the fullest time slot of that length, at most."""
    slot = F.floor(F.col(ts) / horizon).alias("_slot")
    most = df.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return 2 * (most or 0) + 1


def look_ahead(frame: Frame, horizon: int, reads: list[str], compute: Callable[..., list[np.ndarray]], out: dict[str, T.DataType]) -> Frame:
    """Columns from the rows of the next ``horizon`` time units of a series, computed on arrays while streaming through every window partition.

    ``compute(time, columns, until)`` gets the rows at hand, the value columns ``reads`` as doubles, and for each row the position ``until`` before which its
    later rows within the horizon lie; it returns one array per output column.  A row leaves once a row beyond its horizon, or the end of its
    series, was seen: what is held is one batch and the rows of one horizon.
    """
    time = frame.order[0]
    df = frame.df.withColumn("_k", F.row_number().over(frame.w()))
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, t) for c, t in out.items()]])
    types = [pa.int64() if isinstance(t, T.LongType) else pa.float64() for t in out.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: pa.Table | None = None

        def ready(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
            at = rows.column(time).to_numpy()
            k = rows.column("_k").to_numpy()
            new = np.append(False, k[1:] == 1)
            if not (new[1:] | (k[1:] == k[:-1] + 1)).all():
                raise RuntimeError("rows of a series arrived out of order")
            series = np.cumsum(new)
            # how many rows lie before (series, time + horizon]: rows and horizon ends in one order
            order = np.lexsort((np.repeat([0, 1], len(at)), np.concatenate((at, at + horizon)), np.concatenate((series, series))))
            passed = np.cumsum(order < len(at))
            until = np.empty(2 * len(at), np.int64)
            until[order] = passed
            values = [rows.column(c).to_numpy().astype(np.float64) for c in reads]
            new_columns = compute(at, values, until[len(at) :])
            # the rows that are complete come first; the newest one never is
            done = len(at) if last else int(np.argmin((series < series[-1]) | (at + horizon < at[-1])))
            for c, x, t in zip(out, new_columns, types, strict=True):
                rows = rows.append_column(c, pa.array(x, t, from_pandas=True))
            return rows.slice(0, done), rows.slice(done).drop_columns(list(out))

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
                complete, held = ready(held, last=False)
                yield from complete.to_batches()
        if held is not None and held.num_rows:
            yield from ready(held, last=True)[0].to_batches()

    return replace(frame, df=df.mapInArrow(run, schema)).drop("_k")


# ---------------------------------------------------------------------------------------------
# Order-dependent folds


@dataclass(frozen=True)
class Fold:
    """A state machine over the rows of one series.

    ``run(rows, state) -> (output rows, state)`` consumes a pandas frame sorted by the order columns.
    ``exits(rows, states)`` gives the states that rows are left in, for many entry states at once (default: one run each).
    ``entries(rows, before)`` lists every state in which these rows can possibly be entered, given the
    ``lookback`` rows before them, and ``match(state, entries)`` picks the one that behaves like ``state``.  They are needed only for keys
    that are split: each segment is then run once per entry state, the segment results are chained on a
    table with a few rows per segment, and a last pass runs every segment with its true entry state.
    States are strings.
    """

    run: Callable[[pd.DataFrame, str], tuple[pd.DataFrame, str]]
    start: str
    entries: Callable[[pd.DataFrame, pd.DataFrame], list[str]]
    lookback: int = 0
    match: Callable[[str, list[str]], str] = lambda state, entries: state
    exits: Callable[[pd.DataFrame, list[str]], list[str]] | None = None

    def left_in(self, rows: pd.DataFrame, states: list[str]) -> list[str]:
        return self.exits(rows, states) if self.exits else [self.run(rows, s)[1] for s in states]


def fold_series(
    df: DataFrame,
    fold: Fold,
    out_fields: T.StructType,
    keys: Iterable[str] = ("symbol",),
    order: Iterable[str] = ("ts",),
    max_rows: int | None = None,
    bucket: int = DAY_NS,
) -> DataFrame:
    """Run a fold per key; output = whatever ``fold.run`` returns, with schema ``out_fields``."""
    keys, order = list(keys), list(order)
    frame = split_series(df, keys, order, lookback=fold.lookback, max_rows=max_rows, bucket=bucket)
    names = [f.name for f in out_fields.fields]

    if not frame.split:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            out, _ = fold.run(pdf.sort_values(order).reset_index(drop=True), fold.start)
            return out[names]

        return frame.df.groupBy(*keys).applyInPandas(whole, out_fields)

    seg_rows = frame.df
    key_fields = [df.schema[k] for k in keys]
    map_schema = T.StructType(
        [*key_fields, T.StructField(_SEG, T.LongType()),
         T.StructField("state_in", T.StringType()), T.StructField("state_out", T.StringType())]
    )

    def transitions(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order).reset_index(drop=True)
        before, rows = rows[rows[_HALO]], rows[~rows[_HALO]].reset_index(drop=True)
        states = fold.entries(rows, before) if len(rows) else []
        first = {c: pdf[c].iloc[0] for c in [*keys, _SEG]}
        return pd.DataFrame(
            [{**first, "state_in": a, "state_out": b} for a, b in zip(states, fold.left_in(rows, states), strict=True)],
            columns=[f.name for f in map_schema.fields],
        )

    chain_schema = T.StructType([*key_fields, T.StructField(_SEG, T.LongType()), T.StructField("_entry", T.StringType())])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = fold.start, []
        for seg, rows in pdf.sort_values(_SEG).groupby(_SEG, sort=True):
            out.append({**{k: rows[k].iloc[0] for k in keys}, _SEG: seg, "_entry": state})
            table = dict(zip(rows["state_in"], rows["state_out"], strict=True))
            state = table[fold.match(state, list(table))]
        return pd.DataFrame(out, columns=[f.name for f in chain_schema.fields])

    maps = seg_rows.groupBy(*keys, _SEG).applyInPandas(transitions, map_schema)
    entry = maps.groupBy(*keys).applyInPandas(chain, chain_schema)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order).reset_index(drop=True)
        out, _ = fold.run(rows.drop(columns=[_SEG, _HALO, "_entry"]), rows["_entry"].iloc[0])
        return out[names]

    core = seg_rows.where(frame.core).join(entry, [*keys, _SEG])
    return core.groupBy(*keys, _SEG).applyInPandas(final, out_fields)


def affine_scan(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compositions of y -> a y + b up to every row, beginning anew on ``first`` rows: slopes, offsets, and whether a first row was passed.

    The rows are cut into blocks side by side; products and sums run along all blocks at once, about sqrt(n) steps, and the block ends are
    composed the same way.  Nothing is divided, so factors of zero and long products are harmless.
    """
    n = len(a)
    deep = max(16, int(n**0.5))
    wide = -(-n // deep)
    pad = deep * wide - n

    def blocks(x: np.ndarray, fill: float) -> np.ndarray:
        return np.append(x, np.full(pad, fill, x.dtype)).reshape(wide, deep).T.copy()

    slope, offset, new = blocks(a, 1.0), blocks(b, 0.0), blocks(first, False)
    for j in range(1, deep):
        offset[j] += np.where(new[j], 0.0, slope[j] * offset[j - 1])
        slope[j] *= np.where(new[j], 1.0, slope[j - 1])
        new[j] |= new[j - 1]
    if wide > 1:
        end_slope, end_offset, end_new = affine_scan(slope[-1], offset[-1], new[-1])
        open_ = ~new[:, 1:]
        offset[:, 1:] += np.where(open_, slope[:, 1:] * end_offset[:-1], 0.0)
        slope[:, 1:] *= np.where(open_, end_slope[:-1], 1.0)
        new[:, 1:] |= end_new[:-1]
    return tuple(x.T.reshape(-1)[:n] for x in (slope, offset, new))


def scan_rows(frame: Frame, reads: list[str], update: Callable[[np.ndarray, list[np.ndarray], list], list[np.ndarray]], out: list[str],
          halo: bool = False) -> DataFrame:
    """Run a sequential update over every window partition (with its halo rows if asked for), streaming through it batch by batch.

    The row number makes Spark deliver each partition's rows together and in order; it also tells where the
    next one starts, and is checked, so a plan that did not keep the order would fail rather than give
    wrong values.  Only one batch is in memory at a time and there is no cost per group; columns that are not read pass as they are.
    ``update(first, columns, carry)`` returns one array per output column and leaves its state in ``carry``.
    """
    df = frame.df.where(frame.core) if frame.split and not halo else frame.df
    df = df.withColumn("_k", F.row_number().over(frame.w()))
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in out]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        carry: list = []
        last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("_k").to_numpy(zero_copy_only=False)
            first = k == 1
            if not (first | (k == np.append(last, k[:-1]) + 1)).all():
                raise RuntimeError("rows of a series arrived out of order")
            last = int(k[-1])
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in reads]
            new = [pa.array(x, from_pandas=True) for x in update(first, columns, carry)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *out])

    return df.mapInArrow(run, schema)


def linear_recurrence(frame: Frame, x: str, alpha: float, out: str) -> Frame:
    """y = alpha * x + (1 - alpha) * y_prev with y_0 = x_0 (exponential mean, unadjusted); x has no NULLs.

    A segment's influence on later ones is only its last value scaled by a power of (1 - alpha), so
    segments are chained on one row each.  The returned frame has no halo rows: apply bounded ROWS windows
    before this, not after.
    """

    def update(first: np.ndarray, columns: list[np.ndarray], carry: list) -> list[np.ndarray]:
        v = columns[0]
        slope, offset, new = affine_scan(np.full(len(v), 1 - alpha), np.where(first, v, alpha * v), first)
        y = np.where(new, offset, slope * (carry[0] if carry else 0.0) + offset)
        carry[:] = [y[-1]]
        return [y]

    y = scan_rows(frame, [x], update, ["_y"])
    if not frame.split:
        return replace(frame, df=y.withColumnRenamed("_y", out).drop("_k"))

    keys, df = list(frame.keys), frame.df
    # The local pass starts at x_0 of the segment; the true value differs by
    # (1-alpha)^k * (carry - x_0), where carry is the true last value of the segment before.
    ends = y.groupBy(*keys, _SEG).agg(
        F.max_by("_y", "_k").alias("last_y"), F.min_by("_y", "_k").alias("first_x"), F.max("_k").alias("n")
    )
    carry_schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField(_SEG, T.LongType()), T.StructField("_gap", T.DoubleType())]
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(_SEG)
        prev, gaps = None, []
        for last_y, first_x, n in zip(rows["last_y"], rows["first_x"], rows["n"], strict=True):
            gap = 0.0 if prev is None else prev - first_x
            gaps.append(gap)
            prev = last_y + (1 - alpha) ** n * gap
        return rows[[*keys, _SEG]].assign(_gap=gaps)

    gaps = ends.groupBy(*keys).applyInPandas(chain, carry_schema)
    joined = (
        y.join(gaps, [*keys, _SEG])
        .withColumn(out, F.col("_y") + F.pow(F.lit(1 - alpha), F.col("_k")) * F.col("_gap"))
        .drop("_y", "_k", "_gap")
    )
    return replace(frame, df=joined)


def affine_recurrence(frame: Frame, a: str, b: str, out: str) -> Frame:
    """y = a * y_prev + b, starting from 0, with a and b columns.

    Every segment is one pass that yields its rows' values as "slope * entry value + offset"; segments are
    chained on their last slope and offset.  No division is involved, so it is stable for any factors.
    """

    def update(first: np.ndarray, columns: list[np.ndarray], carry: list) -> list[np.ndarray]:
        slope, offset, new = affine_scan(*columns, first)
        before, entry = carry or (1.0, 0.0)
        offset = np.where(new, offset, slope * entry + offset)
        slope = np.where(new, slope, slope * before)
        carry[:] = [slope[-1], offset[-1]]
        return [slope, offset]

    y = scan_rows(frame, [a, b], update, ["_slope", "_offset"])
    if not frame.split:
        return replace(frame, df=y.withColumnRenamed("_offset", out).drop("_slope", "_k"))
    keys, df = list(frame.keys), frame.df
    ends = y.groupBy(*keys, _SEG).agg(F.max_by("_slope", "_k").alias("s"), F.max_by("_offset", "_k").alias("o"))
    entry_schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField(_SEG, T.LongType()), T.StructField("_in", T.DoubleType())])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, value, entries = pdf.sort_values(_SEG), 0.0, []
        for s, o in zip(rows["s"], rows["o"], strict=True):
            entries.append(value)
            value = s * value + o
        return rows[[*keys, _SEG]].assign(_in=entries)

    joined = y.join(ends.groupBy(*keys).applyInPandas(chain, entry_schema), [*keys, _SEG])
    return replace(frame, df=joined.withColumn(out, F.col("_slope") * F.col("_in") + F.col("_offset")).drop(
        "_slope", "_offset", "_in", "_k"))


def ema(frame: Frame, x: str, span: int, out: str, adjust: bool = False) -> Frame:
    """Exponential mean with alpha = 2 / (span + 1); ``adjust`` divides by the sum of the weights so far."""
    alpha = 2.0 / (span + 1)
    if not adjust:
        return linear_recurrence(frame, x, alpha, out)
    f = frame.running({"_t": ("count", F.lit(1)), "_x0": ("first", F.col(x))})
    f = linear_recurrence(f, x, alpha, "_v")
    # The unadjusted mean equals the weighted sum plus the decayed first value; remove the latter.
    decay = F.pow(F.lit(1 - alpha), F.col("_t"))
    return f.with_cols(**{out: (F.col("_v") - decay * F.col("_x0")) / (1 - decay)}).drop("_t", "_x0", "_v")
