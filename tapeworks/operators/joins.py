"""As-of, next-row and interval joins, and parameter grids, without cross products."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import BROADCAST_ROWS, split_series


def asof_backward(left: DataFrame, right: DataFrame, cols: Iterable[str], on: str = "ts",
                  by: Iterable[str] = (), max_rows: int | None = None) -> DataFrame:
    """Attach to every left row the columns of the latest right row with ``right.on <= left.on``.

    Both sides are stacked and the last right row is carried forward in one window pass; long series are
    cut into segments (see ``split_series``), so neither the number of rows nor a hot key matters.  Without
    ``by`` only the distinct left times are matched, and the result is joined back on time.
    """
    cols, by = list(cols), list(by)
    keys = by or ["_all"]
    probe = left.select(*by, on).distinct()
    if not by:
        probe, right = probe.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
    payload = F.struct(*cols)
    rights = right.select(*keys, on, payload.alias("_r")).withColumn("_side", F.lit(0))
    none = F.lit(None).cast(rights.schema["_r"].dataType)
    stacked = rights.unionByName(probe.select(*keys, on, none.alias("_r"), F.lit(1).alias("_side")))
    frame = split_series(stacked, keys, (on, "_side"), max_rows=max_rows)
    held = frame.running({"_m": ("last", F.col("_r"))}).finish()
    matched = held.where("_side = 1").select(*by, on, *[F.col("_m")[c].alias(c) for c in cols])
    return left.join(matched, [*by, on], "left")


def next_bar(rows: DataFrame, bars: DataFrame, lookup: dict[str, str], max_rows: int | None = None) -> DataFrame:
    """Attach columns of the same symbol's next bar to rows keyed (symbol, ts); rows without one are dropped.

    ``lookup`` maps output name to bar column.
    """
    f = split_series(bars, lookahead=1, max_rows=max_rows)
    nxt = f.with_cols(**{out: f.lead(c) for out, c in lookup.items()}).finish()
    first = next(iter(lookup))
    return rows.join(nxt.select("symbol", "ts", *lookup).where(F.col(first).isNotNull()), ["symbol", "ts"])


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Many-to-one join: raises while running if the right side has a key twice."""
    one = right.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in on]
    )
    guard = F.when(F.col("_n") > 1, F.raise_error(F.lit("right side of the join has duplicate keys")))
    checked = one.where(F.coalesce(guard.cast("boolean"), F.lit(True))).drop("_n")
    return left.join(checked, on, how)


def match_report(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """How many keys match, and how many rows each side loses in an inner join (one row)."""
    keys = (
        left.groupBy(*on).agg(F.count(F.lit(1)).alias("l")).join(
            right.groupBy(*on).agg(F.count(F.lit(1)).alias("r")), on, "full_outer")
    )
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return keys.agg(
        n(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.col("l") * F.col("r"))).alias("matched"),
        n(F.when(F.col("r").isNull(), F.col("l"))).alias("left_dropped"),
        n(F.when(F.col("l").isNull(), F.col("r"))).alias("right_dropped"),
    )


def lookup_join(df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join that broadcasts the right side only after counting it."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on, how)


def attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (a global aggregate) on every row."""
    return df.withColumn("_one", F.lit(1)).join(
        F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def with_grid(df: DataFrame, grid: dict[str, list]) -> DataFrame:
    """Every row once per combination of the (few) parameter values, with a combination id."""
    names = list(grid)
    combos = [
        F.struct(F.lit(i).alias("combo"), *[F.lit(v).alias(n) for n, v in zip(names, combo, strict=True)])
        for i, combo in enumerate(product(*grid.values()))
    ]
    return df.withColumn("_g", F.explode(F.array(*combos))).select("*", "_g.*").drop("_g")


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """Every combination of the parameter values, one row each, with a combination id."""
    names = list(grid)
    rows = [(i, *combo) for i, combo in enumerate(product(*grid.values()))]
    return spark.createDataFrame(rows, ["combo", *names])


def apply_overrides(params: dict, overrides: dict) -> dict:
    """Deep copy of nested ``params`` with dotted keys set."""
    out = {k: (apply_overrides(v, {}) if isinstance(v, dict) else v) for k, v in params.items()}
    for key, value in overrides.items():
        node = out
        *path, leaf = key.split(".")
        for p in path:
            node = node.setdefault(p, {})
        node[leaf] = value
    return out


def deep_merge(base: dict, overlay: dict) -> dict:
    out = dict(base)
    for k, v in overlay.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
