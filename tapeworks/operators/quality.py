"""Row rules and their violation counts: every check of a table is one aggregation over one scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mathcols import flag
from ..functions.timecols import MINUTE_NS, event_time, session_date

# The enumerations and column lists of the table contracts.
SIDES = ("long", "short", "buy", "sell")
REGIMES = ("BULL", "BEAR", "SIDEWAYS", "STRESS", "OFF")
BAR_REQUIRED = ("ts", "symbol", "open", "high", "low", "close", "volume")
BAR_OPTIONAL = ("vwap", "trades", "spread", "turnover", "session", "provider")
CONTRACT_REQUIRED = BAR_REQUIRED


@dataclass(frozen=True)
class Rule:
    """A named predicate that is true for a bad row; ``needs`` are the columns it reads."""

    name: str
    bad: Column
    needs: tuple[str, ...]


def not_null(c: str) -> Rule:
    return Rule(f"{c}_missing", F.col(c).isNull(), (c,))


def positive(c: str, when_present: bool = False) -> Rule:
    bad = F.col(c) <= 0
    return Rule(f"{c}_not_positive", flag(bad) if when_present else flag(bad) | F.col(c).isNull(), (c,))


def non_negative(c: str) -> Rule:
    return Rule(f"{c}_negative", flag(F.col(c) < 0), (c,))


def in_range(c: str, lo: float, hi: float) -> Rule:
    return Rule(f"{c}_out_of_range", flag((F.col(c) < lo) | (F.col(c) > hi)), (c,))


def one_of(c: str, values: Iterable[str]) -> Rule:
    return Rule(f"{c}_not_allowed", flag(~F.col(c).isin(*values)) | F.col(c).isNull(), (c,))


def after(later: str, earlier: str) -> Rule:
    return Rule(f"{later}_not_after_{earlier}", flag(F.col(later) <= F.col(earlier)), (later, earlier))


def not_before(c: str, limit: str) -> Rule:
    """No look-ahead: a source time must not lie after the time it is used at."""
    return Rule(f"{c}_looks_ahead", flag(F.col(c) > F.col(limit)), (c, limit))


def bar_rules() -> list[Rule]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return [
        *[not_null(x) for x in BAR_REQUIRED],
        *[non_negative(x) for x in ("open", "high", "low", "close", "volume")],
        Rule("high_below_low", flag(h < lo), ("high", "low")),
        Rule("high_below_body", flag((h < o) | (h < c)), ("open", "high", "close")),
        Rule("low_above_body", flag((lo > o) | (lo > c)), ("open", "low", "close")),
        Rule("ts_not_positive", flag(F.col("ts") <= 0), ("ts",)),
    ]


def rule_sets() -> dict[str, list[Rule]]:
    """Rules per table kind; prices and stops are checked only where present."""
    return {
        "bars": bar_rules(),
        "signals": [positive("ts"), not_null("symbol"), one_of("side", SIDES), in_range("strength", -1, 1)],
        "orders": [positive("ts"), not_null("symbol"), one_of("side", SIDES), positive("qty"),
                   *[positive(x, when_present=True) for x in ("entry", "stop", "take_profit")]],
        "trades": [not_null("symbol"), one_of("side", SIDES), positive("qty"), positive("entry_px"), positive("exit_px"),
                   after("exit_ts", "entry_ts"), non_negative("fees")],
        "risk_rejects": [positive("ts"), not_null("symbol"), not_null("reason_code"), not_null("limit_name")],
        "allocations": [positive("ts"), not_null("symbol"), non_negative("allocation")],
    }


UNIQUE = {"bars": ("symbol", "ts"), "signals": (), "orders": (), "trades": (), "risk_rejects": (), "allocations": ()}


def violations(df: DataFrame, rules: Iterable[Rule], unique: Iterable[str] = ()) -> DataFrame:
    """(rule, violations) for every rule; ``unique`` adds the number of rows beyond the first per key."""
    usable = [r for r in rules if _resolves(df, r)]
    wide = df.agg(*[F.coalesce(F.sum(r.bad.cast("long")), F.lit(0)).cast("long").alias(r.name) for r in usable])
    out = wide.unpivot([], [r.name for r in usable], "rule", "violations")
    unique = list(unique)
    if unique:
        dup = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit("duplicate_key").alias("rule"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"),
        )
        out = out.unionByName(dup)
    return out


def checked(df: DataFrame, rules: Iterable[Rule], key: Iterable[str] = ("symbol", "ts")) -> DataFrame:
    """The same rows; the first one that breaks a rule ends the job with an error that names the rule and the row's key."""
    broken = F.lit(None).cast("string")
    for rule in rules:
        if _resolves(df, rule):
            broken = F.coalesce(broken, F.when(rule.bad, F.lit(rule.name)))
    where = F.concat_ws(" ", F.lit("invalid row:"), broken, *[F.col(k).cast("string") for k in key if k in df.columns])
    return df.where(F.when(broken.isNotNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True)))


def feature_inputs(df: DataFrame, required: Iterable[str] = BAR_REQUIRED, prices: Iterable[str] = ("open", "high", "low", "close")) -> DataFrame:
    """(rule, violations) of what features need: the required columns (an error without one) and positive prices.  Rows need no order here:
    every feature sorts by (symbol, ts) itself."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return violations(df, [positive(p) for p in prices])


def _resolves(df: DataFrame, rule: Rule) -> bool:
    """Optional columns may be absent; a rule about them does not apply then."""
    return all(c in df.columns for c in rule.needs)


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Violation counts of a table kind; raises for an unknown kind or a missing required column."""
    rules = rule_sets().get(kind)
    if rules is None:
        raise ValueError(f"unknown table kind: {kind}")
    if kind == "bars":
        missing = [c for c in BAR_REQUIRED if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
    return violations(df, rules, UNIQUE[kind])


def bad_rows(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rows breaking any rule, with the list of broken rules."""
    rules = [r for r in rules if _resolves(df, r)]
    broken = F.array_compact(F.array(*[F.when(r.bad, F.lit(r.name)) for r in rules]))
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def raw_file_report(df: DataFrame, file: str, order: str, ts: str) -> DataFrame:
    """Per source file: rows, time range, bad values and steps back in time in file order."""
    w = Window.partitionBy(file).orderBy(order)
    back = F.col(ts) < F.lag(ts).over(w)
    return df.withColumn("_back", flag(back)).groupBy(file).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
        F.sum(flag(F.col("high") < F.col("low")).cast("long")).alias("high_below_low"),
        F.sum(flag(F.least("open", "high", "low", "close") < 0).cast("long")).alias("negative_prices"),
        F.sum(flag(F.col("volume") != F.floor("volume")).cast("long")).alias("fractional_volume"),
        F.sum(F.greatest(*[F.col(c).isNull().cast("long") for c in ("open", "high", "low", "close", "volume")]))
        .alias("missing_values"),
        F.sum(F.col("_back").cast("long")).alias("steps_back"),
    )


def normalisation_plan(files: DataFrame) -> DataFrame:
    """(family, variant) -> number of files and the renames and casts such files need."""
    renames = F.when(F.col("variant") == "short", F.lit("t>ts,o>open,h>high,l>low,c>close,v>volume,T>symbol")).otherwise("")
    casts = F.when(F.col("variant") == "float_volume", F.lit("volume:long")).otherwise("")
    return files.groupBy("family", "variant").agg(F.count(F.lit(1)).alias("files")).withColumns(
        {"renames": renames, "casts": casts}
    )


def contract_report(bars: DataFrame, turnover: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Contract checks per symbol: minute alignment, order within the session, turnover = close * volume."""
    w = Window.partitionBy("symbol", "session_date").orderBy("ts")
    df = bars.withColumn("session_date", session_date("ts"))
    df = df.withColumn("_same", flag(F.lag("ts").over(w) == F.col("ts")))
    value = F.col("close") * F.col("volume")
    off = flag(F.abs(F.col(turnover) - value) > tolerance * F.greatest(F.abs(value), F.lit(1.0))) if turnover else F.lit(False)
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.pmod(F.col("ts"), F.lit(MINUTE_NS).cast("long")) != 0).cast("long")).alias("unaligned"),
        F.sum(F.col("_same").cast("long")).alias("repeated_in_session"),
        F.sum(off.cast("long")).alias("turnover_mismatch"),
        F.countDistinct("session_date").alias("sessions"),
    )


def feature_report(df: DataFrame, features: Iterable[str], min_share: float = 0.9) -> DataFrame:
    """(feature, non-null share, passes) from a single pass over all feature columns."""
    features = list(features)
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in features])
    return wide.unpivot([], features, "feature", "non_null_share").withColumn(
        "passes", flag(F.col("non_null_share") >= min_share)
    )


def column_mismatch(spark: SparkSession, expected: Iterable[str], actual: Iterable[str]) -> DataFrame:
    """Expected columns that are missing and present columns that are not expected."""
    e, a = set(expected), set(actual)
    rows = [(c, "missing") for c in sorted(e - a)] + [(c, "unexpected") for c in sorted(a - e)]
    return spark.createDataFrame(rows, "column string, problem string")


def all_ok(rules: Iterable[Rule]) -> Column:
    return ~reduce(lambda x, y: x | y, [r.bad for r in rules], F.lit(False))


def frame_summary(bars: DataFrame) -> DataFrame:
    present = [c for c in BAR_OPTIONAL if c in bars.columns]
    return bars.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.date_format(event_time(F.min("ts")), "yyyy-MM-dd HH:mm").alias("first_bar"),
        F.lit(",".join(present)).alias("optional_columns"),
    )
