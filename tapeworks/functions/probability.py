"""Expressions over class probabilities: scores, gates' inputs, signal strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.series import Frame
from .mathcols import clip, div, flag, pct_change

# Accepted spellings of the probability columns.
LONG_NAMES = ("prob_long", "p_long", "prob_c2")
SHORT_NAMES = ("prob_short", "p_short", "prob_c0")
FLAT_NAMES = ("prob_neutral", "p_flat", "prob_c1")


def normalise_predictions(df: DataFrame) -> DataFrame:
    """Any accepted spelling to prob_long, prob_short, prob_neutral (0 where absent)."""
    def pick(names: tuple[str, ...]) -> str | None:
        return next((n for n in names if n in df.columns), None)

    long, short, flat = pick(LONG_NAMES), pick(SHORT_NAMES), pick(FLAT_NAMES)
    if long is None or short is None:
        raise ValueError("no long and short probability columns found")
    rest = [c for c in df.columns if c not in (long, short, flat)]
    return df.select(*rest, F.col(long).cast("double").alias("prob_long"), F.col(short).cast("double").alias("prob_short"),
                     (F.col(flat).cast("double") if flat else F.lit(0.0)).alias("prob_neutral"))


def score_predictions(df: DataFrame) -> DataFrame:
    long, short, flat = (clip(F.col(c), 0, 1) for c in ("prob_long", "prob_short", "prob_neutral"))
    prob = F.greatest(long, short)
    return df.withColumns({
        "trade_prob": prob,
        "trade_direction": F.when(prob <= 0, 0).when(long >= short, 1).otherwise(-1),
        "edge_margin": prob - flat, "trade_score": prob * (prob - flat)})


def calibration_columns(df: DataFrame) -> DataFrame:
    """Margins, gap and conviction used by threshold calibration."""
    long, short, flat = F.col("prob_long"), F.col("prob_short"), F.col("prob_neutral")
    gap = F.abs(long - short)
    return df.withColumns({
        "score_margin": F.greatest(long - F.greatest(short, flat), short - F.greatest(long, flat)),
        "directional_gap": gap, "conviction": gap * F.greatest(long, short),
        "prob_max": F.greatest(long, short, flat)})


def move_adapter(df: DataFrame, prefix: str, threshold: float, min_expected_r: float, prob: str, long: str,
                 short: str | None = None, expected_r: str | None = None) -> DataFrame:
    """Joint probabilities from P(move) and P(side | move); an overflowing pair is rescaled to sum to one."""
    p = F.coalesce(clip(F.col(prob), 0, 1), F.lit(0.0))
    cl = F.coalesce(clip(F.col(long), 0, 1), F.lit(0.0))
    cs = F.coalesce(clip(F.col(short), 0, 1), F.lit(0.0)) if short else 1.0 - cl
    total = cl + cs
    over = total > 1.0
    cl, cs = (F.when(over, x / total).otherwise(x) for x in (cl, cs))
    r = F.col(expected_r) if expected_r else F.lit(None).cast("double")
    df = df.withColumns({f"prob_{prefix}": p, "prob_long": clip(p * cl, 0, 1), "prob_short": clip(p * cs, 0, 1)})
    return df.withColumns({
        "prob_neutral": clip(1.0 - F.col("prob_long") - F.col("prob_short"), 0, 1),
        f"{prefix}_allowed": F.col(f"prob_{prefix}") >= threshold,
        f"{prefix}_expected_r": F.greatest(F.coalesce(r, F.lit(min_expected_r)), F.lit(min_expected_r))})


def fallback_move_columns(df: DataFrame) -> DataFrame:
    """P(move) and P(side | move) derived from plain long and short probabilities."""
    long, short = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("prob_long", "prob_short"))
    total = F.when(long + short == 0, F.lit(1.0)).otherwise(long + short)
    return df.withColumns({
        "prob_bigmove": clip(long + short, 0, 1), "prob_bigmove_long": clip(long / total, 0, 1),
        "prob_bigmove_short": clip(short / total, 0, 1), "expected_r_bigmove": F.lit(2.0)})


def class_strength(prediction: Column, probability: Column) -> Column:
    """Class 1 to [0, 1], class 0 to [-1, 0], by distance of its probability from one half."""
    s = (probability - 0.5) * 2.0
    return F.when(prediction == 1, clip(s, 0, 1)).when(prediction == 0, clip(-s, -1, 0)).otherwise(F.lit(0.0))


def return_strength(f: Frame, predicted: str, price: str = "close", floor: float = 0.001, window: int = 20) -> Frame:
    """Saturating strength of a predicted return over a threshold that grows with recent volatility.

    The volatility is the population deviation of the returns among the last 2 * window prices, once
    ``window`` prices were seen.
    """
    f = f.with_cols(_r=pct_change(F.col(price), f.lag(price)))
    # 2 * window prices hold 2 * window - 1 returns, fewer where a price is zero: prices are counted, not returns.
    n = F.count(price).over(f.roll(2 * window))
    vol = F.stddev_pop("_r").over(f.roll(2 * window - 1))
    cut = F.when(n >= window, F.greatest(F.lit(floor), vol * 0.5)).otherwise(F.lit(floor))
    p = F.col(predicted)
    return f.with_cols(signal_strength=F.when(F.abs(p) < cut, F.lit(0.0)).otherwise(clip(F.tanh(p / cut), -1, 1))).drop("_r")


def argmax_signal(df: DataFrame) -> DataFrame:
    """Most probable class with its probability; ties go to the first of short, neutral, long."""
    s, n, long = F.col("prob_short"), F.col("prob_neutral"), F.col("prob_long")
    top = F.greatest(s, n, long)
    signal = F.when(s == top, -1).when(n == top, 0).otherwise(1)
    return df.withColumns({"signal": signal, "max_prob": top})


def ensemble(predictions: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Combine model rows (ts, symbol, model, probability): weighted soft vote, hard vote, spread."""
    w = F.lit(0.0)
    for model, value in weights.items():
        w = F.when(F.col("model") == model, F.lit(float(value))).otherwise(w)
    df = predictions.withColumns({"_w": w, "_vote": (F.col("probability") >= threshold).cast("double")})
    g = df.groupBy("ts", "symbol").agg(
        F.sum(F.col("_w") * F.col("probability")).alias("_s"), F.sum("_w").alias("_t"), F.avg("_vote").alias("vote_share"),
        F.var_pop("probability").alias("variance"), F.count(F.lit(1)).alias("models"))
    return g.select(
        "ts", "symbol", div(F.col("_s"), F.col("_t")).alias("probability"),
        F.when(F.col("vote_share") > 0.5, 1).otherwise(0).alias("hard_vote"), "variance",
        F.greatest(F.col("vote_share"), 1 - F.col("vote_share")).alias("consensus"), "models")


def trade_gate(df: DataFrame, min_prob: float, move_multiple: float, atr: str, minute: Column,
               first_minutes: int = 3, flat_from: int = 960) -> DataFrame:
    """Stateless gate with the first failing test as the reason; direction 0 when the neutral class leads."""
    df = argmax_signal(df)
    move = F.abs(F.col("prob_long") - F.col("prob_short")) * F.col(atr)
    early = (minute >= 540) & (minute < 600) & (F.pmod(minute, F.lit(60)) < first_minutes)
    reason = (F.when(F.col("max_prob") < min_prob, "probability").when(F.col("signal") == 0, "neutral")
              .when(flag(move < F.col(atr) * move_multiple), "expected_move")
              .when(early | (minute >= flat_from), "time_of_day").otherwise("ok"))
    return df.withColumn("reason", reason).withColumns({
        "should_trade": F.col("reason") == "ok",
        "direction": F.when(F.col("reason") == "probability", 0).otherwise(F.col("signal"))})
