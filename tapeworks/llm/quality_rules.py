"""Quality rules whose limits come from the corpus.

Per document: word, symbol, repeated-line and repeated-window counts of the whole text.  Per (lang, source) and ratio: a quantile
sketch of logarithmic bins (relative error ``ACCURACY``).  A sketch is just counts per bin, so partial counts from any task, and
sketches of smaller groups, merge by addition, give the same result in any order, and never hold a group's values anywhere.
A ratio is accepted inside ``[q25 - k * spread, q75 + k * spread]`` of its group, spread being the larger of the group's own
interquartile range and a least spread below which differences carry no meaning.  Groups of fewer than ``min_rows`` documents use
the merged sketch of their language, and languages that small the sketch of the corpus.

Null and empty texts have zero counts, fail the base rule and enter no sketch.  Null lang or source is a group like any other.
Repeated rows count as often as they occur; an empty table gives an empty result; columns beyond the four named ones are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_bounded, map_arrow, pick, settle

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
ZERO_BIN = -(2**31)
FENCE = 4.0
MIN_ROWS = 200
BROADCAST_ROWS = 200_000
#: ratio -> (numerator, denominator, least spread, whether low values are suspicious too)
RATIOS = {
    "word_length": ("word_chars", "n_words", 0.5, True),
    "symbols": ("n_symbols", "n_words", 0.02, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.05, False),
    "repeats": ("n_repeat_words", "n_words", 0.05, False),
    "capitals": ("n_capitals", "word_chars", 0.02, False),
}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def repeated_words(words: list) -> int:
    """Words covered by three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    m = len(index)
    if m <= 2_000_000:
        key = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:  # three ids no longer fit 64 bits
        pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * m + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] = hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in ``STATS`` of one whole text."""
    if not text:
        return (0,) * 7
    words = text.encode().split()  # bytes split at exactly the six white characters
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines, capitals)


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def stats(batch: pa.RecordBatch) -> pa.Table:
        rows = [text_stats(t) for t in batch.column("text").to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        keep = [batch.column(c) for c in ("doc_id", "lang", "source")]
        return pa.table([*keep, *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "lang", "source", *names])

    return map_arrow(pick(docs, doc_id="long", lang="string", source="string", text="string"), stats,
                     f"doc_id long, lang string, source string, {STATS}")


def ratio_sketches(stats: DataFrame) -> DataFrame:
    """Documents per (lang, source, ratio, bin); sums of these rows are sketches of larger groups."""
    each = F.array(*(
        F.struct(F.lit(name).alias("ratio"), (F.col(num) / F.nullif(F.col(den), F.lit(0))).alias("x")) for name, (num, den, _, _) in RATIOS.items()))
    bins = F.when(F.col("r.x") <= 0, F.lit(ZERO_BIN)).otherwise(F.ceil(F.log(F.col("r.x")) / math.log(GAMMA)))
    return (stats.select("lang", "source", F.explode(each).alias("r")).filter("r.x IS NOT NULL")
            .groupBy("lang", "source", F.col("r.ratio").alias("ratio"), bins.cast("long").alias("bin")).agg(F.count("*").alias("n")))


def sketch_quantiles(sketch: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Per group the number of values and, for each probability, the middle of the first bin that reaches it."""
    merged = sketch.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    ranked = merged.select(*keys, "bin", F.sum("n").over(group).alias("rows"),
                           F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    value = F.when(F.col("bin") == ZERO_BIN, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin")) * (2 / (GAMMA + 1)))
    return ranked.groupBy(*keys).agg(F.max("rows").alias("rows"), *(
        F.min(F.when(F.col("upto") >= F.col("rows") * p, value)).alias(c) for c, p in probs.items()))


def adaptive_limits(sketch: DataFrame, fence: float = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source): low and high limit of every ratio, from the smallest enclosing group that is large enough."""
    probs = {"q25": 0.25, "q75": 0.75}
    levels = {"own": ["lang", "source", "ratio"], "lang": ["lang", "ratio"], "all": ["ratio"]}
    found = {k: sketch_quantiles(sketch, keys, probs).select(*keys, *(F.col(c).alias(f"{c}_{k}") for c in ("rows", *probs))) for k, keys in levels.items()}
    own, by_lang, every = found["own"].alias("o"), found["lang"].alias("l"), found["all"].alias("a")
    table = (own.join(by_lang, F.expr("o.lang <=> l.lang AND o.ratio = l.ratio")).join(every, F.expr("o.ratio = a.ratio"))
             .select("o.lang", "o.source", "o.ratio", *(
                 F.when(F.col("rows_own") >= min_rows, F.col(f"{c}_own")).when(F.col("rows_lang") >= min_rows, F.col(f"{c}_lang"))
                 .otherwise(F.col(f"{c}_all")).alias(c) for c in probs)))
    least = F.element_at(F.create_map(*(F.lit(x) for name, spec in RATIOS.items() for x in (name, spec[2]))), F.col("ratio"))
    spread = F.greatest(F.col("q75") - F.col("q25"), least) * fence
    limits = table.select("lang", "source", "ratio", (F.col("q25") - spread).alias("low"), (F.col("q75") + spread).alias("high"))
    return limits.groupBy("lang", "source").agg(*(
        F.max(F.when(F.col("ratio") == name, F.col(c))).alias(f"{name}_{c}") for name in RATIOS for c in ("low", "high")))


def quality_rules(docs: DataFrame, fence: float = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Counts, ``base_failed`` (fixed base rule), ``failed`` (names of the ratios outside their limits) and ``kept`` for every document.

    Only counts are kept between the two passes (the texts are read once); the limits are broadcast when counted small.
    """
    stats = settle(with_stats(docs))
    limits = settle(adaptive_limits(ratio_sketches(stats), fence, min_rows))
    joined = stats.alias("s").join(broadcast_bounded(limits, BROADCAST_ROWS).alias("t"), F.expr("s.lang <=> t.lang AND s.source <=> t.source"), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    outside = []
    for name, (num, den, _, low) in RATIOS.items():
        x = F.col(num) / F.nullif(F.col(den), F.lit(0))
        bad = x > F.col(f"{name}_high")
        if low:
            bad = bad | (x < F.col(f"{name}_low"))
        outside.append(F.when(bad, F.lit(name)))
    return (joined.select("s.*", base.alias("base_failed"), F.array_join(F.array(*outside), ",").alias("failed"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")))
