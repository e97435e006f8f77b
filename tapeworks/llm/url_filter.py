"""URL filter: host and path rules first, character models for the rest.

Two smoothed variable-order Markov models (accepted and rejected URLs) give every character a probability after its longest seen context of up to
``ORDER`` characters; each order is smoothed by the next shorter one with the number of distinct continuations (Witten-Bell), the shortest by a uniform
law.  A URL's score is the difference of the two log-likelihoods per character.  The threshold is calibrated on labelled URLs
left out of the models: the score with the best balanced accuracy.

Training is counting: one row per distinct (order + 1)-gram and class leaves a task, everything else works on those gram tables.  Scoring joins a URL's
grams with the table of log ratios (broadcast when counted small; otherwise shuffled, hot grams split at run time) and sums per URL inside the
task first.  All DataFrame functions.

A null URL is scored as an empty one (its end mark only); repeated URLs count as often as they occur and get equal scores; with one class missing all
log ratios are zero and everything is accepted; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, settle

ORDER = 4
ALPHABET = 256
#: first hex digits of a URL's MD5 that put it into the calibration set
CALIBRATION = "012"
BIN = 0.01
BROADCAST_ROWS = 1_000_000
START, END = "\u0002", "\u0003"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits.  Of rules of equal length the first wins."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values)))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def grams(url: Column, order: int = ORDER) -> Column:
    """All (order + 1)-grams of the URL between start marks and an end mark, one per character and one for the end."""
    padded = F.concat(F.lit(START * order), F.regexp_replace(F.coalesce(url, F.lit("")), f"[{START}{END}]", " "), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - order), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, accepted, rejected) over (url, label) rows; label 1 accepted, 0 rejected, null: counted in neither, so that every gram has a row."""
    rows = urls.select("label", F.explode(grams(F.col("url"), order)).alias("gram"))
    return rows.groupBy("gram").agg(*(F.coalesce(F.sum((F.col("label") == v).cast("long")), F.lit(0)).alias(c) for c, v in (("accepted", 1), ("rejected", 0))))


def log_ratios(counts: DataFrame, order: int = ORDER, alphabet: int = ALPHABET) -> DataFrame:
    """(gram, ratio): log of the accepted over the rejected model's probability of a gram's last character."""
    classes = ("accepted", "rejected")
    table = counts.select("gram", *(F.lit(1.0 / alphabet).alias(f"p_{c}") for c in classes))
    for k in range(order + 1):  # contexts of k characters
        piece, context = F.substring("gram", order + 1 - k, k + 1), F.substring("gram", order + 1 - k, k)
        own = counts.groupBy(piece.alias("piece")).agg(*(F.sum(c).alias(f"n_{c}") for c in classes))
        seen = own.groupBy(F.substring("piece", 1, k).alias("context")).agg(
            *(F.sum(f"n_{c}").alias(f"all_{c}") for c in classes), *(F.sum((F.col(f"n_{c}") > 0).cast("long")).alias(f"kinds_{c}") for c in classes))
        joined = table.withColumns({"piece": piece, "context": context}).join(own, "piece").join(seen, "context")
        smoothed = {c: F.when(F.col(f"all_{c}") > 0, (F.col(f"n_{c}") + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}")))
                    .otherwise(F.col(f"p_{c}")) for c in classes}
        table = joined.select("gram", *(p.alias(f"p_{c}") for c, p in smoothed.items()))
    return table.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def score_urls(rows: DataFrame, ratios: DataFrame, key: list[str], order: int = ORDER) -> DataFrame:
    """``key`` and the mean log ratio per character; ``key`` names a row or a set of equal URLs.  Rounded so that the order of addition can't show."""
    exploded = rows.select(*key, F.explode(grams(F.col("url"), order)).alias("gram"))
    joined = exploded.join(broadcast_bounded(ratios, BROADCAST_ROWS), "gram")
    return joined.groupBy(*key).agg(F.round(F.avg("ratio"), 9).alias("score"))


def calibrated_threshold(scored: DataFrame) -> float:
    """The border between bins of (score, label, n) rows with the best balanced accuracy, halfway between the occupied bins beside it.

    The smallest of equally good ones; zero without both classes.
    """
    bins = scored.groupBy(F.floor(F.col("score") / BIN).cast("int").alias("bin")).agg(
        *(F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(c) for c, v in (("good", 1), ("bad", 0))))
    # scores lie between -log and +log of a probability, so there are some thousand bins at most
    rows = sorted(bins.collect(), key=lambda r: r["bin"])
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, kept, gone, below = -1.0, 0.0, good, 0, rows[0]["bin"] - 1
    for r in rows:
        accuracy = kept / good + gone / bad
        if accuracy > best:
            best, at = accuracy, (r["bin"] + below + 1) / 2 * BIN
        kept, gone, below = kept - r["good"], gone + r["bad"], r["bin"]
    return at


def train(labelled: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """Log ratios of all grams in (url, label) rows, null labels included, and the threshold.

    Three in sixteen of the labelled URLs (by hash) only calibrate; their grams have rows but no counts.
    """
    out = F.coalesce(F.substring(F.md5("url"), 1, 1).isin(*CALIBRATION), F.lit(False))
    marked = labelled.select("url", "label", out.alias("out"))
    counts = settle(gram_counts(marked.select("url", F.when(~F.col("out"), F.col("label")).alias("label")), order))
    ratios = settle(log_ratios(counts, order))
    # equal URLs with equal labels are scored once and weigh as often as they occur
    held = marked.filter("out AND label IS NOT NULL").groupBy("url", "label").agg(F.count("*").alias("n"))
    scored = score_urls(held, ratios, ["url", "label", "n"], order)
    return ratios, calibrated_threshold(scored)


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict of every page.

    URLs that a rule decides are the accepted and rejected examples of the models, all others are judged by them; a verdict by
    rule stands whatever the models say.  Equal URLs are scored once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    ratios, threshold = train(rows.select("url", F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0).alias("label")), order)
    scores = score_urls(rows.select("url").distinct(), ratios, ["url"], order)
    judged = rows.alias("r").join(scores.alias("s"), F.expr("r.url <=> s.url"), "left")
    verdict = F.coalesce("ruled", F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block"))
    return judged.select("page_id", "r.url", "host", "path", "rule", "score", verdict.alias("verdict"))
