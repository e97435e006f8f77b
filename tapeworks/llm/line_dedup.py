"""Repeated passages, found as overlapping windows of three lines.

Lines with a word count; blank lines are neither hashed nor removed by themselves.  Every three consecutive such lines are hashed (two 64-bit
hashes), windows that occur more than once anywhere get their first place in the order (doc_id, nulls last, then text hash, then line), and the lines
covered by any later occurrence are removed, overlapping windows merged.  Only hashes and places are shuffled, summed before they are; a window
that a third of all documents share is one combined row on one side of the join and plain rows, split at run time, on the other.

Texts with fewer than three such lines are left alone.  Null texts stay null.  Rows with equal doc_id and text are one document: they keep the same
lines.  An empty table gives an empty result; other columns pass through, derived names avoid those that exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, fresh, let, pick, settle

WINDOW = 3
BROADCAST_ROWS = 200_000
BROADCAST_LINES = 2_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _content(lines: Column) -> Column:
    """Positions of the lines that have a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))


def line_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(h1, h2, place): hashes of every window and its place (is null, doc_id, text_hash, number of its first content line)."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines"))

    def windows(lines: Column) -> Column:
        def over(at: Column) -> Column:
            def one(k: Column) -> Column:
                parts = [F.get(lines, F.get(at, k + j)) for j in range(width)]
                return F.struct(k.alias("k"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))

            return F.transform(F.sequence(F.when(F.size(at) >= width, F.lit(0)), F.size(at) - width), one)

        return let(_content(lines), over)

    found = rows.select("doc_id", "text_hash", F.explode(let(F.col("lines"), windows)).alias("w"))
    return found.select("w.h1", "w.h2", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", F.col("w.k").alias("k")).alias("place"))


def later_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_hash and ``ks``, the windows of that document that occur earlier elsewhere or in it."""
    windows = line_windows(docs, width)
    repeated = settle(windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last").drop("last"))
    later = windows.join(broadcast_bounded(repeated, BROADCAST_ROWS), ["h1", "h2"]).filter("place <> first")
    return later.groupBy("place.doc_id", "place.text_hash").agg(F.collect_set("place.k").alias("ks"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with the repeated lines taken out of ``text``, and n_lines and n_removed (lines of the old text, removed lines)."""
    later = settle(later_windows(docs, width).withColumnsRenamed({"doc_id": "later_id", "text_hash": "later_hash"}))
    ks = fresh(docs, "ks")
    later = later.withColumnRenamed("ks", ks)
    marked = later.agg(F.count("*"), F.sum(F.size(ks))).first()
    if marked[0] <= BROADCAST_ROWS and (marked[1] or 0) <= BROADCAST_LINES:
        later = F.broadcast(later)
    th, removed, n = (fresh(docs, c) for c in ("text_hash", "n_removed", "n_lines"))
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(later, rows["doc_id"].cast("long").eqNullSafe(later["later_id"]) & (rows[th] == later["later_hash"]), "left")
    covered = F.array_distinct(F.flatten(F.transform(ks, lambda k: F.sequence(k, k + (width - 1)))))
    lines = _lines(F.col("text"))

    def cut(ls: Column) -> Column:
        at = let(_content(ls), lambda c: F.transform(covered, lambda k: F.get(c, k)))
        return let(at, lambda gone: F.struct(
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n").alias("text"),
            F.size(gone).alias("gone")))

    result = fresh(joined, "cut")
    out = joined.withColumn(result, F.when(F.col(ks).isNotNull(), let(lines, cut)))
    kept = [F.coalesce(F.col(result)["text"], F.col("text")).alias("text") if c == "text" else rows[c] for c in docs.columns]
    return out.select(*kept, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n),
                      F.coalesce(F.col(result)["gone"], F.lit(0)).cast("long").alias(removed))
