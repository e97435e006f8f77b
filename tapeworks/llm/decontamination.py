"""Benchmark leaks, also of questions whose numbers, names or units were changed.

Texts are brought to a template: numbers, names and units after a number become typed placeholders, everything else is lower case without punctuation.
A name is a capitalised word after a lower-case word or a comma and, wherever else it stands (first in a sentence, line, quotation or text), a capitalised
word that is no common word.  Common words are those that the benchmark begins such places with but writes in lower case more often than as names; the
same ones hold for items and documents.  Windows of ``WIDTH`` template words with at least two plain words
are hashed; the documents' distinct hashes are joined with the benchmark's.  A pair whose document holds ``SHARE`` of the item's distinct windows
is then checked word by word: matched windows that lie on one diagonal (equal shift between the two texts) must fill each of the item's slot
values with one value throughout; diagonals that don't are dropped.  What remains is gathered into readings of the item, largest first, that give each slot
value one value across all their diagonals, so inserted words split no check; the share is taken again within one reading.

Items that windows can't find anywhere in a text, because they have fewer than ``WIDTH`` words or no window with enough plain words, are also searched as
exact sequences: their words and arithmetic signs in lower case, from ``SHORTEST`` of them on, joined by the hash of the first ``SHORTEST``.

Both sides of the first join are narrow (row key and hash); the benchmark's windows are broadcast when counted small, otherwise shuffled.  The second
step reads only the texts of candidate pairs.  All DataFrame functions.

Items of fewer than ``SHORTEST`` words and signs without a window match nothing; texts of fewer than ``WIDTH`` words have one window, the whole text.  Null and empty texts
have none.  Rows with equal doc_id and text are one document in the pairs; repeated benchmark items and null ids match like any other;
an empty table on either side gives an empty result; other columns are ignored (``drop_leaks`` passes them on).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, fresh, let, pick, settle

WIDTH = 5
SHARE = 0.8
PLAIN = 2
BROADCAST_ROWS = 500_000
SHORTEST = 3
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
#: stands before a capitalised word of which the common words decide whether it is a name
CAPITAL = "\u0004"
EXACT = r"[\p{L}\p{M}\p{N}]+|[+*/=<>^%\-]"
MID_NAME = r"(?<=[\p{Ll},] )\p{Lu}[\p{Ll}]+(?![\p{L}])"
ANY_NAME = f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}{NAME}])\\p{{Lu}}\\p{{Ll}}+(?!\\p{{L}})"
#: units of measure and currency that may follow a number
UNITS = ("mg", "g", "kg", "t", "lb", "lbs", "oz", "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yards", "miles", "metres",
         "meters", "ml", "l", "litres", "liters", "gallons", "ms", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months",
         "years", "percent", "dollars", "euros", "pounds", "cents", "usd", "eur", "gbp", "degrees", "mph", "kmh", "w", "kw", "v", "hz", "kb", "mb", "gb")


def common_words(benchmark: DataFrame) -> list[str]:
    """Capitalised words of the benchmark that are in lower case more often than capitalised after a lower-case word or a comma, in lower case.

    They go to the driver: at most one entry per word that the benchmark writes both ways.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = [F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in (MID_NAME, ANY_NAME, r"(?<!\p{L})\p{Ll}+(?!\p{L})")]
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), words.alias("words")) for k, words in enumerate(seen)))
    words = benchmark.select(F.inline(kinds)).select("kind", F.explode("words").alias("word"))
    counts = words.groupBy(F.lower("word").alias("word")).agg(*(F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(3)))
    return sorted(r["word"] for r in counts.filter("k1 > 0 AND k2 > k0").select("word").collect())


def _marked(text: Column, values: bool) -> Column:
    """The template as one string, placeholders alone or each followed by the value it stands for; capitals are left to be decided."""
    value = "$0" if values else ""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0001-\u0004]", " ")
    t = F.regexp_replace(t, r"(?<=[0-9])[.,:/](?=[0-9])", "")
    t = F.regexp_replace(t, MID_NAME, NAME + value)
    t = F.regexp_replace(t, ANY_NAME, CAPITAL + "$0")
    t = F.regexp_replace(t, "[0-9]+", f" {NUMBER}{value} ")
    after = f"({NUMBER}{'[0-9]+' if values else ''} +)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\\p{{L}}\\p{{N}}])"
    return F.regexp_replace(F.lower(t), after, f"$1{UNIT}{'$2' if values else ''}")


def template_words(text: Column, values: bool = False, common: Sequence[str] = ()) -> Column:
    words = F.array_remove(F.split(_marked(text, values), "[^\\p{L}\\p{M}\\p{N}\u0001-\u0004]+"), "")

    def decided(word: Column) -> Column:
        bare = F.substr(word, F.lit(2))
        name = F.concat(F.lit(NAME), bare) if values else F.lit(NAME)
        return F.when(word.startswith(CAPITAL), F.when(bare.isin(list(common)), bare).otherwise(name) if common else name).otherwise(word)

    return F.transform(words, decided)


def _windows(words: Column, of, width: int = WIDTH) -> Column:
    """``of(position, words at it)`` for every window; one window when the text is shorter, null without words."""

    def every(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - width, F.lit(0))
        return F.transform(F.sequence(F.when(F.size(ws) > 0, F.lit(0)), last), lambda i: of(i, [F.get(ws, i + k) for k in range(width)]))

    return let(words, every)


def window_hashes(words: Column, width: int = WIDTH) -> Column:
    return _windows(words, lambda i, w: F.xxhash64(*w), width)


def _kind(word: Column) -> Column:
    """The placeholder a marked word begins with, or the word itself."""
    first = F.substring(word, 1, 1)
    return F.when(first.isin(NUMBER, NAME, UNIT), first).otherwise(word)


def _value(word: Column) -> Column:
    return F.when(F.substring(word, 1, 1).isin(NUMBER, NAME, UNIT), word)


def item_windows(benchmark: DataFrame, width: int = WIDTH, common: Sequence[str] = ()) -> DataFrame:
    """(item, hash, n): the distinct windows of each item that have enough plain words, and how many the item has."""
    rows = pick(benchmark, item_id="long", text="string").withColumn("item", F.struct("item_id", F.xxhash64("text").alias("text_hash")))
    words = rows.select("item", template_words(F.col("text"), common=common).alias("words"))

    def eligible(i: Column, w: list[Column]) -> Column:
        plain = sum((F.when(x.isNotNull() & ~x.isin(NUMBER, NAME, UNIT), 1).otherwise(0) for x in w), F.lit(0))
        return F.when(plain >= PLAIN, F.xxhash64(*w))

    hashes = words.select("item", F.array_distinct(F.array_compact(_windows(F.col("words"), eligible, width))).alias("hs"))
    return hashes.select("item", F.size("hs").alias("n"), F.explode("hs").alias("hash")).distinct()


def _candidates(docs: DataFrame, items: DataFrame, share: float, width: int, common: Sequence[str]) -> DataFrame:
    """(doc, item, n) pairs that share enough window hashes; doc is (doc_id, text_hash)."""
    rows = pick(docs, doc_id="long", text="string")
    hashes = rows.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc"),
                         F.explode(F.array_distinct(window_hashes(template_words(F.col("text"), common=common), width))).alias("hash"))
    found = hashes.join(broadcast_bounded(items, BROADCAST_ROWS), "hash")
    return found.groupBy("doc", "item", "n").agg(F.count_distinct("hash").alias("k")).filter(F.col("k") >= share * F.col("n")).drop("k")


def _window_rows(df: DataFrame, key: str, width: int, common: Sequence[str]) -> DataFrame:
    """(key, at, hash, values): every window with the marked slot values at its positions (null for plain words)."""
    words = df.select(key, template_words(F.col("text"), values=True, common=common).alias("words"))
    window = _windows(F.col("words"), lambda i, w: F.struct(i.alias("at"), F.xxhash64(*(_kind(x) for x in w)).alias("hash"),
                                                            F.array(*(_value(x) for x in w)).alias("values")), width)
    return words.select(key, F.explode(window).alias("w")).select(key, "w.*")


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, n_matched, containment, n_changed (slots filled with other values) per leaked pair."""
    common = common_words(benchmark)
    items = settle(item_windows(benchmark, width, common))
    pairs = settle(_candidates(docs, items, share, width, common))
    rows = pick(docs, doc_id="long", text="string").withColumn("doc", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    wanted = broadcast_bounded(pairs.select("doc").distinct(), BROADCAST_ROWS)
    same = rows["doc"]["doc_id"].eqNullSafe(wanted["doc"]["doc_id"]) & (rows["doc"]["text_hash"] == wanted["doc"]["text_hash"])
    texts = rows.join(wanted, same, "left_semi").select("doc", "text").dropDuplicates(["doc"])
    tests = pick(benchmark, item_id="long", text="string").select(F.struct("item_id", F.xxhash64("text").alias("text_hash")).alias("item"), "text").dropDuplicates(["item"])
    ours = _window_rows(texts, "doc", width, common).join(pairs, "doc")
    theirs = _window_rows(tests, "item", width, common).select("item", "hash", F.col("at").alias("item_at"), F.col("values").alias("item_values"))
    theirs = theirs.join(items.select("item", "hash"), ["item", "hash"], "left_semi")
    hits = ours.join(theirs, ["item", "hash"]).withColumn("shift", F.col("at") - F.col("item_at"))
    slots = F.filter(F.arrays_zip("item_values", "values"), lambda s: s["item_values"].isNotNull())
    by_shift = hits.groupBy("doc", "item", "n", "shift").agg(F.collect_set("hash").alias("hashes"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"))
    # one value of the item, one value of the document
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item_values"])))
    alike = by_shift.filter(consistent).groupBy("doc", "item", "n", F.array_sort("slots").alias("slots")).agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))
    parts = alike.groupBy("doc", "item", "n").agg(F.array_sort(F.collect_list(F.struct((-F.size("hashes")).alias("order"), "slots", "hashes"))).alias("parts"))
    readings = parts.select("doc", "item", "n", "parts", F.explode(_readings(F.col("parts"))).alias("reading"))
    fitting = F.filter("parts", lambda p: ~_clash(F.col("reading"), p["slots"]))
    matched = F.size(F.array_distinct(F.flatten(F.transform(fitting, lambda p: p["hashes"]))))
    changed = F.size(F.filter("reading", lambda s: s["item_values"] != s["values"]))
    counted = readings.groupBy("doc", "item", "n").agg(F.max(F.struct(matched.alias("k"), (-changed).alias("same"))).alias("best"))
    found = counted.filter(F.col("best.k") >= share * F.col("n")).select(
        "doc.doc_id", "doc.text_hash", "item.item_id", F.col("n").cast("long").alias("n_windows"), F.col("best.k").cast("long").alias("n_matched"),
        F.round(F.col("best.k") / F.col("n"), 4).alias("containment"), (-F.col("best.same")).cast("long").alias("n_changed"))
    short = settle(short_items(benchmark, items, width, common))
    if short.isEmpty():
        return found
    every = found.unionByName(exact_pairs(docs, short)).withColumn("row", F.struct((-F.col("containment")).alias("order"), "n_changed", "n_windows", "n_matched", "containment"))
    best = every.groupBy("doc_id", "text_hash", "item_id").agg(F.min("row").alias("row"))
    return best.select("doc_id", "text_hash", "item_id", *[f"row.{c}" for c in ("n_windows", "n_matched", "containment", "n_changed")])


def _clash(a: Column, b: Column) -> Column:
    """Whether two lists of filled slots give one value of the item two values of the document."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["item_values"] == y["item_values"]) & (x["values"] != y["values"])))


def _readings(parts: Column) -> Column:
    """Slot fillings that hold together: each part joins the first reading it doesn't clash with, or begins one."""

    def add(readings: Column, part: Column) -> Column:
        at = F.array_position(F.transform(readings, lambda r: ~_clash(r, part["slots"])), F.lit(True))
        joined = F.transform(readings, lambda r, i: F.when(i + 1 == at, F.array_union(r, part["slots"])).otherwise(r))
        return F.when(at > 0, joined).otherwise(F.concat(readings, F.array(part["slots"])))

    return F.aggregate(parts, F.array(F.filter(parts[0]["slots"], lambda s: F.lit(False))), add)


def _exact_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({EXACT})"), F.lit(1))


def short_items(benchmark: DataFrame, items: DataFrame, width: int = WIDTH, common: Sequence[str] = ()) -> DataFrame:
    """(item_id, words, first): items that windows can't find inside a text, as exact words, and the hash of the first ``SHORTEST``."""
    rows = pick(benchmark, item_id="long", text="string").withColumn("item", F.struct("item_id", F.xxhash64("text").alias("text_hash")))
    seen = items.select(F.col("item.text_hash").alias("seen")).distinct()
    few = F.size(template_words(F.col("text"), common=common)) < width
    rest = rows.join(seen, F.col("item.text_hash") == F.col("seen"), "left").filter(F.col("seen").isNull() | few)
    words = rest.select("item_id", _exact_words(F.col("text")).alias("words")).filter(F.size("words") >= SHORTEST).distinct()
    return words.withColumn("first", F.xxhash64(*(F.get("words", F.lit(k)) for k in range(SHORTEST))))


def exact_pairs(docs: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs whose document holds all words of the item in a row, as ``leaked_pairs`` returns them: one window, none changed."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("text_hash"), _exact_words(F.col("text")).alias("held"))
    starts = F.sequence(F.lit(0), F.size("held") - SHORTEST)
    firsts = F.transform(starts, lambda i: F.xxhash64(*(F.get("held", i + k) for k in range(SHORTEST))))
    anchors = rows.filter(F.size("held") >= SHORTEST).select("doc_id", "text_hash", "held", F.explode(F.array_distinct(firsts)).alias("first"))
    near = anchors.join(broadcast_bounded(short, BROADCAST_ROWS), "first")
    n = F.size("words")
    holds = F.exists(F.sequence(F.lit(0), F.greatest(F.size("held") - n, F.lit(0))), lambda i: F.slice("held", i + 1, n) == F.col("words"))
    one = F.lit(1).cast("long")
    return near.filter(holds).select("doc_id", "text_hash", "item_id", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("containment"),
                                     F.lit(0).cast("long").alias("n_changed")).distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    leaked = settle(leaked_pairs(docs, benchmark, share, width).select(F.col("doc_id").alias("leaked_id"), F.col("text_hash").alias("leaked_text")).distinct())
    th = fresh(docs, "text_hash")
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    gone = broadcast_bounded(leaked, BROADCAST_ROWS)
    return rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["leaked_id"]) & (rows[th] == gone["leaked_text"]), "left_anti").drop(th)
