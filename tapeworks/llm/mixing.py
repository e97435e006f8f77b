"""Mixing sources to target weights, in whole blocks.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``SHARE`` of all words; a target stops at ``CAP`` times its
source and the excess is shared again by weight.  With all sources ordered by cap over weight, the stopped ones come first, so the level of the others
is one running sum.

Blocks: a seeded hash of doc_id and text deals each source's documents into ``BLOCKS`` blocks; only words per (source, block) are summed.  The
blocks of a source lie in a seeded random order (the one of ``TRIES`` orders that comes nearest to the target), and its draw is a run of that order,
passing through it again for what exceeds the source: the source's exact quota of blocks.

Splitting tree: a node holds a quota of blocks per source.  Its left half of the output shards gets a multivariate hypergeometric part of
it, drawn source by source from hypergeometric laws (inversion of the exact probabilities, outward from the mode), the right half the
rest, down to single shards.  Each shard then takes its own disjoint run of every source's drawn blocks, and a row's ``mix_key``
is its random place inside the shard.

A row finds its draws by (source, block) in a table of ``BLOCKS`` rows a source, broadcast when counted small; texts are never moved.  A hot source is
spread over all its blocks.  One row per tree node holds a number per source.  Reruns agree: all randomness is hashes.

Null texts have size zero and are dealt like others; null is a source of its own; equal rows share a block and its draws; an empty table
gives an empty result; other columns pass through and derived names avoid those that exist.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_bounded, fresh, let, settle, words_in

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCKS = 1024
TRIES = 8
SHARDS = 16
SEED = 7
BROADCAST_ROWS = 1_000_000


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with weight and target."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.row_number().over(named) - 1) % len(WEIGHTS) + 1).cast("int"))
    every = Window.partitionBy()
    table = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    table = table.withColumn("amount", F.sum("source_size").over(every) * share)
    stopping = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = stopping.rowsBetween(Window.unboundedPreceding, -1), stopping.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("amount") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    table = table.withColumn("level", level).withColumn("stopped", F.col("limit") <= F.col("level") * F.col("weight"))
    # once a source isn't stopped, none after it is; levels fall from there on, so the first, which holds for all of them, is the largest
    final = F.max(F.when(~F.col("stopped"), F.col("level"))).over(every)
    return table.select("source", "source_size", "weight", F.when(F.col("stopped"), F.col("limit")).otherwise(F.least("limit", final * F.col("weight"))).alias("target"))


def _unit(*key: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + 0.5) / F.lit(float(2**53))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """A draw: how many of ``drawn`` out of ``total`` blocks are among the ``good`` ones, by inversion with u in (0, 1).

    Values are taken in the order mode, mode + 1, ..., mode - 1, mode - 2, ..., each weight from its neighbour by the exact ratio;
    what lies more than 12 standard deviations out weighs less than a double can hold beside the rest.
    """
    one = F.lit(1).cast("long")

    def ranges(p: Column) -> Column:
        low, high = F.greatest(F.lit(0).cast("long"), p["drawn"] + p["good"] - p["total"]), F.least(p["drawn"], p["good"])
        middle = F.floor((p["drawn"] + 1.0) * (p["good"] + 1.0) / (p["total"] + 2.0)).cast("long")
        bad = p["total"] - p["good"]
        spread = F.sqrt(p["drawn"] * 1.0 * p["good"] * bad * (p["total"] - p["drawn"]) / F.greatest(p["total"] - 1, one)) / F.greatest(p["total"], one)
        return F.struct(p["good"].alias("good"), p["drawn"].alias("drawn"), (bad - p["drawn"]).alias("other"), p["u"].alias("u"), low.alias("low"),
                        high.alias("high"), F.greatest(low, F.least(high, middle)).alias("mode"), (F.ceil(spread * 12) + 8).cast("long").alias("reach"))

    def bounds(p: Column) -> Column:
        top, bottom = F.least(p["high"], p["mode"] + p["reach"]), F.greatest(p["low"], p["mode"] - p["reach"])
        return F.struct(*(p[c].alias(c) for c in ("good", "drawn", "other", "u", "mode")), (top - p["mode"]).alias("up"), (top - bottom).alias("steps"))

    def weigh(p: Column, s: Column, i: Column) -> Column:
        """Weight of the i-th value, relative to the mode's, from that before it."""
        k = F.when(i <= p["up"], p["mode"] + i).otherwise(p["mode"] + p["up"] - i)
        risen = s["w"] * (p["good"] - k + 1) * (p["drawn"] - k + 1) / (k * (p["other"] + k))
        fallen = F.when(i == p["up"] + 1, 1.0).otherwise(s["w"]) * (k + 1) * (p["other"] + k + 1) / ((p["good"] - k) * (p["drawn"] - k))
        return F.struct(k.alias("k"), F.when(i == 0, 1.0).when(i <= p["up"], risen).otherwise(fallen).alias("w"))

    def invert(p: Column) -> Column:
        steps = F.sequence(F.lit(0).cast("long"), p["steps"])
        nothing = F.struct(F.lit(None).cast("long").alias("k"), F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        added = lambda s, i: let(weigh(p, s, i), lambda x: F.struct(x["k"].alias("k"), x["w"].alias("w"), (s["sum"] + x["w"]).alias("sum")))
        goal = F.aggregate(steps, nothing, added)["sum"] * p["u"]
        until = lambda g: F.aggregate(steps, nothing, lambda s, i: F.when(s["sum"] >= g, s).otherwise(added(s, i)))["k"]
        return let(goal, until)

    given = F.struct(total.cast("long").alias("total"), good.cast("long").alias("good"), drawn.cast("long").alias("drawn"), u.alias("u"))
    return let(let(let(given, ranges), bounds), invert)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """One row with ``q`` (blocks per source, an array) -> one row per shard with its quota array."""
    nodes = quotas.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), F.col("q"))
    for _ in range(math.ceil(math.log2(max(1, shards)))):
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        halves = nodes.select("low", "high", "q", middle.alias("mid"), total.alias("total"))
        want = F.floor(F.col("total") * (F.col("mid") - F.col("low")) / (F.col("high") - F.col("low"))).cast("long")
        halves = halves.withColumn("want", F.when(F.col("high") - F.col("low") > 1, want).otherwise(F.col("total")))

        def draw(s: Column, x: Column) -> Column:
            k = hypergeometric(s["total"], x, s["want"], _unit(F.lit(seed), F.col("low"), F.col("high"), F.size(s["out"])))
            return let(k, lambda k: F.struct((s["total"] - x).alias("total"), (s["want"] - k).alias("want"), F.concat(s["out"], F.array(k)).alias("out")))

        start = F.struct("total", "want", F.array().cast("array<bigint>").alias("out"))
        left = halves.select("low", "high", "mid", "q", F.aggregate("q", start, draw)["out"].alias("l"))
        parts = F.when(F.col("high") - F.col("low") > 1, F.array(
            F.struct("low", F.col("mid").alias("high"), F.col("l").alias("q")),
            F.struct(F.col("mid").alias("low"), "high", F.zip_with("q", "l", lambda a, b: a - b).alias("q")))).otherwise(F.array(F.struct("low", "high", "q")))
        nodes = left.select(F.explode(parts).alias("n")).select("n.*")
    return nodes.select(F.col("low").alias("shard"), "q")


def _block(seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(blocks)).cast("int")


def block_draws(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """One row per (source, block) that has documents: source_size, target and ``draws``, an array of (pass, shard)."""
    rows = docs.select(F.col("source").cast("string").alias("source"), _block(seed, blocks).alias("block"), words_in(F.col("text")).alias("size"))
    sums = settle(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    targets = settle(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    ordered = sums.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(
        "b.source", "block", "words", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("attempt"))
    own = Window.partitionBy("source", "attempt")
    run = own.orderBy(F.xxhash64("block", "source", "attempt", F.lit(seed + 1)), "block")
    # what remains of the target in the last, partial pass; a block is drawn when more of it lies inside than outside
    passes = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    ordered = (ordered.withColumn("place", F.row_number().over(run) - 1).withColumn("n", F.count("*").over(own)).withColumn("passes", passes.cast("long"))
               .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
               .withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0))))
    ordered = ordered.withColumn("inside", (F.col("upto") - F.col("words") / 2 <= F.col("rest")) & (F.col("rest") > 0))
    ordered = ordered.withColumn("last", F.sum(F.col("inside").cast("long")).over(own))
    ordered = ordered.withColumn("miss", F.abs(F.sum(F.when(F.col("inside"), F.col("words")).otherwise(0)).over(own) - F.col("rest")))
    best = F.min(F.struct("miss", "attempt")).over(Window.partitionBy("source"))["attempt"]
    chosen = settle(ordered.withColumn("best", best).filter("attempt = best")
                    .select("source", "block", "words", "source_size", "target", "place", "n", "passes", "last"))
    quota = (F.col("passes") * F.col("n") + F.col("last")).cast("long")
    quotas = chosen.groupBy("source").agg(F.max(quota).alias("quota"))
    ranked = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota")))
    listed = quotas.agg(ranked.alias("s")).select("s", F.transform("s", lambda x: x["quota"]).alias("q"))
    tree = settle(split_quotas(listed.select("q"), shards, seed).select("shard", F.posexplode("q").alias("at", "k")))
    ends = (tree.withColumn("end", F.sum("k").over(Window.partitionBy("at").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("at").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")))
    sources = listed.select(F.posexplode("s").alias("at", "x")).select("at", "x.source", "x.quota")
    runs = settle(sources.join(ends, "at").select("source", "quota", "ends"))
    # the p-th pass draws the block as number p * n + place of its source; the shard whose run holds that number takes it
    number = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("passes"), F.lit(0).cast("long")))
    drawn = F.filter(F.transform(number, lambda p: F.struct(p.cast("int").alias("pass"), (p * F.col("n") + F.col("place")).alias("number"))),
                     lambda d: d["number"] < F.col("quota"))
    draws = F.transform(drawn, lambda d: F.struct(d["pass"].alias("pass"), F.filter("ends", lambda e: e["end"] > d["number"])[0]["shard"].alias("shard")))
    return chosen.alias("c").join(runs.alias("r"), F.expr("c.source <=> r.source")).select(
        "c.source", "block", "source_size", "target", draws.alias("draws"))


def with_draws(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """docs with source_size, target and draws of every row, and the names these columns got."""
    table = settle(block_draws(docs, shards, blocks, seed))
    names = {c: fresh(docs, c) for c in ("source_size", "target", "draws", "block")}
    found = broadcast_bounded(table, BROADCAST_ROWS)
    rows = docs.withColumn(names["block"], _block(seed, blocks))
    same = rows["source"].cast("string").eqNullSafe(found["source"]) & (rows[names["block"]] == found["block"])
    out = rows.join(found, same).select(*(rows[c] for c in docs.columns), *(found[c].alias(names[c]) for c in ("source_size", "target", "draws")))
    return out, names


def mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The drawn rows with all their columns (a row drawn in two passes twice), ``shard`` and ``mix_key``, the random order inside the shard."""
    rows, names = with_draws(docs, shards, blocks, seed)
    draw, shard, key = (fresh(rows, c) for c in ("draw", "shard", "mix_key"))
    drawn = rows.withColumn(draw, F.explode(names["draws"]))
    return drawn.select(*docs.columns, F.col(draw)["shard"].alias(shard), F.xxhash64("doc_id", "text", F.col(draw)["pass"], F.lit(seed + 2)).alias(key))


def write_mix(docs: DataFrame, path: str, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> None:
    """The mix in one folder per shard; rows are shuffled locally, by their random key."""
    mixed = mix(docs, shards, blocks, seed)
    shard, key = mixed.columns[-2:]
    mixed.repartitionByRange(shard, key).sortWithinPartitions(shard, key).drop(key).write.mode("overwrite").partitionBy(shard).parquet(path)
