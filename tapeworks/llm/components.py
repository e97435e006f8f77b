"""Connected components of a link table by alternating large and small stars, all in joins and combined aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_ROUNDS = 60


def connected_stars(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (node, root): every linked node but the roots, with the smallest node it reaches.

    Each round hooks neighbours to the smallest neighbour (large star: the larger ones; small star: the smaller ones), which keeps
    components whole and shrinks their depth, and stops when nothing changes.  A hub's rows are combined before they are shuffled
    (minimum per node) or lie in joins whose large partitions are split at run time.  Every round is checkpointed.
    Null ends and self links are ignored; repeated links change nothing; an empty table has no components.
    """
    edges = settle(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                   .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if before is not None and tuple(state) == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = tuple(state)
        if not state[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        large = settle(large)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hooked = large.join(low, "hi")
        edges = settle(hooked.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
                       .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
    raise RuntimeError("components did not settle")
