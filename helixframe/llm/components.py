"""Connected components of an edge table, as DataFrame jobs (used by the similarity join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node on an edge ``a, b``; component: the smallest node it reaches.

    Alternating large-star and small-star steps (Kiveris and others, 2014): every node hangs on
    the smallest neighbour, so a component becomes a star in a logarithmic number of rounds.
    Self-loops and repeated edges are allowed; no edges, no rows.
    """
    now = stored(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = _print(now)
    for _ in range(MAX_ROUNDS):
        before = now
        half = _star(before, large=True)
        now = _star(half, large=False)
        found = _print(now)
        drop_stored(before)
        drop_stored(half)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _print(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.bit_xor(F.xxhash64("b", "a", F.lit(1))).alias("g")).first()
    return r["n"], r["h"], r["g"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))  # pre-aggregated, so a hub costs one row a task
    if large:
        moved = both.filter("b > a").join(lowest, "a").select(F.col("low").alias("a"), "b")
    else:
        own = lowest.select(F.col("low").alias("a"), F.col("a").alias("b"))
        moved = both.filter("b < a").join(lowest, "a").select(F.col("low").alias("a"), "b").unionByName(own)
    return stored(moved.filter("a <> b").distinct(), "star")
