"""Connected components of a graph of any shape, in rounds of two shuffles each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A node with more pairs than this is joined apart, by broadcast, up to so many such nodes.
HUB, MOST_HUBS = 100_000, 100_000


def least_neighbours(pairs: DataFrame) -> DataFrame:
    """(u, m) for pairs (u, v): the smallest v of each u, first within tasks, then over them, so a hub is no one task's work."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def onto(pairs: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """pairs (`size` at most) with m of their u. A u of over HUB pairs is joined by broadcast (those are at most size / HUB), the others by shuffling."""
    if size <= HUB:
        return pairs.join(least, "u")
    hubs = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).select("u")
    hubs = written(hubs.join(least, "u"), "hubs")
    n = hubs.count()
    if not n:
        return pairs.join(least, "u")
    if n > MOST_HUBS:
        return pairs.join(least, "u")  # so many large nodes spread over the tasks by themselves
    small = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least, "u")
    return pairs.join(F.broadcast(hubs), "u").unionByName(small)


def stars(edges: DataFrame) -> bool:
    """Whether different edges (a > b) make disjoint stars around their b: no node has two b, and no b is an a. Counted within tasks first."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up + down > 1 and up > 0").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b: long, in any direction); root is the smallest node reachable.

    Alternates between linking every node's larger neighbours and its smaller ones to the smallest of
    them, until only stars are left; the rounds grow with the logarithm of a component's diameter. Edges stay
    at most as many as they were, and each round's are a written table. No edges: an empty table.
    No stars after `rounds` rounds: an error, never an unfinished result.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        size = now.count()
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = least_neighbours(both).select("u", F.least("u", "m").alias("m"))
        star = onto(both.filter("v > u"), least, 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(star, "star")
        low = least_neighbours(star)
        small = onto(star, low, size).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b")).distinct()
        now = written(small, "edges")
    raise RuntimeError(f"components still change after {rounds} rounds")
