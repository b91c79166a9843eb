"""Connected components of an undirected graph, by alternating star contractions.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest node it knows; the graph ends up as one star for each component.
Rows are pairs of longs, written after every round.  Neighbourhoods are only
aggregated and joined, never gathered, so a hub is no heavier than its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import Newest


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node go to the smallest of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and itself, go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for all nodes but those smallest ones.

    ``edges`` has the columns ``a`` and ``b``.
    """
    rounds = Newest(edges.sparkSession, "edges")
    now = rounds.set(edges.select("a", "b").where("a <> b").distinct())
    before, state = None, _state(now)
    while state != before and state[0]:
        now = rounds.set(_small(_large(now)))
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
