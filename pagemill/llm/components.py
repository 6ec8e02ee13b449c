"""Connected components of links between rows, as tables that never meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import discard, materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, for all nodes of ``edges`` (a, b).

    Large-star and small-star steps by turns: each node hangs its greater neighbours, then
    itself and its smaller ones, on the least of all. Both are a ``min`` with map-side
    combine and a join, so a node with any number of neighbours needs no list. The rows
    of each turn are written to shared scratch space.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = materialize(current, "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_least_neighbour(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            small.select("u", F.col("least").alias("v"))
        )
        last, current = current, materialize(small.where("u <> v").distinct(), "edges")
        discard(last)
        sums = F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
        state = tuple(current.agg(F.count("*"), sums).first())
        if state == before:
            break
        before = state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    labels = materialize(
        current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "labels"
    )
    discard(current)
    return labels
