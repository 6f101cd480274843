"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours join the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours join the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the least node that can be reached.

    Loops and repeated edges don't matter; rows with a null end are ignored. Each
    round is written to the checkpoint folder, and the rounds end when the stars
    no longer change (a logarithmic number of rounds). A node with very many
    neighbours is only ever aggregated partially or joined, never gathered.
    """
    now = cut(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    stamp = _stamp(now)
    while stamp[0]:
        now = cut(_small_star(_large_star(now)))
        before, stamp = stamp, _stamp(now)
        if stamp == before:
            break
    roots = now.select("a").distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
