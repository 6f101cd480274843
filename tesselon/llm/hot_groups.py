"""Connecting the members of groups that are too large for one task.

A group is dealt out to chunks. Each chunk finds its own edges and names the
members with the most partners; the best of them, the hubs, are then held against
every chunk. Both rounds take work in proportion to the group. What they connect
needs no further comparison, so only members outside the group's largest component
are compared with all others, as pairs of chunks. No edge between components is
missed, whatever the first rounds find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .components import components

#: Members with the most partners that a chunk names and that a group uses.
NAMED, HUBS = 4, 64
#: Chunks whose hubs are ranked together before all are.
RANKED = 512
#: Groups whose figures are broadcast at most.
FEW_GROUPS = 200_000

#: Edges (a, b) of a group, or a member a with its degree, from rows (group, item, task, i, j, side, ...).
Compare = Callable[[DataFrame, bool], DataFrame]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_GROUPS else df


def connecting_edges(groups: DataFrame, known: DataFrame, compare: Compare) -> DataFrame:
    """(a, b): edges that, with ``known`` ones, connect what all edges of the groups connect.

    ``groups`` has group, item, chunks (how many its group is cut into) and what
    ``compare`` needs besides. Sides 0 and 1 of a task are compared with each
    other, side 2 with everything; ``compare(rows, True)`` also names hubs.
    """
    own = F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")
    placed = groups.withColumn("i", own).withColumn("task", F.col("group"))
    alone = placed.withColumn("j", F.col("i")).withColumn("side", F.lit(2))
    first = cut(compare(alone, True))

    named = first.filter("degree is not null").select("group", F.col("a").alias("item"), "degree")
    for by in (["group", "part"], ["group"]):
        named = named.withColumn("part", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(RANKED)))
        named = named.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("degree"), "item"))).filter(F.col("k") <= HUBS)
    hubs = _small(cut(named.select("group", "item")))
    spread = groups.join(hubs, ["group", "item"], "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.withColumn("task", F.col("group")).withColumn("j", F.lit(-2)).withColumn("side", F.lit(0))
    others = placed.withColumn("j", F.lit(-2)).withColumn("side", F.lit(1))
    second = cut(compare(others.unionByName(spread), False))
    edges = first.filter("degree is null").unionByName(second).select("a", "b")

    roots = cut(components(known.unionByName(edges)))
    joined = groups.join(roots.select(F.col("node").alias("item"), "root"), "item", "left").withColumn("root", F.coalesce("root", "item"))
    sizes = joined.groupBy("group", "root").agg(F.count("*").alias("n"), F.first("chunks").alias("chunks"))
    sizes = sizes.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("giant"), F.max("n").alias("inside"), F.sum("n").alias("n"), F.first("chunks").alias("k"))
    share = lambda c: F.ceil(c * F.col("k") / F.col("n")).cast("int")
    sizes = cut(sizes.filter("n > inside").select("group", "giant", share(F.col("inside")).alias("within"), share(F.col("n") - F.col("inside")).alias("outside")))
    if sizes.isEmpty():
        return edges
    left = joined.join(_small(sizes), "group")
    out = F.col("root") != F.col("giant")
    place = F.when(out, F.pmod(F.xxhash64("item"), F.col("outside"))).otherwise(F.col("outside") + F.pmod(F.xxhash64("item"), F.col("within"))).cast("int")
    last = F.when(out, F.col("outside") + F.col("within")).otherwise(F.col("outside")) - 1
    pairs = left.withColumn("own", place).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    pairs = pairs.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", side).withColumn("task", F.col("group"))
    return edges.unionByName(compare(pairs, False).select("a", "b"))
