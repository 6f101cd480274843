"""Nested arrays: offsets and the way between flat and nested form.

Running figures over a whole table go through two passes: the table is sorted into
ranges that are written out, each range is scanned by itself, and one row of each
range says what the later ones begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _ranges(df: DataFrame, order: str) -> DataFrame:
    """With ``__range``, ascending in ``order``; written out, so that all passes see the same ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, order).withColumn("__range", F.spark_partition_id()))


def _carried(ranged: DataFrame, figure: Column, carry: Column) -> DataFrame:
    """(__range, __before): ``carry`` over the figures of all earlier ranges, of which there are few."""
    each = ranged.groupBy("__range").agg(figure.alias("__own"))
    return each.select("__range", carry.over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))


def length_to_ptrs(df: DataFrame, order: str, length: str, out: str = "ptr") -> DataFrame:
    """1-based offsets from lengths: an exclusive prefix sum plus one."""
    ranged = _ranges(df, order)
    before = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.broadcast(_carried(ranged, F.sum(length), F.sum("__own")))  # a row for each range
    own = F.coalesce(F.sum(length).over(before), F.lit(0))
    return ranged.withColumn("__own", own).join(start, "__range").withColumn(out, (F.col("__own") + F.coalesce("__before", F.lit(0)) + 1).cast("long")).drop("__range", "__own", "__before")


def rewind_ptrs(df: DataFrame, order: str, ptr: str, out: str = "ptr") -> DataFrame:
    """Offsets moved on by one place; the first is 1."""
    ranged = _ranges(df.withColumn("__ptr", F.col(ptr).cast("long")), order)
    last = F.broadcast(_carried(ranged, F.max_by("__ptr", order), F.last("__own")))  # a row for each range
    inside = F.lag("__ptr").over(Window.partitionBy("__range").orderBy(order))
    moved = ranged.withColumn("__inside", inside).join(last, "__range").withColumn(out, F.coalesce("__inside", "__before", F.lit(1)).cast("long"))
    return moved.drop("__range", "__ptr", "__inside", "__before")


def flatten(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, pos, v) with pos from 1; empty arrays give no rows."""
    return df.select(key, F.posexplode(values).alias("pos", "v")).withColumn("pos", F.col("pos") + 1)


def nest(df: DataFrame, key: str, pos: str = "pos", value: str = "v") -> DataFrame:
    """(key, values) from (key, pos, v)."""
    packed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("values"))
    return packed.select(key, F.transform("values", lambda s: s[value]).alias("values"))
