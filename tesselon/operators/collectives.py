"""Collectives over parts: a table (part, x) holds one item of each part."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prange import parts_table

MAIN = 1


def tuple_of_arrays(df: DataFrame, column: str) -> DataFrame:
    """A struct column's fields as columns."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def array_of_tuples(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Columns as one struct column."""
    return df.select(*[c for c in df.columns if c not in columns], F.struct(*columns).alias(out))


def map_main(df: DataFrame, f: Callable[[Column], Column], main: int | str = MAIN, otherwise: Column | None = None) -> DataFrame:
    """f on the item of one part (or of all), ``otherwise`` (or null) elsewhere."""
    if main == "all":
        return df.withColumn("x", f(F.col("x")))
    return df.withColumn("x", F.when(F.col("part") == main, f(F.col("x"))).otherwise(F.lit(None) if otherwise is None else otherwise))


def map_parts(df: DataFrame, f: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f(part, rows)`` on all rows of each part, which meet in one task; ``schema`` is that of its result."""
    return df.groupBy("part").applyInPandas(lambda rows: f(int(rows["part"].iloc[0]), rows), schema)


def any_item(df: DataFrame):
    """The item of some part, the first that has one; null without any."""
    found = df.agg(F.min_by("x", "part")).first()
    return found[0]


def _parts(df: DataFrame, parts: int) -> DataFrame:
    return parts_table(df.sparkSession, parts)


def gather(df: DataFrame, parts: int, destination: int | str = MAIN) -> DataFrame:
    """(part, pos, x): the items of all parts in order, at the destination or everywhere."""
    items = df.select(F.col("part").alias("pos"), "x")
    if destination == "all":
        return items.join(F.broadcast(_parts(df, parts)), F.lit(True)).select("part", "pos", "x")
    return items.select(F.lit(destination).alias("part"), "pos", "x")


def scatter(df: DataFrame, source: int, parts: int) -> DataFrame:
    """(part, x): the i-th entry of the source's array goes to part i; its length must be the number of parts."""
    own = df.filter(F.col("part") == source).select(F.posexplode("x").alias("pos", "x"))
    checked = own.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    fits = F.assert_true(F.col("n") == parts, F.lit("the source needs one item for each part"))
    return checked.select((F.col("pos") + 1).cast("int").alias("part"), F.when(fits.isNull(), F.col("x")).alias("x"))


def multicast(df: DataFrame, source: int, parts: int) -> DataFrame:
    """(part, x): the source's item everywhere."""
    one = df.filter(F.col("part") == source).select("x")
    return _parts(df, parts).join(F.broadcast(one), F.lit(True))


emit = multicast


def scan(df: DataFrame, init, kind: str = "inclusive", op: str | Callable[[Column, Column], Column] = "sum") -> DataFrame:
    """(part, x): prefix sums (or folds) over parts.

    Inclusive begins with op(x1, init); exclusive begins with init. There is one
    row for each part, so the window is small.
    """
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0 if kind == "inclusive" else -1)
    start = F.lit(init)
    if op == "sum":
        return df.select("part", (start + F.coalesce(F.sum("x").over(w), F.lit(0))).alias("x"))
    if op in ("max", "min"):
        pick, both = (F.max, F.greatest) if op == "max" else (F.min, F.least)
        return df.select("part", both(start, pick("x").over(w)).alias("x"))
    return df.select("part", F.aggregate(F.collect_list("x").over(w), start, op).alias("x"))


def reduction(df: DataFrame, init, destination: int | str = MAIN, op: str = "sum") -> DataFrame:
    """(part, x): everything reduced, at the destination (init elsewhere) or everywhere."""
    total = {"sum": F.sum, "max": F.max, "min": F.min, "and": F.bool_and, "or": F.bool_or}[op]("x")
    both = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least, "and": lambda a, b: a & b, "or": lambda a, b: a | b}[op]
    one = df.agg(F.coalesce(both(total, F.lit(init)), F.lit(init)).alias("r"))
    out = df.select("part").join(F.broadcast(one), F.lit(True))
    value = F.col("r") if destination == "all" else F.when(F.col("part") == destination, F.col("r")).otherwise(F.lit(init))
    return out.select("part", value.alias("x"))


def exchange_graph(snd: DataFrame, within: DataFrame | None = None, rcv: DataFrame | None = None, symmetric: bool = False, find_rcv: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(src, snd_pos, dst, rcv_pos) from (src, snd_pos, dst).

    The receiving side is the same edges seen from dst, in order of src. With
    ``within``, a graph of neighbours, every edge must be one of its edges. ``rcv``
    (dst, rcv_pos, src) gives the receiving side instead and must have the same
    edges; ``find_rcv`` makes it from the sending side; in a ``symmetric`` graph
    every part receives from those it sends to, in the same order.
    """
    if within is not None and not snd.join(within.select("src", "dst"), ["src", "dst"], "left_anti").isEmpty():
        raise ValueError("an edge leads to a part that isn't a neighbour")
    if symmetric:
        rcv = snd.select(F.col("src").alias("dst"), F.col("snd_pos").alias("rcv_pos"), F.col("dst").alias("src"))
    elif find_rcv is not None:
        rcv = find_rcv(snd)
    if rcv is not None:
        if not is_consistent(snd, rcv):
            raise ValueError("the receiving side has other edges than the sending side")
        return snd.join(rcv.select("src", "dst", "rcv_pos"), ["src", "dst"]).select("src", "snd_pos", "dst", "rcv_pos")
    place = F.row_number().over(Window.partitionBy("dst").orderBy("src", "snd_pos"))
    return snd.select("src", "snd_pos", "dst", place.alias("rcv_pos"))


def reverse(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("dst").alias("src"), F.col("rcv_pos").alias("snd_pos"), F.col("src").alias("dst"), F.col("snd_pos").alias("rcv_pos"))


def is_consistent(snd: DataFrame, rcv: DataFrame) -> bool:
    """Whether each (src, dst) edge is exactly once on both sides."""
    count = lambda d: d.groupBy("src", "dst").count()
    both = count(snd).alias("a").join(count(rcv).alias("b"), ["src", "dst"], "full_outer")
    return both.filter("coalesce(a.count, 0) <> 1 or coalesce(b.count, 0) <> 1").isEmpty()


def exchange(payload: DataFrame, graph: DataFrame) -> DataFrame:
    """(part, pos, x) as received, from (src, snd_pos, x)."""
    moved = payload.join(graph, ["src", "snd_pos"])
    return moved.select(F.col("dst").alias("part"), F.col("rcv_pos").alias("pos"), "x")


def reduce_by(op: Callable, items: list):
    """A plain fold on the driver, for items that are one per part."""
    return reduce(op, items)
