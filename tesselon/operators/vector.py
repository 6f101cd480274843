"""Distributed vectors: a value for every local id, own ones counting in reductions.

``df`` has part, lid, gid, owner, own (whether the part owns the entry) and v.
Ghost values may be stale until ``consistent``; ``assemble`` adds them to their
owners and zeroes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from ..plans.lineage import cut
from .prange import PRange, numbered, parts_table

#: How contributions to the same id combine, and what no contribution gives.
COMBINE = {"+": F.sum, "max": F.max, "min": F.min, "*": F.product, "&": F.bool_and, "|": F.bool_or}
NEUTRAL = {"+": 0.0, "max": float("-inf"), "min": float("inf"), "*": 1.0, "&": True, "|": False}


@dataclass(frozen=True)
class PVector:
    df: DataFrame
    rows: PRange

    def __repr__(self) -> str:
        return f"vector of length {self.rows.n} partitioned into {self.rows.parts} parts"

    # -- views

    def own(self) -> DataFrame:
        return self.df.filter("own")

    def own_values(self) -> DataFrame:
        return self.own().select("part", "gid", "v")

    def ghost_values(self) -> DataFrame:
        return self.df.filter("not own").select("part", "gid", "v")

    def local_values(self) -> DataFrame:
        return self.df.select("part", "lid", "gid", "v")

    def gvec(self) -> DataFrame:
        """(gid, v), own entries only."""
        return self.own().select("gid", "v")

    def collect(self) -> list:
        """The dense vector in order of ids; for vectors that fit the driver."""
        return [r[0] for r in self.gvec().orderBy("gid").select("v").collect()]

    def cut(self) -> PVector:
        """The same values with their lineage cut."""
        return PVector(cut(self.df), self.rows)

    # -- element-wise

    def map(self, f: Callable[[Column], Column]) -> PVector:
        return PVector(self.df.withColumn("v", f(F.col("v"))), self.rows)

    def zip(self, other: PVector, f: Callable[[Column, Column], Column]) -> PVector:
        """f of both values; ghosts only where both share their layout, own entries otherwise.

        Both must have as many ids and parts.
        """
        self.rows.check_like(other.rows, "vectors")
        if other.rows is self.rows:
            right = other.df.select("part", "lid", F.col("v").alias("__w"))
            joined = self.df.join(right, ["part", "lid"])
        else:
            right = other.gvec().withColumnRenamed("v", "__w")
            joined = self.own().join(right, "gid")
        rows = self.rows if other.rows is self.rows else self.rows.remove_ghost()
        out = joined.withColumn("v", f(F.col("v"), F.col("__w"))).select("part", "lid", "gid", "owner", "own", "v")
        if other.rows is not self.rows:
            out = out.drop("lid").join(rows.index.select("part", "gid", "lid"), ["part", "gid"]).select("part", "lid", "gid", "owner", "own", "v")
        return PVector(out, rows)

    def __add__(self, other: PVector) -> PVector:
        return self.zip(other, lambda a, b: a + b)

    def __sub__(self, other: PVector) -> PVector:
        return self.zip(other, lambda a, b: a - b)

    def __neg__(self) -> PVector:
        return self.map(lambda v: -v)

    def __pos__(self) -> PVector:
        return self

    def __mul__(self, a: float) -> PVector:
        return self.map(lambda v: v * F.lit(a))

    __rmul__ = __mul__

    def __truediv__(self, a: float) -> PVector:
        return self * (1 / a)

    def fill(self, a) -> PVector:
        return self.map(lambda _: F.lit(a))

    def axpy(self, a: float, other: PVector) -> PVector:
        """self + a * other."""
        return self.zip(other, lambda x, y: x + F.lit(a) * y)

    # -- reductions over own entries

    def reduce(self, op: str = "+", init=None):
        value = COMBINE[op](F.col("v"))
        found = self.own().agg(F.coalesce(value, F.lit(NEUTRAL[op]))).first()[0]
        if init is None:
            return found
        return {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "max": max, "min": min, "&": lambda a, b: a and b, "|": lambda a, b: a or b}[op](found, init)

    def sum(self):
        return self.reduce("+")

    def maximum(self, f: Callable[[Column], Column] = lambda v: v):
        return self.map(f).reduce("max")

    def minimum(self, f: Callable[[Column], Column] = lambda v: v):
        return self.map(f).reduce("min")

    def any(self, f: Callable[[Column], Column]) -> bool:
        return self.map(f).reduce("|")

    def all(self, f: Callable[[Column], Column]) -> bool:
        return self.map(f).reduce("&")

    def dot_column(self, other: PVector) -> DataFrame:
        """One row (dot)."""
        self.rows.check_like(other.rows, "dot")
        right = other.gvec().withColumnRenamed("v", "w")
        return self.gvec().join(right, "gid").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("dot"))

    def dot(self, other: PVector) -> float:
        if other is self:
            return self.map(lambda v: v * v).reduce("+")
        return self.dot_column(other).first()[0]

    def norm(self, p: float = 2) -> float:
        """(sum of |v|^p)^(1/p); the largest |v| for infinity."""
        return self.own().agg(norm_of(F.col("v"), p)).first()[0] or 0.0

    def equals(self, other: PVector) -> bool:
        """Whether the own values are the same; false for other lengths."""
        if self.rows.n != other.rows.n:
            return False
        joined = self.gvec().join(other.gvec().withColumnRenamed("v", "w"), "gid", "full_outer")
        return joined.filter("not (v <=> w)").isEmpty()

    def distance(self, other: PVector, metric: str) -> float:
        self.rows.check_like(other.rows, "distance")
        joined = self.gvec().join(other.gvec().withColumnRenamed("v", "w"), "gid")
        return joined.agg(METRICS[metric](F.col("v"), F.col("w"))).first()[0]

    # -- ghosts

    def consistent(self, rows: PRange | None = None) -> PVector:
        """Ghosts (of a new layout if given) get their owners' values."""
        rows = rows or self.rows
        layout = rows.index.select("part", "lid", "gid", "owner", (F.col("own_id") > 0).alias("own"))
        joined = layout.join(self.gvec(), "gid").select("part", "lid", "gid", "owner", "own", "v")
        return PVector(joined, rows)

    def assemble(self, op: str = "+", keep_ghosts: bool = True) -> PVector:
        """Every ghost value is combined into its owner; ghosts then are 0, or dropped."""
        whole = self.df.groupBy("gid").agg(COMBINE[op]("v").alias("__w"))
        rows = self.rows if keep_ghosts else self.rows.remove_ghost()
        base = self.df if keep_ghosts else self.own()
        out = base.join(whole, "gid").withColumn("v", F.when(F.col("own"), F.col("__w")).otherwise(F.lit(0).cast(self.df.schema["v"].dataType)))
        out = out.select("part", "lid", "gid", "owner", "own", "v")
        if not keep_ghosts:
            out = out.drop("lid").join(rows.index.select("part", "gid", "lid"), ["part", "gid"]).select("part", "lid", "gid", "owner", "own", "v")
        return PVector(out, rows)

    # -- layout

    def assemble_arrays(self) -> PVector:
        """``assemble`` for arrays as values: sums place by place; an array is as long as the longest that came."""
        flat = self.df.select("gid", F.posexplode("v").alias("__k", "__x")).groupBy("gid", "__k").agg(F.sum("__x").alias("__x"))
        whole = flat.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("__k", "__x"))).alias("__w"))
        kind = self.df.schema["v"].dataType
        joined = self.df.join(whole, "gid", "left").withColumn("v", F.when(F.col("own"), F.coalesce(F.transform("__w", lambda s: s["__x"]), F.array())).otherwise(F.transform("v", lambda _: F.lit(0))).cast(kind))
        return PVector(joined.select("part", "lid", "gid", "owner", "own", "v"), self.rows)

    def repartition(self, rows: PRange, reversed: bool = False) -> PVector:
        """The same values under another layout's own entries.

        ``reversed`` is the way back: ``rows`` is where the values came from, ghosts included.
        """
        self.rows.check_like(rows, "repartition", parts=False)
        return self.consistent(rows) if reversed else self.consistent(rows.remove_ghost())

    def renumber(self, rows: PRange | None = None) -> PVector:
        """Under contiguous ids; ``rows`` is a renumbered layout that is there already."""
        new = rows or self.rows.renumber()
        if new is self.rows:
            return self
        self.rows.check_like(new, "renumber", parts=False)
        moved = self.df.join(self.rows.new_ids(), "gid").drop("gid").withColumnRenamed("new_gid", "gid")
        return PVector(moved.select("part", "lid", "gid", "owner", "own", "v"), new)

    def find_local_indices(self) -> tuple[PRange, DataFrame]:
        """For a vector of booleans: the partition of the true entries, and (part, dof, node) between local ids.

        True own entries are numbered contiguously in the order of parts; ghosts follow their owners.
        """
        true = self.own().filter("v")
        per_part = true.groupBy("part").agg(F.count("*").alias("size"))
        every = parts_table(self.df.sparkSession, self.rows.parts).join(per_part, "part", "left").select("part", F.coalesce("size", F.lit(0)).alias("size"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        start = every.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        k = F.row_number().over(Window.partitionBy("part").orderBy("lid"))
        numbers = true.withColumn("k", k).join(start, "part").select("gid", (F.col("start") + F.col("k")).cast("long").alias("dof"))
        seen = self.df.join(numbers, "gid")
        local = seen.select("part", F.row_number().over(Window.partitionBy("part").orderBy("lid")).alias("lid"), F.col("dof").alias("gid"), "owner", "own", F.col("lid").alias("node"))
        index = numbered(local.drop("node"))
        n = every.agg(F.sum("size")).first()[0] or 0
        blocks = start.select("part", (F.col("start") + 1).alias("start"), (F.col("start") + F.col("size")).alias("stop"))
        return PRange(index, int(n), self.rows.parts, blocks=blocks), local.select("part", F.col("lid").alias("dof"), "node")


def norm_of(v: Column, p: float = 2) -> Column:
    """The p-norm of a column as an aggregation."""
    if p == float("inf"):
        return F.max(F.abs(v))
    if p == 1:
        return F.sum(F.abs(v))
    if p == 2:
        return F.sqrt(F.sum(v * v))
    return F.pow(F.sum(F.pow(F.abs(v), F.lit(float(p)))), F.lit(1.0 / p))


def same_rows(a: PVector, b: PVector) -> bool:
    """Whether both have the same own ids on the same parts in the same order."""
    return a.rows is b.rows or ((a.rows.n, a.rows.parts) == (b.rows.n, b.rows.parts) and a.rows.matches(b.rows, "own"))


# -- constructors


def _layout(rows: PRange) -> DataFrame:
    return rows.index.select("part", "lid", "gid", "owner", (F.col("own_id") > 0).alias("own"))


def pvector_of(rows: PRange, f: Callable[[], Column]) -> PVector:
    """A column expression of part, lid, gid and owner."""
    return PVector(_layout(rows).withColumn("v", f()), rows)


def pfill(v, rows: PRange) -> PVector:
    return pvector_of(rows, lambda: F.lit(v))


def pzeros(rows: PRange, dtype: str = "double") -> PVector:
    return pvector_of(rows, lambda: F.lit(0).cast(dtype))


def pones(rows: PRange, dtype: str = "double") -> PVector:
    return pvector_of(rows, lambda: F.lit(1).cast(dtype))


def prand(rows: PRange, seed: int, choices: Iterable | None = None) -> PVector:
    """Uniform on 0..1, or from a few choices; the same for every copy of an id and any physical layout."""
    u = F.pmod(F.xxhash64(F.lit(seed), "gid"), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    if choices is None:
        return pvector_of(rows, lambda: u)
    items = [F.lit(c) for c in choices]
    return pvector_of(rows, lambda: F.element_at(F.array(*items), (F.floor(u * len(items)) + 1).cast("int")))


def prandn(rows: PRange, seed: int) -> PVector:
    """Standard normal, by Box and Muller from two hashes of the id."""

    def u(k: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "gid"), F.lit(1 << 53)).cast("double") + 1) / F.lit(float(1 << 53))

    return pvector_of(rows, lambda: F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2)))


def pvector(entries: DataFrame, rows: PRange, assemble: bool = True, combine: str = "+") -> PVector:
    """From contributions (part, gid, v) of any part to any id; ids below 1 are ignored.

    Assembled: summed at the owner, 0 where nothing came. Otherwise each part
    keeps its own sum, and ids of others become ghosts in the order they appear
    (``pos`` where given, else by id).
    """
    used = entries.filter("gid >= 1")
    zero = F.lit(0).cast(entries.schema["v"].dataType)
    if assemble:
        total = used.groupBy("gid").agg(COMBINE[combine]("v").alias("v"))
        layout = _layout(rows.remove_ghost())
        out = layout.join(total, "gid", "left").select("part", "lid", "gid", "owner", "own", F.coalesce("v", zero).alias("v"))
        return PVector(out, rows.remove_ghost())
    order = used if "pos" in used.columns else used.withColumn("pos", F.col("gid"))
    wide = rows.union_ghost(order.select("part", "gid", "pos"))
    total = used.groupBy("part", "gid").agg(COMBINE[combine]("v").alias("v"))
    out = _layout(wide).join(total, ["part", "gid"], "left").select("part", "lid", "gid", "owner", "own", F.coalesce("v", zero).alias("v"))
    return PVector(out, wide)


def local_entries(values: DataFrame, rows: PRange) -> DataFrame:
    """(part, gid, ...) from entries by local id (part, lid, ...); ids below 1 or unknown to the part are ignored."""
    return values.filter("lid >= 1").join(rows.index.select("part", "lid", "gid"), ["part", "lid"]).drop("lid")


def already_assembled(entries: DataFrame, rows: PRange, combine: str = "+") -> PVector:
    """From contributions of which each owner has all of its ids: those for ids of other parts are left out."""
    own = rows.find_owner(entries.filter("gid >= 1"), "gid", "__o").filter("part = __o").drop("__o")
    return pvector(own, rows, combine=combine)


def pvector_by_part(rows: PRange, f: Callable, kind: str = "double") -> PVector:
    """``f(part, gids)`` gives the values of a part's local ids, which come as a numpy array in local order.

    A part is handled in one task, as whatever a part's own function does.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("lid", ignore_index=True)
        return table.assign(v=f(int(table["part"].iloc[0]), table["gid"].to_numpy()))

    made = _layout(rows).groupBy("part").applyInPandas(run, f"part int, lid int, gid long, owner int, own boolean, v {kind}")
    return PVector(made, rows)


def refill_vector(plan: DataFrame, values: DataFrame, rows: PRange) -> PVector:
    """New values at planned places: ``plan`` (part, k, gid), ``values`` (part, k, v)."""
    return pvector(plan.join(values, ["part", "k"]).select("part", "gid", "v"), rows)


def subassembled(values: DataFrame, rows: PRange) -> PVector:
    """From (part, lid, v) on local ids that exist already, ghosts included."""
    zero = F.lit(0).cast(values.schema["v"].dataType)
    total = values.filter("lid >= 1").groupBy("part", "lid").agg(F.sum("v").alias("v"))
    out = _layout(rows).join(total, ["part", "lid"], "left").select("part", "lid", "gid", "owner", "own", F.coalesce("v", zero).alias("v"))
    return PVector(out, rows)


def from_gvec(values: DataFrame, rows: PRange) -> PVector:
    """From (gid, v), 0 where an id is missing."""
    own = rows.remove_ghost()
    out = _layout(own).join(values.select("gid", "v"), "gid", "left").select("part", "lid", "gid", "owner", "own", F.coalesce("v", F.lit(0.0)).alias("v"))
    return PVector(out, own)


def from_split_blocks(own: DataFrame, ghost: DataFrame, rows: PRange) -> PVector:
    """From (part, own_id, v) and (part, ghost_id, v)."""
    index = rows.index
    a = index.filter("own_id > 0").join(own, ["part", "own_id"]).select("part", "lid", "gid", "owner", F.lit(True).alias("own"), "v")
    b = index.filter("ghost_id > 0").join(ghost, ["part", "ghost_id"]).select("part", "lid", "gid", "owner", F.lit(False).alias("own"), "v")
    return PVector(a.unionAll(b), rows)
