"""Block vectors and matrices: the tables of their blocks with block_i and block_j."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from ..plans.sizing import ROWS_PER_TASK, spread, total
from .matrix import BROADCAST_IDS, PSparseMatrix
from .prange import PRange
from .vector import COMBINE, NEUTRAL, PVector, from_gvec, norm_of


@dataclass(frozen=True)
class BRange:
    """Ranges one after another."""

    blocks: list[PRange]

    def __len__(self) -> int:
        return sum(b.n for b in self.blocks)

    def lasts(self) -> list[int]:
        return list(accumulate(b.n for b in self.blocks))

    def find_block(self, gid: int) -> int:
        """The block (from 1) of a position."""
        return next(k for k, last in enumerate(self.lasts(), 1) if gid <= last)


def _check(a: BRange, b: BRange, what: str) -> None:
    if [x.n for x in a.blocks] != [x.n for x in b.blocks]:
        raise ValueError(f"{what}: blocks of {[x.n for x in a.blocks]} and {[x.n for x in b.blocks]}")


@dataclass(frozen=True)
class BVector:
    """``df`` is (block_i, gid, v), own entries; ``parts`` are the blocks it was made of, with their ghosts."""

    df: DataFrame
    axis: BRange
    parts: tuple[PVector, ...] = ()

    @staticmethod
    def of(blocks: list[PVector]) -> BVector:
        each = [b.gvec().select(F.lit(k).alias("block_i"), "gid", "v") for k, b in enumerate(blocks, 1)]
        return BVector(reduce(DataFrame.unionByName, each), BRange([b.rows for b in blocks]), tuple(blocks))

    def _each(self, f: Callable[[PVector], PVector]) -> BVector:
        return BVector.of([f(b) for b in (self.parts or [self.block(k + 1) for k in range(len(self.axis.blocks))])])

    def consistent(self, rows: BRange | None = None) -> BVector:
        """Ghosts of every block (of new layouts if given) get their owners' values."""
        blocks = self.parts or tuple(self.block(k + 1) for k in range(len(self.axis.blocks)))
        return BVector.of([b.consistent(None if rows is None else rows.blocks[k]) for k, b in enumerate(blocks)])

    def assemble(self, op: str = "+") -> BVector:
        """Ghost values of every block are combined into their owners; ghosts then are 0."""
        return self._each(lambda b: b.assemble(op))

    def _local(self, values: Callable[[PVector], DataFrame]) -> DataFrame:
        blocks = self.parts or tuple(self.block(k + 1) for k in range(len(self.axis.blocks)))
        return reduce(DataFrame.unionByName, [values(b).select(F.lit(k).alias("block_i"), "part", "gid", "v") for k, b in enumerate(blocks, 1)])

    def own_values(self) -> DataFrame:
        """(block_i, part, gid, v)."""
        return self._local(PVector.own_values)

    def ghost_values(self) -> DataFrame:
        return self._local(PVector.ghost_values)

    def __len__(self) -> int:
        return len(self.axis)

    def block(self, k: int) -> PVector:
        return from_gvec(self.df.filter(F.col("block_i") == k), self.axis.blocks[k - 1])

    def collect(self) -> list:
        return [r[0] for r in self.df.orderBy("block_i", "gid").select("v").collect()]

    def map(self, f: Callable[[Column], Column]) -> BVector:
        return BVector(self.df.withColumn("v", f(F.col("v"))), self.axis)

    def zip(self, other: BVector, f: Callable[[Column, Column], Column]) -> BVector:
        joined = self._joined(other)
        return BVector(joined.select("block_i", "gid", f(F.col("v"), F.col("w")).alias("v")), self.axis)

    def _joined(self, other: BVector) -> DataFrame:
        _check(self.axis, other.axis, "block vectors")
        return self.df.join(other.df.withColumnRenamed("v", "w"), ["block_i", "gid"])

    def __add__(self, other: BVector) -> BVector:
        return self.zip(other, lambda a, b: a + b)

    def __sub__(self, other: BVector) -> BVector:
        return self.zip(other, lambda a, b: a - b)

    def __mul__(self, a: float) -> BVector:
        return self.map(lambda v: v * F.lit(a))

    __rmul__ = __mul__

    def reduce(self, op: str = "+"):
        return self.df.agg(F.coalesce(COMBINE[op]("v"), F.lit(NEUTRAL[op]))).first()[0]

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

    def fill(self, a) -> BVector:
        return self.map(lambda _: F.lit(a))

    def equals(self, other: BVector) -> bool:
        """Whether blocks and own values are the same."""
        if [x.n for x in self.axis.blocks] != [x.n for x in other.axis.blocks]:
            return False
        joined = self.df.join(other.df.withColumnRenamed("v", "w"), ["block_i", "gid"], "full_outer")
        return joined.filter("not (v <=> w)").isEmpty()

    def dot(self, other: BVector) -> float:
        return self._joined(other).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0))).first()[0]

    def norm(self, p: float = 2) -> float:
        return self.df.agg(norm_of(F.col("v"), p)).first()[0] or 0.0

    def distance(self, other: BVector, metric: str) -> float:
        return self._joined(other).agg(METRICS[metric](F.col("v"), F.col("w"))).first()[0]


@dataclass(frozen=True)
class BMatrix:
    """``df`` is (block_i, block_j, gi, gj, v)."""

    df: DataFrame
    rows: BRange
    cols: BRange
    #: Contributions whose sum this is, where they are known: products need no assembly.
    raw: DataFrame | None = None
    #: How many entries (and contributions) there are at most, where that is known.
    entries_bound: int | None = None

    @staticmethod
    def of(blocks: list[list[PSparseMatrix]]) -> BMatrix:
        def table(values: Callable[[PSparseMatrix], DataFrame]) -> DataFrame:
            each = [values(m).select(F.lit(i).alias("block_i"), F.lit(j).alias("block_j"), "gi", "gj", "v") for i, row in enumerate(blocks, 1) for j, m in enumerate(row, 1)]
            return reduce(DataFrame.unionByName, each)

        most = total(*(m.entries_bound for row in blocks for m in row))
        return BMatrix(table(PSparseMatrix.triplets), BRange([r[0].rows for r in blocks]), BRange([m.cols for m in blocks[0]]), table(PSparseMatrix.contributions), most)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.cols)

    def block(self, i: int, j: int) -> PSparseMatrix:
        own = self.df.filter((F.col("block_i") == i) & (F.col("block_j") == j)).select("gi", "gj", "v")
        return PSparseMatrix(own, self.rows.blocks[i - 1], self.cols.blocks[j - 1], entries_bound=self.entries_bound)

    def nnz(self) -> int:
        return self.df.count()

    def map(self, f: Callable[[Column], Column]) -> BMatrix:
        return BMatrix(self.df.withColumn("v", f(F.col("v"))), self.rows, self.cols, entries_bound=self.entries_bound)

    def fill_stored(self, a: float) -> BMatrix:
        return self.map(lambda _: F.lit(float(a)))

    def mul(self, x: BVector, alpha: float = 1.0, beta: float = 0.0, c: BVector | None = None) -> BVector:
        """alpha A x + beta c."""
        product = (self @ x) * alpha
        return product if c is None or not beta else product + c * beta

    def __matmul__(self, x: BVector) -> BVector:
        _check(self.cols, x.axis, "block product")
        layout = reduce(DataFrame.unionByName, [r.own().select(F.lit(k).alias("block_i"), "gid", F.lit(0.0).alias("v")) for k, r in enumerate(self.rows.blocks, 1)])
        found = block_multiply(self.raw if self.raw is not None else self.df, x.df, len(x), self.entries_bound, len(self.rows), layout)
        return BVector(found, self.rows)


def block_multiply(a: DataFrame, x: DataFrame, n: int | None = None, entries: int | None = None, rows: int | None = None, layout: DataFrame | None = None) -> DataFrame:
    """(block_i, gid, v): one join on block and id, one aggregation.

    ``n``, ``entries`` and ``rows`` are how many entries the vector and the matrix
    and how many rows the result have at most, where that is known. ``layout``
    (block_i, gid, v of 0) has rows to be there without entries too.
    """
    right = x.select(F.col("block_i").alias("block_j"), F.col("gid").alias("gj"), F.col("v").alias("__x"))
    if n is not None and n <= BROADCAST_IDS:
        joined = a.join(F.broadcast(right), ["block_j", "gj"])
    else:
        most = None if n is None or entries is None else max(n, entries)
        joined = spread(a, most, "block_j", "gj").join(spread(right, most, "block_j", "gj"), ["block_j", "gj"])
    products = joined.select("block_i", F.col("gi").alias("gid"), (F.col("v") * F.col("__x")).alias("v"))
    if layout is not None:
        products = products.unionByName(layout)
    if rows is None or rows > ROWS_PER_TASK:
        products = spread(products, entries if layout is None else total(entries, rows), "block_i", "gid")
    return products.groupBy("block_i", "gid").agg(F.sum("v").alias("v"))
