"""Distributed sparse matrices as triplets, and their algebra as joins and aggregations.

``df`` of an assembled matrix is (gi, gj, v) with each position once. Before
assembly it is (part, gi, gj, v), a sum of what each part contributed. Products
join on the inner id and aggregate with map-side combination; Catalyst chooses
the join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.sizing import ROWS_PER_TASK, per_key, spread, total
from .prange import PRange, trivial_partition
from .vector import COMBINE, PVector, from_gvec, pvector, pzeros, refill_vector

#: Rows that a dense solve and entries that an array on the driver may have.
DENSE_ROWS, LOCAL_ENTRIES = 4_000, 5_000_000
#: Entries of a vector or matrix that is broadcast in a product.
BROADCAST_IDS = 500_000


def compress(coo: DataFrame, m: int | None = None, n: int | None = None, combine: str | Callable[[Column], Column] = "+", by: tuple[str, ...] = (), entries: int | None = None) -> DataFrame:
    """Triplets with each position once; ids below 1 or beyond the shape are dropped.

    ``entries`` is how many triplets there are at most, where that is known.
    ``combine`` is a name of COMBINE, "first" (by ``pos``) or any aggregation of a column.
    """
    used = coo.filter((F.col("gi") >= 1) & (F.col("gj") >= 1))
    if m is not None:
        used = used.filter((F.col("gi") <= m) & (F.col("gj") <= n))
    if combine == "first":
        value = F.min_by("v", "pos")
    else:
        value = combine(F.col("v")) if callable(combine) else COMBINE[combine]("v")
    return spread(used, entries, *by, "gi", "gj").groupBy(*by, "gi", "gj").agg(value.alias("v"))


def multiply(a: DataFrame, x: DataFrame, n: int | None = None) -> DataFrame:
    """(gid, v): rows of ``a`` times the vector (gid, v); rows without entries are missing.

    ``n`` is how many entries the vector has at most, where that is known: one of at
    most BROADCAST_IDS goes to the matrix, which then isn't shuffled by column.
    """
    right = x.select(F.col("gid").alias("gj"), F.col("v").alias("__x"))
    right = F.broadcast(right) if n is not None and n <= BROADCAST_IDS else right
    return a.join(right, "gj").groupBy(F.col("gi").alias("gid")).agg(F.sum(F.col("v") * F.col("__x")).alias("v"))


def multiply_all(a: DataFrame, b: DataFrame, sizes: tuple[int | None, int | None] = (None, None), shape: tuple[int, int, int] | None = None) -> DataFrame:
    """(gi, gj, v) of the partial products of two matrices.

    ``sizes`` are the entries that each has at most, ``shape`` the lengths of rows, inner ids and columns.
    """
    right = b.select(F.col("gi").alias("__k"), F.col("gj").alias("__j"), F.col("v").alias("__w"))
    left = a.select("gi", F.col("gj").alias("__k"), "v")
    return _products(_pairs(left, right, sizes, "__k", shape), "gi", "__j")


def _pairs(left: DataFrame, right: DataFrame, sizes: tuple[int | None, int | None], key: str, shape: tuple[int, int, int] | None) -> DataFrame:
    """A join over as many tasks as its entries or its partial products need, whichever are more.

    A task holds what it writes for the sums as well as what it reads. A side that is
    known to be small is broadcast; the other is then dealt out by whole entries.
    """
    if None in sizes:
        return left.join(right, key)
    products = 0 if shape is None else per_key(*sizes, shape[1])
    most, small = max(*sizes, products), sizes.index(min(sizes))
    if most > ROWS_PER_TASK and sizes[small] <= BROADCAST_IDS:
        large = left if small else right
        if products > max(sizes):
            large = spread(large, products, *large.columns)
        return large.join(F.broadcast(right), key) if small else F.broadcast(left).join(large, key)
    return spread(left, most, key).join(spread(right, most, key), key)


def _products(pairs: DataFrame, i: str, j: str) -> DataFrame:
    """(gi, gj, v), a row for every partial product."""
    return pairs.select(F.col(i).alias("gi"), F.col(j).alias("gj"), (F.col("v") * F.col("__w")).alias("v"))


def _summed(products: DataFrame, sizes: tuple[int | None, int | None], shape: tuple[int, int, int] | None) -> DataFrame:
    """Partial products added up: before the shuffle where the result is small, over tasks that follow their number where it isn't."""
    if shape is not None and shape[0] * shape[2] > ROWS_PER_TASK:
        products = spread(products, per_key(*sizes, shape[1]), "gi", "gj")
    return products.groupBy("gi", "gj").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("gj").alias("gi"), F.col("gi").alias("gj"), "v")


@dataclass(frozen=True)
class PSparseMatrix:
    df: DataFrame
    rows: PRange
    cols: PRange
    assembled: bool = True
    #: Contributions whose sum this is, where they are known: products with vectors need no assembly.
    raw: DataFrame | None = None
    #: How many entries there are at most (in products: about), where that is known.
    entries_bound: int | None = None
    #: In products: the partial products that add up to this and about how many there are, where that is known.
    partial: DataFrame | None = None
    partial_bound: int | None = None

    def __repr__(self) -> str:
        state = "" if self.assembled else " (not assembled)"
        return f"{self.rows.n}x{self.cols.n} sparse matrix partitioned into {self.rows.parts} parts{state}"

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows.n, self.cols.n

    def _of(self, df: DataFrame) -> PSparseMatrix:
        return replace(self, df=df, raw=None, partial=None, partial_bound=None)

    def cut(self) -> PSparseMatrix:
        return self._of(cut(self.df))

    # -- assembly and layout

    def assemble(self) -> PSparseMatrix:
        """Contributions summed at the owners of the rows."""
        if self.assembled:
            return self
        return PSparseMatrix(self.triplets(), self.rows.remove_ghost(), self.cols.remove_ghost(), entries_bound=self.entries_bound)

    def triplets(self) -> DataFrame:
        return self.df if self.assembled else compress(self.df, entries=self.entries_bound)

    def contributions(self) -> DataFrame:
        """(gi, gj, v), positions perhaps repeated: enough for what is linear in the entries."""
        return self.raw if self.raw is not None else self.df

    def with_owners(self) -> DataFrame:
        """(part, gi, gj, v, row_owner, col_owner); the part of an assembled entry owns its row."""
        found = self.rows.find_owner(self.df, "gi", "row_owner")
        found = self.cols.find_owner(found, "gj", "col_owner")
        return found if "part" in found.columns else found.withColumn("part", F.col("row_owner"))

    def block(self, rows: str, cols: str) -> DataFrame:
        """own or ghost rows by own or ghost columns."""
        row = (F.col("row_owner") == F.col("part")) if rows == "own" else (F.col("row_owner") != F.col("part"))
        col = (F.col("col_owner") == F.col("part")) if cols == "own" else (F.col("col_owner") != F.col("part"))
        return self.with_owners().filter(row & col)

    def own_own_values(self) -> DataFrame:
        return self.block("own", "own")

    def own_ghost_values(self) -> DataFrame:
        return self.block("own", "ghost")

    def ghost_own_values(self) -> DataFrame:
        return self.block("ghost", "own")

    def ghost_ghost_values(self) -> DataFrame:
        return self.block("ghost", "ghost")

    def local_values(self) -> DataFrame:
        return self.with_owners().select("part", "gi", "gj", "v")

    def consistent(self, rows: PRange) -> DataFrame:
        """(part, gi, gj, v): own rows and copies of the ghost rows of ``rows``."""
        if not self.assembled:
            raise ValueError("only an assembled matrix has rows to replicate")
        return rows.index.select("part", F.col("gid").alias("gi")).join(self.df, "gi").select("part", "gi", "gj", "v")

    def repartition(self, rows: PRange, cols: PRange) -> PSparseMatrix:
        """The same entries under other owners."""
        if not self.assembled:
            raise ValueError("assemble before repartitioning")
        self.rows.check_like(rows, "rows", parts=False)
        self.cols.check_like(cols, "columns", parts=False)
        return PSparseMatrix(self.df, rows, cols, entries_bound=self.entries_bound)

    def repartition_system(self, b: PVector, rows: PRange, cols: PRange) -> tuple[PSparseMatrix, PVector]:
        """Matrix and right-hand side under other owners."""
        return self.repartition(rows, cols), b.repartition(rows)

    def renumber(self, rows: PRange | None = None, cols: PRange | None = None) -> PSparseMatrix:
        """Under contiguous ids; ``rows`` and ``cols`` are renumbered layouts that are there already."""
        i, j = self.rows.new_ids(), self.cols.new_ids()
        moved = self.df.join(i.select(F.col("gid").alias("gi"), F.col("new_gid").alias("__i")), "gi").join(j.select(F.col("gid").alias("gj"), F.col("new_gid").alias("__j")), "gj")
        extra = [] if self.assembled else ["part"]
        return PSparseMatrix(moved.select(*extra, F.col("__i").alias("gi"), F.col("__j").alias("gj"), "v"), rows or self.rows.renumber(), cols or self.cols.renumber(), self.assembled)

    def submatrix(self, rows: DataFrame, cols: DataFrame) -> DataFrame:
        """Entries whose ids are in (gid) and (gid)."""
        return self.df.join(rows.select(F.col("gid").alias("gi")), "gi", "left_semi").join(cols.select(F.col("gid").alias("gj")), "gj", "left_semi")

    def nnz(self) -> int:
        return self.df.count()

    def nonzeros(self, order: str = "row") -> DataFrame:
        """Entries with their place k in row-major or column-major order within each row or column."""
        a, b = ("gi", "gj") if order == "row" else ("gj", "gi")
        return self.triplets().withColumn("k", F.row_number().over(Window.partitionBy(a).orderBy(b)).cast("long"))

    def nzindex(self, wanted: DataFrame, order: str = "row") -> DataFrame:
        """(gi, gj, k): the place of each wanted position among its row's (or column's) entries; 0 where nothing is stored."""
        found = self.nonzeros(order).select("gi", "gj", "k")
        return wanted.join(found, ["gi", "gj"], "left").select("gi", "gj", F.coalesce("k", F.lit(0)).alias("k"))

    def zeros(self) -> PVector:
        """A vector of zeros that this can be multiplied with."""
        return pzeros(self.cols.remove_ghost())

    def centralize(self, destination: int = 1) -> PSparseMatrix:
        """The whole matrix as rows and columns of one part, still a table of any size; see ``entries`` for arrays."""
        spark = self.df.sparkSession
        rows, cols = (trivial_partition(spark, r.parts, r.n, destination) for r in (self.rows, self.cols))
        return self.assemble().repartition(rows, cols)

    def entries(self) -> np.ndarray:
        """(gi, gj, v) of all entries as an array on the driver; an error beyond LOCAL_ENTRIES."""
        table = self.triplets().select(*(F.col(c).cast("double").alias(c) for c in ("gi", "gj", "v"))).limit(LOCAL_ENTRIES + 1).toArrow()
        if table.num_rows > LOCAL_ENTRIES:
            raise ValueError("too many entries for one machine")
        return np.column_stack([c.to_numpy() for c in table.columns])

    def dense(self) -> np.ndarray:
        if max(self.shape) > DENSE_ROWS:
            raise ValueError(f"more than {DENSE_ROWS} rows")
        out = np.zeros(self.shape)
        i, j, v = self.entries().T
        np.add.at(out, (i.astype(int) - 1, j.astype(int) - 1), v)
        return out

    # -- values

    def map(self, f) -> PSparseMatrix:
        return self._of(self.df.withColumn("v", f(F.col("v"))))

    def fill_stored(self, a: float) -> PSparseMatrix:
        return self.map(lambda _: F.lit(float(a)))

    def _linear(self, f) -> PSparseMatrix:
        """``map`` by something linear, which contributions stand as well."""
        return replace(self.map(f), raw=None if self.raw is None else self.raw.withColumn("v", f(F.col("v"))))

    def __mul__(self, a: float) -> PSparseMatrix:
        return self._linear(lambda v: v * F.lit(a))

    __rmul__ = __mul__

    def __neg__(self) -> PSparseMatrix:
        return self._linear(lambda v: -v)

    def __pos__(self) -> PSparseMatrix:
        return self

    def __add__(self, other: PSparseMatrix) -> PSparseMatrix:
        self.rows.check_like(other.rows, "rows")
        self.cols.check_like(other.cols, "columns")
        both = self.triplets().unionByName(other.triplets())
        most = total(self.entries_bound, other.entries_bound)
        return PSparseMatrix(compress(both, entries=most), self.rows, self.cols, entries_bound=most)

    def __sub__(self, other: PSparseMatrix) -> PSparseMatrix:
        return self + -other

    def identity_minus(self) -> PSparseMatrix:
        eye = self.rows.own().select(F.col("gid").alias("gi"), F.col("gid").alias("gj"), F.lit(1.0).alias("v"))
        most = total(self.entries_bound, self.rows.n)
        return PSparseMatrix(compress(eye.unionByName((-self).triplets().select("gi", "gj", "v")), entries=most), self.rows, self.cols, entries_bound=most)

    @property
    def T(self) -> PSparseMatrix:  # noqa: N802
        return PSparseMatrix(transpose(self.triplets()), self.cols, self.rows, raw=None if self.raw is None else transpose(self.raw), entries_bound=self.entries_bound)

    # -- products

    def __matmul__(self, other):
        if self.cols.n != other.rows.n:
            raise ValueError(f"product: {self.cols.n} columns and {other.rows.n} rows")
        if isinstance(other, PVector):
            return from_gvec(multiply(self.contributions(), other.gvec(), other.rows.n), self.rows)
        (left, m), (right, n) = (self.triplets(), self.entries_bound), (other.triplets(), other.entries_bound)
        # One sum for a chain of products: what is broadcast and makes no more of them takes partial products as they are.
        if self.partial is not None and other._few(self.cols.n):
            left, m = self.partial, self.partial_bound
        elif other.partial is not None and self._few(self.cols.n):
            right, n = other.partial, other.partial_bound
        shape = (self.rows.n, self.cols.n, other.cols.n)
        return _product(multiply_all(left, right, (m, n), shape), (m, n), shape, self.rows, other.cols)

    def _few(self, keys: int) -> bool:
        """Whether this is small enough to be broadcast and has not more than an entry for each inner id on average."""
        return self.entries_bound is not None and self.entries_bound <= min(keys, BROADCAST_IDS)

    def mul(self, x: PVector, alpha: float = 1.0, beta: float = 0.0, c: PVector | None = None) -> PVector:
        """alpha A x + beta c."""
        product = (self @ x) * alpha
        return product if c is None or not beta else product + c * beta

    def spmtm(self, other: PSparseMatrix) -> PSparseMatrix:
        """Transposed self times other, joined on the rows without transposing.

        A row of k entries makes k times k partial products before they are summed.
        """
        if self.rows.n != other.rows.n:
            raise ValueError(f"product: {self.rows.n} and {other.rows.n} rows")
        sizes, shape = (self.entries_bound, other.entries_bound), (self.cols.n, self.rows.n, other.cols.n)
        right = other.triplets().select("gi", F.col("gj").alias("__j"), F.col("v").alias("__w"))
        left = self.triplets().select("gi", F.col("gj").alias("__i"), "v")
        return _product(_products(_pairs(left, right, sizes, "gi", shape), "__i", "__j"), sizes, shape, self.cols, other.cols)

    def diag(self) -> PVector:
        """The dense diagonal, 0 where nothing is stored."""
        # Not "gi = gj": a product would take that as a key of its join, which then isn't dealt out as planned.
        return from_gvec(self.triplets().filter("gi - gj = 0").select(F.col("gi").alias("gid"), "v"), self.rows)

    def scale_rows(self, d: PVector) -> PSparseMatrix:
        """diag(d) A."""
        if self.rows.n != d.rows.n:
            raise ValueError(f"{self.rows.n} rows and {d.rows.n} factors")
        joined = self.triplets().join(d.gvec().select(F.col("gid").alias("gi"), F.col("v").alias("__d")), "gi")
        return PSparseMatrix(joined.select("gi", "gj", (F.col("v") * F.col("__d")).alias("v")), self.rows, self.cols)

    def solve(self, b: PVector) -> PVector:
        """A dense direct solve on the driver, for small systems only."""
        x = np.linalg.solve(self.dense(), np.array(b.collect(), float))
        table = self.df.sparkSession.createDataFrame([(k + 1, float(v)) for k, v in enumerate(x)], "gid long, v double")
        return from_gvec(table, self.cols)


def _product(partial: DataFrame, sizes: tuple[int | None, int | None], shape: tuple[int, int, int], rows: PRange, cols: PRange) -> PSparseMatrix:
    """The sum of partial products; it has not more entries than positions or about as many as these."""
    most, df = per_key(*sizes, shape[1]), _summed(partial, sizes, shape)
    if most is None:
        return PSparseMatrix(df, rows, cols)
    return PSparseMatrix(df, rows, cols, entries_bound=min(most, shape[0] * shape[2]), partial=partial, partial_bound=most)


def rap(r: PSparseMatrix, a: PSparseMatrix, p: PSparseMatrix) -> PSparseMatrix:
    """R A P, from left to right; in one sum where A is a product and R and P have about an entry for each of its ids."""
    return r @ a @ p


def sparse_diag_matrix(d: PVector) -> PSparseMatrix:
    return PSparseMatrix(d.gvec().select(F.col("gid").alias("gi"), F.col("gid").alias("gj"), "v"), d.rows, d.rows, entries_bound=d.rows.n)


def psparse(coo: DataFrame, rows: PRange, cols: PRange, assemble: bool = True, combine: str = "+", drop_offpart: bool = False, indices: str = "global", assembled: bool = False, entries: int | None = None) -> PSparseMatrix:
    """From triplets (part, gi, gj, v) of any part for any position.

    ``assemble=False`` sums within each part only. ``drop_offpart`` keeps only
    entries whose column the row's owner also owns. With ``indices="local"`` the
    ids are the part's local ones. ``assembled`` says that each owner has all of its
    rows already: entries for rows of other parts are left out. ``entries`` is how
    many triplets there are at most, where that is known; large sums then take as many
    tasks as they need.
    """
    if indices == "local":
        coo = local_triplets(coo, rows, cols)
    if assembled:
        coo = rows.find_owner(coo.filter("gi >= 1"), "gi", "__r").filter("part = __r").drop("__r")
    if drop_offpart:
        coo = cols.find_owner(rows.find_owner(coo, "gi", "__r"), "gj", "__c").filter("__r = __c").drop("__r", "__c")
    if assemble or assembled:
        raw = coo.filter((F.col("gi") >= 1) & (F.col("gj") >= 1)).select("gi", "gj", "v") if combine == "+" else None
        return PSparseMatrix(compress(coo, combine=combine, entries=entries), rows, cols, raw=raw, entries_bound=entries)
    return PSparseMatrix(compress(coo, combine=combine, by=("part",), entries=entries), rows, cols, assembled=False, entries_bound=entries)


def local_triplets(coo: DataFrame, rows: PRange, cols: PRange) -> DataFrame:
    """(part, gi, gj, v) from triplets by local id; ids below 1 or unknown to the part are ignored."""
    i = rows.index.select("part", F.col("lid").alias("gi"), F.col("gid").alias("__i"))
    j = cols.index.select("part", F.col("lid").alias("gj"), F.col("gid").alias("__j"))
    found = coo.join(i, ["part", "gi"]).join(j, ["part", "gj"])
    return found.drop("gi", "gj").withColumnRenamed("__i", "gi").withColumnRenamed("__j", "gj")


def psparse_by_part(rows: PRange, cols: PRange, f: Callable, assemble: bool = True) -> PSparseMatrix:
    """``f(part, row gids)`` gives the triplets (gi, gj, v) of a part as a table or three arrays.

    The ids come as a numpy array in local order. A part is handled in one task.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        part = int(table["part"].iloc[0])
        made = f(part, table.sort_values("lid")["gid"].to_numpy())
        if not isinstance(made, pd.DataFrame):
            made = pd.DataFrame(dict(zip(("gi", "gj", "v"), made, strict=True)))
        return made[["gi", "gj", "v"]].assign(part=part)

    coo = rows.index.select("part", "lid", "gid").groupBy("part").applyInPandas(run, "part int, gi long, gj long, v double")
    return psparse(coo, rows, cols, assemble=assemble)


def psparse_from_split_blocks(blocks: list[DataFrame], rows: PRange, cols: PRange, assembled: bool = True) -> PSparseMatrix:
    """From own-own, own-ghost[, ghost-own, ghost-ghost] blocks of (part, gi, gj, v)."""
    both = blocks[0].select("part", "gi", "gj", "v")
    for b in blocks[1:]:
        both = both.unionByName(b.select("part", "gi", "gj", "v"))
    return PSparseMatrix(both.drop("part"), rows, cols) if assembled else PSparseMatrix(both, rows, cols, assembled=False)


def psystem(coo: DataFrame, entries: DataFrame, rows: PRange, cols: PRange) -> tuple[PSparseMatrix, PVector]:
    """Matrix and right-hand side."""
    return psparse(coo, rows, cols), pvector(entries, rows)


def refill_system(plan: DataFrame, values: DataFrame, vector_plan: DataFrame, vector_values: DataFrame, rows: PRange, cols: PRange) -> tuple[PSparseMatrix, PVector]:
    """A system with new values at planned positions (see ``refill`` and ``refill_vector``)."""
    return PSparseMatrix(refill(plan, values), rows, cols), refill_vector(vector_plan, vector_values, rows)


def refill(plan: DataFrame, values: DataFrame) -> DataFrame:
    """New values at planned positions: ``plan`` (part, k, gi, gj), ``values`` (part, k, v)."""
    return compress(plan.join(values, ["part", "k"]))

