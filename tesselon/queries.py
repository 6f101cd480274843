"""Registered queries over the driver's tables, each with the SQL that says the same.

The running example is the matrix A of orders by suppliers: a triplet for every
line item, its part the line number. Keys begin at 0 and become ids by adding 1.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import jagged
from .functions.ids import coordinates
from .functions.metrics import METRICS
from .operators import collectives as co
from .operators import distributed, solvers
from .operators.blocks import block_multiply
from .operators.matrix import PSparseMatrix, compress, multiply, psparse, psystem, rap, refill, sparse_diag_matrix
from .operators.prange import PRange, expand, from_local, node_to_dof_partition, partition_from_color, parts_table, trivial_partition, uniform_partition, variable_partition
from .operators.vector import PVector, from_gvec, pfill, pvector, subassembled
from .sources import gallery, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PARTS = 4


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def triplets(spark: SparkSession, sf: str) -> DataFrame:
    """(part, gi, gj, v) of line items."""
    return tables.coo(read(spark, sf, "lineitem"), F.col("l_orderkey") + 1, F.col("l_suppkey") + 1, F.col("l_quantity"), F.col("l_linenumber"))


def orders(spark: SparkSession, sf: str) -> PRange:
    return uniform_partition(spark, PARTS, read(spark, sf, "orders").count())


def suppliers(spark: SparkSession, sf: str) -> PRange:
    return uniform_partition(spark, PARTS, read(spark, sf, "supplier").count())


def matrix(spark: SparkSession, sf: str) -> PSparseMatrix:
    return psparse(triplets(spark, sf), orders(spark, sf), suppliers(spark, sf), entries=read(spark, sf, "lineitem").count())


def balances(spark: SparkSession, sf: str) -> PVector:
    """Whole account balances of suppliers."""
    return from_gvec(tables.gvec(read(spark, sf, "supplier"), F.col("s_suppkey") + 1, F.floor("s_acctbal").cast("double")), suppliers(spark, sf))


COO = "SELECT l_linenumber AS part, l_orderkey + 1 AS gi, l_suppkey + 1 AS gj, l_quantity AS v FROM lineitem"
MAT = f"SELECT gi, gj, sum(v) AS v FROM ({COO}) GROUP BY gi, gj"
X = "SELECT s_suppkey + 1 AS gid, CAST(floor(s_acctbal) AS DOUBLE) AS v FROM supplier"
ATA = f"SELECT a.gj AS gi, b.gj AS gj, sum(a.v * b.v) AS v FROM ({MAT}) a JOIN ({MAT}) b ON a.gi = b.gi GROUP BY 1, 2"


def own_part(gid: str, n: str, parts: int = PARTS) -> str:
    """The owner of an id under a uniform partition, in SQL."""
    q, r = f"(({n}) // {parts})", f"(({n}) % {parts})"
    small = f"(({parts} - {r}) * {q})"
    return f"(CASE WHEN {gid} <= {small} THEN ({gid} - 1) // {q} ELSE ({parts} - {r}) + ({gid} - {small} - 1) // ({q} + 1) END + 1)"


ORDERS, SUPPLIERS, CUSTOMERS = ("(SELECT count(*) FROM orders)", "(SELECT count(*) FROM supplier)", "(SELECT count(*) FROM customer)")

# -- assembly


@query("coo_assemble", MAT)
def coo_assemble(spark, sf):
    return matrix(spark, sf).df


@query("coo_assemble_by_part", f"SELECT CAST(part AS INTEGER) AS part, gi, gj, sum(v) AS v FROM ({COO}) GROUP BY 1, 2, 3")
def coo_assemble_by_part(spark, sf):
    return psparse(triplets(spark, sf), orders(spark, sf), suppliers(spark, sf), assemble=False, entries=read(spark, sf, "lineitem").count()).df


for _op, _sql in (("max", "max(v)"), ("min", "min(v)"), ("*", "product(v)")):

    @query(f"coo_combine_{'product' if _op == '*' else _op}", f"SELECT gi, gj, {_sql} AS v FROM ({COO}) GROUP BY gi, gj")
    def coo_combine(spark, sf, op=_op):
        return compress(triplets(spark, sf), combine=op)


@query("coo_combine_first", f"SELECT gi, gj, arg_min(v, part * 1000 + v) AS v FROM ({COO}) GROUP BY gi, gj")
def coo_combine_first(spark, sf):
    return compress(triplets(spark, sf).withColumn("pos", F.col("part") * 1000 + F.col("v")), combine="first")


@query("coo_drop_ids_lt1", "SELECT l_orderkey AS gi, l_suppkey AS gj, sum(l_quantity) AS v FROM lineitem WHERE l_orderkey >= 1 AND l_suppkey >= 1 GROUP BY 1, 2")
def coo_drop_ids_lt1(spark, sf):
    raw = tables.coo(read(spark, sf, "lineitem"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_quantity"))
    return compress(raw)


@query("coo_within_shape", f"SELECT gi, gj, sum(v) AS v FROM ({COO}) WHERE gi <= {ORDERS} // 2 AND gj <= {SUPPLIERS} // 2 GROUP BY gi, gj")
def coo_within_shape(spark, sf):
    m, n = read(spark, sf, "orders").count(), read(spark, sf, "supplier").count()
    return compress(triplets(spark, sf), m // 2, n // 2)


@query("psparse_assemble_later", MAT)
def psparse_assemble_later(spark, sf):
    return psparse(triplets(spark, sf), orders(spark, sf), suppliers(spark, sf), assemble=False, entries=read(spark, sf, "lineitem").count()).assemble().df


@query("psparse_refill", f"SELECT gi, gj, 2 * v AS v FROM ({MAT})")
def psparse_refill(spark, sf):
    li = read(spark, sf, "lineitem")
    key = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_shipdate")]
    rows = li.groupBy(F.xxhash64(*key).alias("k"), F.col("l_linenumber").alias("part"), (F.col("l_orderkey") + 1).alias("gi"), (F.col("l_suppkey") + 1).alias("gj")).agg(F.sum("l_quantity").alias("v"))
    return refill(rows.select("part", "k", "gi", "gj"), rows.select("part", "k", (F.col("v") * 2).alias("v")))


@query("psystem", f"SELECT a.gi AS gid, a.v AS row_sum, b.v AS rhs FROM (SELECT gi, sum(v) AS v FROM ({COO}) GROUP BY gi) a JOIN (SELECT l_orderkey + 1 AS gi, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY 1) b USING (gi)")
def q_psystem(spark, sf):
    entries = read(spark, sf, "lineitem").select(F.lit(1).alias("part"), (F.col("l_orderkey") + 1).alias("gid"), F.col("l_linenumber").cast("double").alias("v"))
    a, b = psystem(triplets(spark, sf), entries, orders(spark, sf), suppliers(spark, sf))
    sums = a.df.groupBy(F.col("gi").alias("gid")).agg(F.sum("v").alias("row_sum"))
    return sums.join(b.gvec().withColumnRenamed("v", "rhs"), "gid")


@query("mat_nnz", f"SELECT count(*) AS nnz FROM ({MAT})")
def mat_nnz(spark, sf):
    return matrix(spark, sf).df.agg(F.count("*").alias("nnz"))


@query("mat_rownnz", f"SELECT gi, count(*) AS nnz, sum(v) AS v FROM ({MAT}) GROUP BY gi")
def mat_rownnz(spark, sf):
    return matrix(spark, sf).df.groupBy("gi").agg(F.count("*").alias("nnz"), F.sum("v").alias("v"))


for _order, _a, _b in (("row", "gi", "gj"), ("col", "gj", "gi")):

    @query(f"nziterator_{_order}", f"SELECT gi, gj, v, row_number() OVER (PARTITION BY {_a} ORDER BY {_b}) AS k FROM ({MAT})")
    def nziterator(spark, sf, order=_order):
        return matrix(spark, sf).nonzeros(order)


# -- products


@query("spmv", f"SELECT gi AS gid, sum(a.v * x.v) AS v FROM ({MAT}) a JOIN ({X}) x ON a.gj = x.gid GROUP BY gi")
def spmv(spark, sf):
    return multiply(matrix(spark, sf).contributions(), balances(spark, sf).gvec())


DENSE = f"SELECT o_orderkey + 1 AS gid, coalesce(y.v, 0) AS v FROM orders LEFT JOIN ({SQL['spmv']}) y ON y.gid = o_orderkey + 1"


@query("spmv_dense_rows", DENSE)
def spmv_dense_rows(spark, sf):
    return (matrix(spark, sf) @ balances(spark, sf)).gvec()


@query("spmv_alpha_beta", f"SELECT gid, 2 * v + 3 * (gid % 7) AS v FROM ({DENSE})")
def spmv_alpha_beta(spark, sf):
    a = matrix(spark, sf)
    c = PVector(pfill(0.0, a.rows).df.withColumn("v", (F.col("gid") % 7).cast("double")), a.rows)
    return a.mul(balances(spark, sf), 2.0, 3.0, c).gvec()


@query("spmv_transpose", f"SELECT s_suppkey + 1 AS gid, coalesce(y.v, 0) AS v FROM supplier LEFT JOIN (SELECT gj, sum(v * (gi % 5)) AS v FROM ({MAT}) GROUP BY gj) y ON y.gj = s_suppkey + 1")
def spmv_transpose(spark, sf):
    a = matrix(spark, sf)
    x = PVector(pfill(0.0, a.rows).df.withColumn("v", (F.col("gid") % 5).cast("double")), a.rows)
    return (a.T @ x).gvec()


def by_nation(spark, sf) -> PSparseMatrix:
    """Ones from suppliers to their nations."""
    p = tables.coo(read(spark, sf, "supplier"), F.col("s_suppkey") + 1, F.col("s_nationkey") + 1, F.lit(1.0))
    rows = suppliers(spark, sf)
    return psparse(p, rows, uniform_partition(spark, PARTS, read(spark, sf, "nation").count()), entries=rows.n)


@query("spmm", f"SELECT gi, CAST(s_nationkey + 1 AS BIGINT) AS gj, sum(v) AS v FROM ({MAT}) JOIN supplier ON s_suppkey + 1 = gj GROUP BY 1, 2")
def spmm(spark, sf):
    return (matrix(spark, sf) @ by_nation(spark, sf)).df.select("gi", F.col("gj").cast("long").alias("gj"), "v")


def ata(spark, sf) -> PSparseMatrix:
    a = matrix(spark, sf)
    return a.spmtm(a)


@query("spmtm", ATA)
def spmtm(spark, sf):
    return ata(spark, sf).df


@query("rap", f"SELECT CAST(p.s_nationkey + 1 AS BIGINT) AS gi, CAST(q.s_nationkey + 1 AS BIGINT) AS gj, sum(v) AS v FROM ({ATA}) JOIN supplier p ON p.s_suppkey + 1 = gi JOIN supplier q ON q.s_suppkey + 1 = gj GROUP BY 1, 2")
def q_rap(spark, sf):
    p = by_nation(spark, sf)
    return rap(p.T, ata(spark, sf), p).df.select(F.col("gi").cast("long").alias("gi"), F.col("gj").cast("long").alias("gj"), "v")


RETURNED = "SELECT l_orderkey + 1 AS gi, l_suppkey + 1 AS gj, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"


def returned(spark, sf) -> PSparseMatrix:
    rows = read(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    coo = tables.coo(rows, F.col("l_orderkey") + 1, F.col("l_suppkey") + 1, F.col("l_quantity"))
    return psparse(coo, orders(spark, sf), suppliers(spark, sf))


for _name, _sign in (("add", 1), ("sub", -1)):

    @query(f"mat_{_name}", f"SELECT gi, gj, sum(v) AS v FROM ({MAT} UNION ALL SELECT gi, gj, {_sign} * v AS v FROM ({RETURNED})) GROUP BY gi, gj")
    def mat_add(spark, sf, sign=_sign):
        a, b = matrix(spark, sf), returned(spark, sf)
        return (a + b if sign > 0 else a - b).df


@query("mat_scale", f"SELECT gi, gj, 3 * v AS v FROM ({MAT})")
def mat_scale(spark, sf):
    return (3.0 * matrix(spark, sf)).df


@query("mat_neg", f"SELECT gi, gj, -v AS v FROM ({MAT})")
def mat_neg(spark, sf):
    return (-matrix(spark, sf)).df


@query("mat_fill_stored", f"SELECT gi, gj, 1.0::DOUBLE AS v FROM ({MAT})")
def mat_fill_stored(spark, sf):
    return matrix(spark, sf).fill_stored(1.0).df


@query("identity_minus", f"SELECT gi, gj, sum(v) AS v FROM (SELECT s_suppkey + 1 AS gi, s_suppkey + 1 AS gj, 1.0::DOUBLE AS v FROM supplier UNION ALL SELECT gi, gj, -v FROM ({ATA})) GROUP BY gi, gj")
def identity_minus(spark, sf):
    return ata(spark, sf).identity_minus().df


DIAG = f"SELECT s_suppkey + 1 AS gid, coalesce(d.v, 0) AS v FROM supplier LEFT JOIN (SELECT gi, v FROM ({ATA}) WHERE gi = gj) d ON d.gi = s_suppkey + 1"


@query("mat_diag", DIAG)
def mat_diag(spark, sf):
    return ata(spark, sf).diag().gvec()


@query("diag_matrix", f"SELECT gid AS gi, gid AS gj, v FROM ({X})")
def diag_matrix(spark, sf):
    return sparse_diag_matrix(balances(spark, sf)).df


@query("row_scale", f"SELECT gi, gj, v * (gi % 3 + 1) AS v FROM ({MAT})")
def row_scale(spark, sf):
    a = matrix(spark, sf)
    d = PVector(pfill(0.0, a.rows).df.withColumn("v", (F.col("gid") % 3 + 1).cast("double")), a.rows)
    return a.scale_rows(d).df


# -- layout of matrices


@query(
    "blocks_own_ghost",
    f"SELECT CAST(part AS INTEGER) AS part, row_owner = part AS own_row, col_owner = part AS own_col, count(*) AS entries FROM (SELECT part, {own_part('gi', ORDERS)} AS row_owner, {own_part('gj', SUPPLIERS)} AS col_owner FROM (SELECT part, gi, gj FROM ({COO}) GROUP BY 1, 2, 3)) GROUP BY 1, 2, 3",
)
def blocks_own_ghost(spark, sf):
    a = psparse(triplets(spark, sf), orders(spark, sf), suppliers(spark, sf), assemble=False, entries=read(spark, sf, "lineitem").count()).with_owners()
    own_row, own_col = F.col("row_owner") == F.col("part"), F.col("col_owner") == F.col("part")
    return a.groupBy("part", own_row.alias("own_row"), own_col.alias("own_col")).agg(F.count("*").alias("entries"))


@query("own_own_values", f"SELECT CAST({own_part('gi', ORDERS)} AS INTEGER) AS part, gi, gj, v FROM ({MAT}) WHERE {own_part('gi', ORDERS)} = {own_part('gj', SUPPLIERS)}")
def own_own_values(spark, sf):
    return matrix(spark, sf).own_own_values().select("part", "gi", "gj", "v")


@query("own_ghost_values", f"SELECT CAST({own_part('gi', ORDERS)} AS INTEGER) AS part, gi, gj, v FROM ({MAT}) WHERE {own_part('gi', ORDERS)} <> {own_part('gj', SUPPLIERS)}")
def own_ghost_values(spark, sf):
    return matrix(spark, sf).own_ghost_values().select("part", "gi", "gj", "v")


@query("drop_offpart", f"SELECT gi, gj, v FROM ({MAT}) WHERE {own_part('gi', ORDERS)} = {own_part('gj', SUPPLIERS)}")
def drop_offpart(spark, sf):
    return psparse(triplets(spark, sf), orders(spark, sf), suppliers(spark, sf), drop_offpart=True).df


@query("sub_matrix", f"SELECT gi, gj, v FROM ({MAT}) WHERE gj IN (SELECT s_suppkey + 1 FROM supplier WHERE s_nationkey < 5) AND gi IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'O')")
def sub_matrix(spark, sf):
    rows = read(spark, sf, "orders").filter("o_orderstatus = 'O'").select((F.col("o_orderkey") + 1).alias("gid"))
    cols = read(spark, sf, "supplier").filter("s_nationkey < 5").select((F.col("s_suppkey") + 1).alias("gid"))
    return matrix(spark, sf).submatrix(rows, cols)


@query("mat_consistent", f"SELECT CAST(p.part AS INTEGER) AS part, a.gi, a.gj, a.v FROM (SELECT gi, gj, v FROM (SELECT o_custkey + 1 AS gi, o_orderkey + 1 AS gj, CAST(floor(o_totalprice) AS DOUBLE) AS v FROM orders)) a JOIN (SELECT {own_part('gid', CUSTOMERS)} AS part, gid FROM range(1, {CUSTOMERS} + 1) t(gid) UNION SELECT {own_part('o_orderkey + 1', ORDERS)}, o_custkey FROM orders WHERE o_custkey >= 1) p ON p.gid = a.gi")
def mat_consistent(spark, sf):
    """Rows of customers by orders, and copies on the parts of those who see the customer."""
    coo = read(spark, sf, "orders").select(F.lit(1).alias("part"), (F.col("o_custkey") + 1).alias("gi"), (F.col("o_orderkey") + 1).alias("gj"), F.floor("o_totalprice").cast("double").alias("v"))
    return psparse(coo, customers(spark, sf), orders(spark, sf)).consistent(customers_seen(spark, sf))


@query("repartition_counts", f"SELECT CAST(gi % {PARTS} + 1 AS INTEGER) AS part, count(*) AS entries FROM ({MAT}) GROUP BY 1")
def repartition_counts(spark, sf):
    a = matrix(spark, sf)
    new = partition_from_color(a.rows.index.select("gid", (F.col("gid") % PARTS + 1).alias("owner")), PARTS, a.rows.n)
    return a.repartition(new, a.cols).with_owners().groupBy("part").agg(F.count("*").alias("entries"))


@query("mat_renumber", f"SELECT n.new_gid AS gi, a.gj, a.v FROM ({MAT}) a JOIN (SELECT gid, row_number() OVER (ORDER BY gid % {PARTS}, gid) AS new_gid FROM range(1, {ORDERS} + 1) t(gid)) n ON n.gid = a.gi")
def mat_renumber(spark, sf):
    a = matrix(spark, sf)
    new = partition_from_color(a.rows.index.select("gid", (F.col("gid") % PARTS + 1).alias("owner")), PARTS, a.rows.n)
    return a.repartition(new, a.cols).renumber().df


# -- partitions

INDEX = ["part", "lid", "gid", "owner", "own_id", "ghost_id"]


@query("part_uniform_1d", f"SELECT CAST(part AS INTEGER) AS part, gid, CAST(row_number() OVER (PARTITION BY part ORDER BY gid) AS INTEGER) AS lid FROM (SELECT {own_part('gid', ORDERS)} AS part, gid FROM range(1, {ORDERS} + 1) t(gid))")
def part_uniform_1d(spark, sf):
    return orders(spark, sf).index.select("part", "gid", "lid")


_GRID = "SELECT 1 + (x - 1) + 50 * (y - 1) AS gid, x, y FROM range(1, 51) a(x), range(1, 41) b(y)"
_PX, _PY = own_part("x", "50", 2), own_part("y", "40", 3)


@query("part_uniform_2d", f"SELECT CAST({_PX} + 2 * ({_PY} - 1) AS INTEGER) AS part, gid, CAST(row_number() OVER (PARTITION BY {_PX}, {_PY} ORDER BY gid) AS INTEGER) AS own_id FROM ({_GRID})")
def part_uniform_2d(spark, sf):
    return uniform_partition(spark, (2, 3), (50, 40)).index.select("part", "gid", "own_id")


_BOX = "SELECT px + 2 * (py - 1) AS part, px, py, CASE px WHEN 1 THEN 1 ELSE 26 END AS xa, CASE px WHEN 1 THEN 25 ELSE 50 END AS xb, CASE py WHEN 1 THEN 1 WHEN 2 THEN 14 ELSE 27 END AS ya, CASE py WHEN 1 THEN 13 WHEN 2 THEN 26 ELSE 40 END AS yb FROM range(1, 3) a(px), range(1, 4) b(py)"


@query("part_ghost_2d", f"SELECT CAST(part AS INTEGER) AS part, x + 50 * (y - 1) AS gid, CAST({_PX} + 2 * ({_PY} - 1) AS INTEGER) AS owner, CAST(row_number() OVER (PARTITION BY part ORDER BY y, x) AS INTEGER) AS lid FROM ({_BOX}), range(1, 51) a(x), range(1, 41) b(y) WHERE x BETWEEN xa - 1 AND xb + 1 AND y BETWEEN ya - 1 AND yb + 1")
def part_ghost_2d(spark, sf):
    return uniform_partition(spark, (2, 3), (50, 40), True).index.select("part", "gid", "owner", "lid")


@query("part_periodic_2d", f"SELECT CAST(part AS INTEGER) AS part, (x + 49) % 50 + 1 + 50 * ((y + 39) % 40) AS gid, CAST(row_number() OVER (PARTITION BY part ORDER BY y, x) AS INTEGER) AS lid FROM ({_BOX}), range(0, 52) a(x), range(0, 42) b(y) WHERE x BETWEEN xa - 1 AND xb + 1 AND y BETWEEN ya - 1 AND yb + 1")
def part_periodic_2d(spark, sf):
    return uniform_partition(spark, (2, 3), (50, 40), True, True).index.select("part", "gid", "lid")


def nation_sizes(spark, sf) -> list[int]:
    """Customers of each nation, one number for each part."""
    found = read(spark, sf, "nation").join(read(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    return [r.n for r in found.orderBy("n_nationkey").collect()]


_SIZES = "SELECT n_nationkey + 1 AS part, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"
_STARTS = f"SELECT part, n, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM ({_SIZES})"


@query("part_variable", f"SELECT CAST(part AS INTEGER) AS part, CAST(start + k AS BIGINT) AS gid, CAST(k + 1 AS INTEGER) AS own_id FROM ({_STARTS}) s, range(0, {CUSTOMERS}) r(k) WHERE k < n")
def part_variable(spark, sf):
    return variable_partition(spark, nation_sizes(spark, sf)).index.select("part", "gid", "own_id")


def by_color(spark, sf) -> PRange:
    customers = read(spark, sf, "customer")
    return partition_from_color(customers.select((F.col("c_custkey") + 1).alias("gid"), (F.col("c_nationkey") + 1).alias("owner")), 25, customers.count())


_COLOR = "SELECT CAST(c_nationkey + 1 AS INTEGER) AS part, c_custkey + 1 AS gid, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS own_id FROM customer"


@query("part_color", _COLOR)
def part_color(spark, sf):
    return by_color(spark, sf).index.select("part", "gid", "own_id")


@query("part_trivial", "SELECT CAST(2 AS INTEGER) AS part, o_orderkey + 1 AS gid FROM orders")
def part_trivial(spark, sf):
    return trivial_partition(spark, PARTS, read(spark, sf, "orders").count(), 2).index.select("part", "gid")


@query("part_renumber", f"SELECT part, gid, own_id, row_number() OVER (ORDER BY part, own_id) AS new_gid FROM ({_COLOR})")
def part_renumber(spark, sf):
    p = by_color(spark, sf)
    return p.index.select("part", "gid", "own_id").join(p.new_ids(), "gid")


@query("part_lengths", "SELECT CAST(n_nationkey + 1 AS INTEGER) AS part, count(c_custkey) AS own_length, count(c_custkey) AS local_length, CAST(0 AS BIGINT) AS ghost_length, (SELECT count(*) FROM customer) AS global_length FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def part_lengths(spark, sf):
    return by_color(spark, sf).lengths()


@query("local_permutation", f"SELECT CAST(part AS INTEGER) AS part, lid, CASE WHEN own THEN row_number() OVER (PARTITION BY part, own ORDER BY lid) ELSE sum(own::INT) OVER (PARTITION BY part) + row_number() OVER (PARTITION BY part, own ORDER BY lid) END::BIGINT AS perm FROM (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY y, x) AS INTEGER) AS lid, x BETWEEN xa AND xb AND y BETWEEN ya AND yb AS own FROM ({_BOX}), range(1, 51) a(x), range(1, 41) b(y) WHERE x BETWEEN xa - 1 AND xb + 1 AND y BETWEEN ya - 1 AND yb + 1)")
def local_permutation(spark, sf):
    return uniform_partition(spark, (2, 3), (50, 40), True).local_permutation()


@query("find_owner_uniform", f"SELECT l_orderkey AS gid, CAST(CASE WHEN l_orderkey < 1 THEN 0 ELSE {own_part('l_orderkey', ORDERS)} END AS INTEGER) AS owner, count(*) AS times FROM lineitem GROUP BY 1, 2")
def find_owner_uniform(spark, sf):
    gids = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gid"))
    return orders(spark, sf).find_owner(gids).groupBy("gid", "owner").agg(F.count("*").alias("times"))


@query("find_owner_variable", f"SELECT o_custkey AS gid, CAST(coalesce(part, 0) AS INTEGER) AS owner, count(*) AS times FROM orders LEFT JOIN (SELECT * FROM ({_STARTS}) WHERE n > 0) s ON o_custkey BETWEEN start AND start + n - 1 GROUP BY 1, 2")
def find_owner_variable(spark, sf):
    gids = read(spark, sf, "orders").select(F.col("o_custkey").alias("gid"))
    return variable_partition(spark, nation_sizes(spark, sf)).find_owner(gids).groupBy("gid", "owner").agg(F.count("*").alias("times"))


@query("find_owner_color", "SELECT o_custkey AS gid, CAST(coalesce(c_nationkey + 1, 0) AS INTEGER) AS owner, count(*) AS times FROM orders LEFT JOIN customer ON c_custkey + 1 = o_custkey GROUP BY 1, 2")
def find_owner_color(spark, sf):
    gids = read(spark, sf, "orders").select(F.col("o_custkey").alias("gid"))
    return by_color(spark, sf).find_owner(gids).groupBy("gid", "owner").agg(F.count("*").alias("times"))


#: Customers that each part sees besides its own: those of its orders.
_WANTED = f"SELECT {own_part('o_orderkey + 1', ORDERS)} AS part, o_custkey AS gid, o_orderkey AS pos FROM orders"
_GHOSTS = f"SELECT part, gid, owner, row_number() OVER (PARTITION BY part ORDER BY pos) AS ghost_id FROM (SELECT part, gid, {own_part('gid', CUSTOMERS)} AS owner, min(pos) AS pos FROM ({_WANTED}) WHERE gid >= 1 GROUP BY 1, 2) WHERE owner <> part"


def customers_seen(spark, sf) -> PRange:
    own = uniform_partition(spark, PARTS, read(spark, sf, "customer").count())
    wanted = orders(spark, sf).find_owner(read(spark, sf, "orders").withColumn("k", F.col("o_orderkey") + 1), "k", "part")
    return own.union_ghost(wanted.select("part", F.col("o_custkey").alias("gid"), F.col("o_orderkey").alias("pos")))


@query("union_ghost", f"SELECT CAST(part AS INTEGER) AS part, gid, CAST(owner AS INTEGER) AS owner, CAST(ghost_id AS INTEGER) AS ghost_id FROM ({_GHOSTS})")
def union_ghost(spark, sf):
    return customers_seen(spark, sf).ghosts().select("part", "gid", "owner", "ghost_id")


@query("remove_ghost", f"SELECT CAST({own_part('gid', CUSTOMERS)} AS INTEGER) AS part, gid FROM range(1, {CUSTOMERS} + 1) t(gid)")
def remove_ghost(spark, sf):
    return customers_seen(spark, sf).remove_ghost().index.select("part", "gid")


@query("global_to_local", f"SELECT CAST(w.part AS INTEGER) AS part, w.gid, count(*) AS times, coalesce(max(g.ghost_id), 0) AS ghost_id FROM ({_WANTED}) w LEFT JOIN ({_GHOSTS}) g ON g.part = w.part AND g.gid = w.gid GROUP BY 1, 2")
def global_to_local(spark, sf):
    wanted = orders(spark, sf).find_owner(read(spark, sf, "orders").withColumn("k", F.col("o_orderkey") + 1), "k", "part").select("part", F.col("o_custkey").alias("gid"))
    found = customers_seen(spark, sf).translate(wanted, "gid", "ghost_id", "gid", "ghost_id")
    return found.groupBy("part", "gid").agg(F.count("*").alias("times"), F.max(F.when(F.col("gid") >= 1, F.col("ghost_id")).otherwise(0)).cast("long").alias("ghost_id"))


_EDGES = f"SELECT DISTINCT part AS src, owner AS dst FROM ({_GHOSTS})"


@query("assembly_graph", f"SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS INTEGER) AS snd_pos, CAST(row_number() OVER (PARTITION BY dst ORDER BY src) AS INTEGER) AS rcv_pos FROM ({_EDGES})")
def assembly_graph(spark, sf):
    return customers_seen(spark, sf).assembly_graph()


@query("assembly_local_indices", f"SELECT CAST(part AS INTEGER) AS src, CAST(owner AS INTEGER) AS dst, gid, CAST((SELECT count(*) FROM range(1, {CUSTOMERS} + 1) t(k) WHERE {own_part('k', CUSTOMERS)} = part) + ghost_id AS INTEGER) AS snd_lid, CAST((SELECT count(*) FROM range(1, {CUSTOMERS} + 1) t(k) WHERE {own_part('k', CUSTOMERS)} = owner AND k <= g.gid) AS INTEGER) AS rcv_lid FROM ({_GHOSTS}) g")
def assembly_local_indices(spark, sf):
    return customers_seen(spark, sf).assembly_local_indices()


@query("graph_reverse", f"SELECT CAST(dst AS INTEGER) AS src, CAST(src AS INTEGER) AS dst FROM ({_EDGES})")
def graph_reverse(spark, sf):
    return co.reverse(customers_seen(spark, sf).assembly_graph()).select("src", "dst")


# -- collectives over eight parts of orders

_ITEMS = "SELECT CAST(o_orderkey % 8 + 1 AS INTEGER) AS part, sum(o_custkey) AS x FROM orders GROUP BY 1"


def items(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 8 + 1).cast("int").alias("part")).agg(F.sum("o_custkey").alias("x"))


@query("gather", f"SELECT CAST(2 AS INTEGER) AS part, part AS pos, CAST(x AS BIGINT) AS x FROM ({_ITEMS})")
def gather(spark, sf):
    return co.gather(items(spark, sf), 8, 2)


@query("gather_all", f"SELECT CAST(p AS INTEGER) AS part, part AS pos, CAST(x AS BIGINT) AS x FROM ({_ITEMS}), range(1, 9) r(p)")
def gather_all(spark, sf):
    return co.gather(items(spark, sf), 8, "all")


@query("scatter", f"SELECT CAST(row_number() OVER (ORDER BY part) AS INTEGER) AS part, CAST(x AS BIGINT) AS x FROM ({_ITEMS})")
def scatter(spark, sf):
    whole = items(spark, sf).agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "x"))), lambda s: s["x"]).alias("x"))
    return co.scatter(whole.select(F.lit(3).alias("part"), "x"), 3, 8)


@query("multicast", f"SELECT CAST(p AS INTEGER) AS part, CAST(x AS BIGINT) AS x FROM ({_ITEMS}), range(1, 9) r(p) WHERE part = 2")
def multicast(spark, sf):
    return co.multicast(items(spark, sf), 2, 8)


@query("scan_incl", f"SELECT part, CAST(sum(x) OVER (ORDER BY part) AS BIGINT) AS x FROM ({_ITEMS})")
def scan_incl(spark, sf):
    return co.scan(items(spark, sf), 0)


@query("scan_excl", f"SELECT part, CAST(1 + coalesce(sum(x) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM ({_ITEMS})")
def scan_excl(spark, sf):
    return co.scan(items(spark, sf), 1, "exclusive")


@query("scan_max", f"SELECT part, CAST(greatest(0, max(x) OVER (ORDER BY part)) AS BIGINT) AS x FROM ({_ITEMS})")
def scan_max(spark, sf):
    return co.scan(items(spark, sf), 0, op="max")


@query("reduction_all", f"SELECT part, CAST(10 + (SELECT sum(x) FROM ({_ITEMS})) AS BIGINT) AS x FROM ({_ITEMS})")
def reduction_all(spark, sf):
    return co.reduction(items(spark, sf), 10, "all")


@query("reduction_to", f"SELECT part, CAST(CASE WHEN part = 2 THEN (SELECT max(x) FROM ({_ITEMS})) ELSE 0 END AS BIGINT) AS x FROM ({_ITEMS})")
def reduction_to(spark, sf):
    return co.reduction(items(spark, sf), 0, 2, "max")


@query("map_main", f"SELECT part, CAST(CASE WHEN part = 1 THEN 2 * x ELSE -1 END AS BIGINT) AS x FROM ({_ITEMS})")
def map_main(spark, sf):
    return co.map_main(items(spark, sf), lambda x: x * 2, 1, F.lit(-1))


@query("exchange", "SELECT CAST(dst AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY dst ORDER BY src, snd_pos) AS INTEGER) AS pos, CAST(x AS BIGINT) AS x FROM (SELECT c_nationkey + 1 AS src, s_nationkey + 1 AS dst, row_number() OVER (PARTITION BY c_nationkey ORDER BY s_nationkey) AS snd_pos, c_nationkey * 100 + s_nationkey AS x FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT DISTINCT s_nationkey FROM supplier))")
def exchange(spark, sf):
    src = read(spark, sf, "customer").select("c_nationkey").distinct()
    dst = read(spark, sf, "supplier").select("s_nationkey").distinct()
    pairs = src.join(F.broadcast(dst), F.lit(True))  # 25 by 25 nations
    pairs = pairs.withColumn("snd_pos", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("s_nationkey")))
    edges = pairs.select((F.col("c_nationkey") + 1).alias("src"), "snd_pos", (F.col("s_nationkey") + 1).alias("dst"))
    payload = pairs.select((F.col("c_nationkey") + 1).alias("src"), "snd_pos", (F.col("c_nationkey") * 100 + F.col("s_nationkey")).cast("long").alias("x"))
    return co.exchange(payload, co.exchange_graph(edges))


# -- vectors

_ENTRIES = "SELECT CAST(o_orderkey % 4 + 1 AS INTEGER) AS part, o_custkey AS gid, floor(o_totalprice) AS v FROM orders"


def entries(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select((F.col("o_orderkey") % 4 + 1).cast("int").alias("part"), F.col("o_custkey").alias("gid"), F.floor("o_totalprice").cast("double").alias("v"))


def customers(spark, sf) -> PRange:
    return uniform_partition(spark, PARTS, read(spark, sf, "customer").count())


_SUMMED = f"SELECT gid, coalesce(e.v, 0) AS v FROM range(1, {CUSTOMERS} + 1) t(gid) LEFT JOIN (SELECT gid, sum(v) AS v FROM ({_ENTRIES}) WHERE gid >= 1 GROUP BY 1) e USING (gid)"


@query("pvector_assemble", _SUMMED)
def pvector_assemble(spark, sf):
    return pvector(entries(spark, sf), customers(spark, sf)).gvec()


@query("pvector_by_part", f"SELECT part, gid, sum(v) AS v FROM ({_ENTRIES}) WHERE gid >= 1 GROUP BY 1, 2")
def pvector_by_part(spark, sf):
    v = pvector(entries(spark, sf), customers(spark, sf), assemble=False)
    return v.df.filter("v <> 0").select("part", "gid", "v")


@query("vec_assemble", _SUMMED)
def vec_assemble(spark, sf):
    return pvector(entries(spark, sf), customers(spark, sf), assemble=False).assemble().gvec()


@query("vec_assemble_max", f"SELECT gid, greatest(coalesce(max(v), 0), 0) AS v FROM (SELECT gid, v FROM (SELECT part, gid, sum(v) AS v FROM ({_ENTRIES}) WHERE gid >= 1 GROUP BY 1, 2) UNION ALL SELECT gid, 0 FROM range(1, {CUSTOMERS} + 1) t(gid)) GROUP BY gid")
def vec_assemble_max(spark, sf):
    return pvector(entries(spark, sf), customers(spark, sf), assemble=False).assemble("max").gvec()


@query("vec_ghosts_zero", f"SELECT CAST(part AS INTEGER) AS part, gid, 0.0::DOUBLE AS v FROM ({_GHOSTS})")
def vec_ghosts_zero(spark, sf):
    return pfill(1.0, customers_seen(spark, sf)).assemble().ghost_values()


@query("vec_consistent", f"SELECT CAST(part AS INTEGER) AS part, gid, CAST(10 * owner AS DOUBLE) AS v FROM ({_GHOSTS})")
def vec_consistent(spark, sf):
    p = customers_seen(spark, sf)
    v = PVector(pfill(0.0, p).df.withColumn("v", F.when(F.col("own"), F.col("part") * 10.0).otherwise(F.lit(0.0))), p)
    return v.consistent().ghost_values()


@query("vec_subassembled", f"SELECT CAST({own_part('gid', CUSTOMERS)} AS INTEGER) AS part, gid, 2.0::DOUBLE AS v FROM range(1, {CUSTOMERS} + 1) t(gid)")
def vec_subassembled(spark, sf):
    p = customers(spark, sf)
    one = p.index.select("part", "lid", F.lit(1.0).alias("v"))
    return subassembled(one.unionAll(one), p).own_values()


def summed(spark, sf) -> PVector:
    return pvector(entries(spark, sf), customers(spark, sf))


@query("vec_repartition", f"SELECT CAST(c_nationkey + 1 AS INTEGER) AS part, gid, v FROM ({_SUMMED}) JOIN customer ON c_custkey + 1 = gid")
def vec_repartition(spark, sf):
    return summed(spark, sf).repartition(by_color(spark, sf)).own_values()


@query("vec_renumber", f"SELECT row_number() OVER (ORDER BY c_nationkey, gid) AS gid, v FROM ({_SUMMED}) JOIN customer ON c_custkey + 1 = gid")
def vec_renumber(spark, sf):
    return summed(spark, sf).repartition(by_color(spark, sf)).renumber().gvec()


@query("find_local_indices", f"SELECT CAST(part AS INTEGER) AS part, gid AS node, row_number() OVER (ORDER BY part, gid) AS dof FROM (SELECT {own_part('gid', CUSTOMERS)} AS part, gid FROM ({_SUMMED}) WHERE v > 1000000)")
def find_local_indices(spark, sf):
    v = summed(spark, sf).map(lambda x: x > 1_000_000)
    dofs, local = v.find_local_indices()
    nodes = v.rows.index.select("part", F.col("lid").alias("node_lid"), F.col("gid").alias("node"))
    found = dofs.index.select("part", F.col("lid").alias("dof_lid"), F.col("gid").alias("dof")).join(local.select("part", F.col("dof").alias("dof_lid"), F.col("node").alias("node_lid")), ["part", "dof_lid"])
    return found.join(nodes, ["part", "node_lid"]).select("part", "node", "dof")


_PRICE = "SELECT c_custkey + 1 AS gid, CAST(floor(c_acctbal) + 1001 AS DOUBLE) AS v FROM customer"
_BOTH = f"SELECT a.gid, a.v, b.v AS w FROM ({_PRICE}) a JOIN (SELECT gid, CAST(count(o.o_orderkey) + 1 AS DOUBLE) AS v FROM range(1, {CUSTOMERS} + 1) t(gid) LEFT JOIN orders o ON o.o_custkey + 1 = gid GROUP BY gid) b USING (gid)"


def two_vectors(spark, sf) -> tuple[PVector, PVector]:
    """Positive whole numbers: balances and numbers of orders of customers."""
    rows = customers(spark, sf)
    a = from_gvec(tables.gvec(read(spark, sf, "customer"), F.col("c_custkey") + 1, (F.floor("c_acctbal") + 1001).cast("double")), rows)
    n = read(spark, sf, "orders").select(F.lit(1).alias("part"), (F.col("o_custkey") + 1).alias("gid"), F.lit(1.0).alias("v"))
    b = pvector(n, rows).map(lambda v: v + 1)
    return a, PVector(b.df, a.rows)


@query("vec_axpy", f"SELECT gid, v + 2 * w AS v FROM ({_BOTH})")
def vec_axpy(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.axpy(2.0, b).gvec()


@query("vec_add_sub_neg", f"SELECT gid, -(v + w - 3 * w) AS v FROM ({_BOTH})")
def vec_add_sub_neg(spark, sf):
    a, b = two_vectors(spark, sf)
    return (-(a + b - 3.0 * b)).gvec()


@query("vec_broadcast", f"SELECT gid, v * w + abs(v - w) / 2 + 1 AS v FROM ({_BOTH})")
def vec_broadcast(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.zip(b, lambda x, y: x * y + F.abs(x - y) / 2 + 1).gvec()


@query("vec_div", f"SELECT gid, 0.25::DOUBLE * v AS v FROM ({_BOTH})")
def vec_div(spark, sf):
    return (two_vectors(spark, sf)[0] / 4.0).gvec()


@query("vec_dot", f"SELECT sum(v * w) AS dot FROM ({_BOTH})")
def vec_dot(spark, sf):
    a, b = two_vectors(spark, sf)
    return a.dot_column(b)


_DISTANCES = {
    "euclidean": "sqrt(sum((v - w) * (v - w)))",
    "sqeuclidean": "sum((v - w) * (v - w))",
    "cityblock": "sum(abs(v - w))",
    "totalvariation": "sum(abs(v - w)) / 2",
    "chebyshev": "max(abs(v - w))",
    "hamming": "CAST(sum((v <> w)::INT) AS DOUBLE)",
    "jaccard": "1 - sum(least(v, w)) / sum(greatest(v, w))",
    "braycurtis": "sum(abs(v - w)) / sum(abs(v + w))",
    "cosine": "1 - sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w)))",
    "correlation": "1 - (avg(v * w) - avg(v) * avg(w)) / sqrt((avg(v * v) - avg(v) * avg(v)) * (avg(w * w) - avg(w) * avg(w)))",
    "chisq": "sum((v - w) * (v - w) / (v + w))",
    "kldivergence": "sum(v * ln(v / w))",
    "genkldivergence": "sum(v * ln(v / w) - v + w)",
    "jsdivergence": "sum(v * ln(v / ((v + w) / 2)) / 2 + w * ln(w / ((v + w) / 2)) / 2)",
    "spannorm": "max(v - w) - min(v - w)",
    "meanabsdev": "avg(abs(v - w))",
    "meansqdev": "avg((v - w) * (v - w))",
    "rmsdev": "sqrt(avg((v - w) * (v - w)))",
}
@query("dist_embeddings", "SELECT label, round(sqrt(sum((x - 1) * (x - 1))), 3) AS d FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def dist_embeddings(spark, sf):
    x = read(spark, sf, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label").agg(F.round(METRICS["euclidean"](F.col("x"), F.lit(1.0)), 3).alias("d"))


# -- blocks

_BCOO = "SELECT l_returnflag AS block_i, l_linestatus AS block_j, l_orderkey + 1 AS gi, l_suppkey + 1 AS gj, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
_BX = f"SELECT b AS block_j, gid, CASE b WHEN 'O' THEN v ELSE 2 * v END AS v FROM ({X}), (VALUES ('O'), ('F')) t(b)"


def block_triplets(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    coo = li.select(F.col("l_returnflag").alias("block_i"), F.col("l_linestatus").alias("block_j"), (F.col("l_orderkey") + 1).alias("gi"), (F.col("l_suppkey") + 1).alias("gj"), F.col("l_quantity").alias("v"))
    return compress(coo, by=("block_i", "block_j"), entries=li.count())


@query("block_spmv", f"SELECT block_i, gi AS gid, sum(a.v * x.v) AS v FROM ({_BCOO}) a JOIN ({_BX}) x ON x.block_j = a.block_j AND x.gid = a.gj GROUP BY 1, 2")
def block_spmv(spark, sf):
    x = balances(spark, sf).gvec()
    blocks = x.withColumn("block_i", F.lit("O")).unionByName(x.withColumn("v", F.col("v") * 2).withColumn("block_i", F.lit("F")))
    return block_multiply(block_triplets(spark, sf), blocks, 2 * read(spark, sf, "supplier").count(), read(spark, sf, "lineitem").count())


@query("block_dot", f"SELECT sum(v * v) AS dot, count(*) AS nnz, max(v) AS hi FROM ({_BCOO})")
def block_dot(spark, sf):
    b = block_triplets(spark, sf)
    return b.agg(F.sum(F.col("v") * F.col("v")).alias("dot"), F.count("*").alias("nnz"), F.max("v").alias("hi"))


# -- model problems


def _stencil_sql(shape: tuple[int, ...], centre: str, other: str) -> str:
    names = "xyz"[: len(shape)]
    strides = [1, shape[0], shape[0] * (shape[1] if len(shape) > 1 else 1)]
    gid = " + ".join(f"({c} - 1) * {s}" for c, s in zip(names, strides, strict=False))
    steps = ["(" + ", ".join(["0"] * len(shape)) + f", {centre})"]
    for d in range(len(shape)):
        steps += ["(" + ", ".join(str(s) if k == d else "0" for k in range(len(shape))) + f", {other})" for s in (-1, 1)]
    grid = ", ".join(f"range(1, {n + 1}) r{c}({c})" for c, n in zip(names, shape, strict=True))
    inside = " AND ".join(f"{c} + d{c} BETWEEN 1 AND {n}" for c, n in zip(names, shape, strict=True))
    jump = " + ".join(f"d{c} * {s}" for c, s in zip(names, strides, strict=False))
    return f"SELECT 1 + {gid} AS gi, 1 + {gid} + {jump} AS gj, CAST(v AS DOUBLE) AS v FROM {grid}, (VALUES {', '.join(steps)}) s({', '.join('d' + c for c in names)}, v) WHERE {inside}"


for _name, _shape, _grid in (("1d", (50,), (4,)), ("2d", (20, 30), (2, 2)), ("3d", (8, 9, 10), (2, 1, 2))):

    @query(f"gallery_fdm_{_name}", _stencil_sql(_shape, str(2 * len(_shape) * prod(n + 1 for n in _shape)), str(-prod(n + 1 for n in _shape))))
    def gallery_fdm(spark, sf, shape=_shape, grid=_grid):
        coo, rows, cols = gallery.laplacian_fdm(spark, shape, grid)
        return psparse(coo, rows, cols).df


@query("gallery_laplace_2d", _stencil_sql((20, 30), "4", "-1"))
def gallery_laplace_2d(spark, sf):
    coo, rows, cols = gallery.laplace_matrix(spark, (20, 30), (2, 2))
    return psparse(coo, rows, cols).df


#: The stiffness of a square cell, corners in order, times 6.
_SQUARE = ((4, -1, -1, -2), (-1, 4, -2, -1), (-1, -2, 4, -1), (-2, -1, -1, 4))
_CELL = ", ".join(f"({a % 2}, {a // 2}, {b % 2}, {b // 2}, {_SQUARE[a][b]})" for a in range(4) for b in range(4))
_FEM = f"SELECT x + ax - 1 + 12 * (y + ay - 2) AS gi, x + bx - 1 + 12 * (y + by_ - 2) AS gj, sum(v) AS v FROM range(1, 14) a(x), range(1, 14) b(y), (VALUES {_CELL}) c(ax, ay, bx, by_, v) WHERE x + ax - 1 BETWEEN 1 AND 12 AND y + ay - 1 BETWEEN 1 AND 12 AND x + bx - 1 BETWEEN 1 AND 12 AND y + by_ - 1 BETWEEN 1 AND 12 GROUP BY 1, 2"


@query("gallery_fem_2d", f"SELECT gi, gj, round(v / 6.0::DOUBLE, 6) + 0.0 AS v FROM ({_FEM})")
def gallery_fem_2d(spark, sf):
    coo, rows, cols = gallery.laplacian_fem(spark, (12, 12), (2, 2))
    return psparse(coo, rows, cols).df.select("gi", "gj", (F.round("v", 6) + 0.0).alias("v"))


_HPCG = "SELECT x + 8 * (y - 1) + 64 * (z - 1) AS gi, x + dx + 8 * (y + dy - 1) + 64 * (z + dz - 1) AS gj, CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN 26.0 ELSE -1.0 END::DOUBLE AS v FROM range(1, 9) a(x), range(1, 9) b(y), range(1, 9) c(z), range(-1, 2) d(dx), range(-1, 2) e(dy), range(-1, 2) f(dz) WHERE x + dx BETWEEN 1 AND 8 AND y + dy BETWEEN 1 AND 8 AND z + dz BETWEEN 1 AND 8"


@query("gallery_hpcg27", _HPCG)
def gallery_hpcg27(spark, sf):
    coo, _, _ = gallery.hpcg_stencil(spark, (8, 8, 8), (2, 2, 1))
    return coo.select("gi", "gj", "v")


@query("gallery_hpcg_rhs", f"SELECT gi AS gid, sum(v) AS v, 27.0::DOUBLE - count(*) AS b FROM ({_HPCG}) GROUP BY gi")
def gallery_hpcg_rhs(spark, sf):
    coo, b, rows = gallery.hpcg_stencil(spark, (8, 8, 8), (2, 2, 1))
    a = psparse(coo, rows, rows)
    return (a @ pfill(1.0, rows)).gvec().join(b.withColumnRenamed("v", "b"), "gid")


@query("gallery_coords", "SELECT x + 6 * (y - 1) + 42 * (z - 1) AS gid, x * (1 / 7.0::DOUBLE) AS x1, y * (1 / 8.0::DOUBLE) AS x2, z * (1 / 9.0::DOUBLE) AS x3 FROM range(1, 7) a(x), range(1, 8) b(y), range(1, 9) c(z)")
def gallery_coords(spark, sf):
    return gallery.node_coordinates_unit_cube(spark, (6, 7, 8), (2, 1, 2))[0]


@query("gallery_nullspace", "SELECT 2 * (x + 6 * (y - 1) - 1) + c AS gid, CASE c WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS b1, CASE c WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS b2, CASE c WHEN 1 THEN -y * (1 / 8.0::DOUBLE) ELSE x * (1 / 7.0::DOUBLE) END AS b3 FROM range(1, 7) a(x), range(1, 8) b(y), range(1, 3) d(c)")
def gallery_nullspace(spark, sf):
    coords, _ = gallery.node_coordinates_unit_cube(spark, (6, 7))
    return gallery.nullspace_linear_elasticity(coords, 2)


@query("gallery_dofs", f"SELECT CAST({_PX} + 2 * ({_PY} - 1) AS INTEGER) AS part, (gid - 1) * 3 + c AS gid FROM ({_GRID}), range(1, 4) d(c)")
def gallery_dofs(spark, sf):
    return node_to_dof_partition(uniform_partition(spark, (2, 3), (50, 40)), 3).index.select("part", "gid")


# -- iterations with a fixed number of steps, and converged ones

_A8 = _stencil_sql((8, 8), "4", "-1")
_B8 = f"SELECT gi AS gid, sum(v) AS v FROM ({_A8}) GROUP BY gi"


def small_system(spark) -> tuple[PSparseMatrix, PVector]:
    """The 8 by 8 Laplacian on four parts, and what it gives for ones."""
    coo, rows, cols = gallery.laplace_matrix(spark, (8, 8), (2, 2))
    a = psparse(coo, rows, cols).cut()
    return a, (a @ pfill(1.0, rows)).cut()


def _steps_sql(omega: str, count: int) -> str:
    out = "WITH a AS MATERIALIZED (" + _A8 + "), b AS MATERIALIZED (" + _B8 + "), x0 AS MATERIALIZED (SELECT gid, 0.0::DOUBLE AS v FROM b)"
    for k in range(count):
        out += f", x{k + 1} AS MATERIALIZED (SELECT x.gid, x.v - {omega} * (s.v - b.v) AS v FROM x{k} x JOIN b USING (gid) JOIN (SELECT a.gi AS gid, sum(a.v * y.v) AS v FROM a JOIN x{k} y ON y.gid = a.gj GROUP BY a.gi) s USING (gid))"
    return out


@query("jacobi_k", _steps_sql("0.25::DOUBLE", 3) + " SELECT gid, round(v, 6) AS v FROM x3")
def jacobi_k(spark, sf):
    a, b = small_system(spark)
    x = solvers.jacobi(solvers.linear_problem(solvers.zeros_for(a), a, b), iterations=3).solve().problem.solution
    return x.gvec().select("gid", F.round("v", 6).alias("v"))


@query("richardson_k", _steps_sql("0.125::DOUBLE", 3) + " SELECT gid, round(v, 6) AS v FROM x3")
def richardson_k(spark, sf):
    a, b = small_system(spark)
    x = solvers.richardson(solvers.linear_problem(solvers.zeros_for(a), a, b), iterations=3, omega=0.125).solve().problem.solution
    return x.gvec().select("gid", F.round("v", 6).alias("v"))


@query("power_iter_k", "WITH a AS MATERIALIZED (" + _A8 + "), x0 AS MATERIALIZED (SELECT gi AS gid, 1.0::DOUBLE AS v FROM a GROUP BY gi), " + ", ".join(f"x{k + 1} AS MATERIALIZED (SELECT gid, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT gi AS gid, sum(a.v * y.v) AS v FROM a JOIN x{k} y ON y.gid = a.gj GROUP BY gi))" for k in range(3)) + " SELECT round(abs(sum(s.v * x.v) / sum(x.v * x.v)), 6) AS rho FROM x3 x JOIN (SELECT gi AS gid, sum(a.v * y.v) AS v FROM a JOIN x3 y ON y.gid = a.gj GROUP BY gi) s USING (gid)")
def power_iter_k(spark, sf):
    a, _ = small_system(spark)
    rho = solvers.spectral_radius(a, pfill(1.0, a.rows), 3)
    return spark.createDataFrame([(rho,)], "rho double").select(F.round("rho", 6).alias("rho"))


_ONES8 = "SELECT gid, 1.0::DOUBLE AS v FROM range(1, 65) t(gid)"


def _solved(spark, make) -> DataFrame:
    a, b = small_system(spark)
    x = make(solvers.linear_problem(solvers.zeros_for(a), a, b)).solve().problem.solution
    return x.gvec().select("gid", F.round("v", 5).alias("v"))


@query("cg_fdm", _ONES8)
def cg_fdm(spark, sf):
    return _solved(spark, lambda p: solvers.cg(p, tolerance=1e-9))


@query("lu_fdm", _ONES8)
def lu_fdm(spark, sf):
    return _solved(spark, solvers.lu)


@query("strength_graph", "WITH a AS (" + _FEM + "), n AS (SELECT (gi - 1) // 2 + 1 AS gi, (gj - 1) // 2 + 1 AS gj, sqrt(sum(v / 6.0::DOUBLE * (v / 6.0::DOUBLE))) AS n FROM a GROUP BY 1, 2) SELECT e.gi, e.gj, 1.0::DOUBLE AS v FROM n e JOIN n p ON p.gi = e.gi AND p.gj = e.gi JOIN n q ON q.gi = e.gj AND q.gj = e.gj WHERE e.gi = e.gj OR (e.n > 0 AND e.n >= 0.3 * sqrt(p.n * q.n))")
def strength_graph(spark, sf):
    coo, rows, cols = gallery.laplacian_fem(spark, (12, 12), (2, 2))
    return distributed.strength_graph(psparse(coo, rows, cols).df, 2, 0.3)


@query("newton_scalar", "SELECT round(sqrt(2.0::DOUBLE), 9) AS x")
def newton_scalar(spark, sf):
    x = solvers.newton_raphson(solvers.nonlinear_problem(lambda x: (2 * x * x - 4, 4 * x), 1.0)).solve().problem.solution
    return spark.createDataFrame([(x,)], "x double").select(F.round("x", 9).alias("x"))


@query("backward_euler_scalar", "SELECT 10.0::DOUBLE AS t, round(320 / pow(2.0::DOUBLE, 10), 9) AS u, round(-320 / pow(2.0::DOUBLE, 10), 9) AS v")
def backward_euler_scalar(spark, sf):
    """u' = -u from 320 in ten steps of 1: each halves u."""
    problem = solvers.ode_problem(lambda t, u, v, du, dv: (v + u, du + dv), (0.0, 320.0, 0.0), (0.0, 10.0))
    found = spark.createDataFrame([solvers.backward_euler(problem, dt=1.0).solve().problem.solution], "t double, u double, v double")
    return found.select("t", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


# -- nested arrays

_LENGTHS = "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1"


@query("length_to_ptrs", f"SELECT k, n, CAST(1 + coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM ({_LENGTHS})")
def length_to_ptrs(spark, sf):
    lengths = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return jagged.length_to_ptrs(lengths, "k", "n")


@query("rewind_ptrs", f"SELECT k, CAST(1 + coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM ({_LENGTHS})")
def rewind_ptrs(spark, sf):
    """Ends of the customers' stretches moved on to their begins."""
    lengths = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    ends = jagged.length_to_ptrs(lengths, "k", "n").withColumn("stop", F.col("ptr") + F.col("n"))
    return jagged.rewind_ptrs(ends.drop("ptr"), "k", "stop").select("k", "ptr")


@query("jagged_round_trip", "SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey AS v FROM orders")
def jagged_round_trip(spark, sf):
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    flat = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), pos.alias("pos"), F.col("o_orderkey").alias("v"))
    return jagged.flatten(jagged.nest(flat, "k"), "k", "values").select("k", F.col("pos").cast("long").alias("pos"), "v")


@query("parts", "SELECT CAST(part AS INTEGER) AS part, CAST((part - 1) % 2 + 1 AS BIGINT) AS px, CAST((part - 1) // 2 + 1 AS BIGINT) AS py FROM range(1, 5) t(part)")
def parts(spark, sf):
    px, py = coordinates(F.col("part"), (2, 2))
    return parts_table(spark, 4).select("part", px.alias("px"), py.alias("py"))


@query("expand_ranges", f"SELECT CAST(part AS INTEGER) AS part, CAST(start + k AS BIGINT) AS gid FROM ({_STARTS}) s, range(0, {CUSTOMERS}) r(k) WHERE k < n")
def expand_ranges(spark, sf):
    blocks = variable_partition(spark, nation_sizes(spark, sf)).blocks
    return expand(blocks, F.col("start"), F.col("stop"), "gid").select("part", "gid")


@query("local_indices", "SELECT CAST(o_custkey % 4 + 1 AS INTEGER) AS part, c_custkey + 1 AS gid, CAST(c_custkey % 4 + 1 AS INTEGER) AS owner, CAST(row_number() OVER (PARTITION BY o_custkey % 4, c_custkey % 4 = o_custkey % 4 ORDER BY c_custkey) AS INTEGER) AS k FROM (SELECT DISTINCT o_custkey % 4 AS o_custkey FROM orders), customer")
def local_indices(spark, sf):
    every = read(spark, sf, "customer").withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(1, 5)])))
    local = every.select("part", F.row_number().over(Window.partitionBy("part").orderBy("c_custkey")).alias("lid"), (F.col("c_custkey") + 1).alias("gid"), (F.col("c_custkey") % 4 + 1).cast("int").alias("owner"))
    index = from_local(local, 0, 4).index
    return index.select("part", "gid", "owner", F.greatest("own_id", "ghost_id").alias("k"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship query: assembly and product on the dense rows."""
    return spmv_dense_rows(spark, sf)
