"""The kernels of parts as grouped functions over distributed matrices.

``part`` is data, never a physical partition: a part's own block and right-hand
side meet in one task, and values of other parts are taken out of the right-hand
side beforehand by a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .local import Local, aggregate, solve_block, sweeps
from .matrix import PSparseMatrix, multiply
from .prange import PRange, node_to_dof_partition, parts_table, variable_partition
from .vector import PVector, from_gvec


def own_block(a: PSparseMatrix) -> DataFrame:
    return a.own_own_values().select("part", "gi", "gj", "v")


def _block(rows: pd.DataFrame, gids: np.ndarray) -> Local:
    place = {g: k for k, g in enumerate(gids.tolist())}
    return Local.of(rows.gi.map(place), rows.gj.map(place), rows.v, len(gids), len(gids))


def _by_part(a: PSparseMatrix, table: DataFrame, kernel) -> DataFrame:
    """``kernel`` (own block, rows of the part) -> values, for each part."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("gid", ignore_index=True)
        gids = right.gid.to_numpy()
        values = kernel(_block(left, gids), right) if len(right) else []
        return pd.DataFrame({"gid": gids.astype("int64"), "v": np.asarray(values, float)})

    return own_block(a).groupBy("part").cogroup(table.groupBy("part")).applyInPandas(run, "gid long, v double")


def relax(a: PSparseMatrix, x: PVector, b: PVector, sweep: str = "symmetric") -> PVector:
    """A Gauss-Seidel sweep in each part; ghost values stay as they were."""
    outside = a.own_ghost_values().select("gi", "gj", "v")
    table = b.own().select("part", "gid", F.col("v").alias("b")).join(x.gvec().withColumnRenamed("v", "x"), "gid")
    table = table.join(multiply(outside, x.gvec(), x.rows.n).withColumnRenamed("v", "o"), "gid", "left").select("part", "gid", "x", (F.col("b") - F.coalesce("o", F.lit(0.0))).alias("b"))
    out = _by_part(a, table, lambda block, rows: sweeps(block, rows.x.to_numpy(float).copy(), rows.b.to_numpy(float), sweep))
    return from_gvec(out, a.cols)


def schwarz(a: PSparseMatrix, r: PVector, local_solver=solve_block) -> PVector:
    """Each part's own system solved for its part of ``r``; ``local_solver(block, r)`` takes a part's matrix."""
    table = r.own().select("part", "gid", "v")
    return from_gvec(_by_part(a, table, lambda block, rows: local_solver(block, rows.v.to_numpy(float))), a.cols)


def aggregates(a: PSparseMatrix, epsilon: float = 0.0) -> tuple[DataFrame, PRange]:
    """(part, gid, agg) with contiguous aggregate ids in the order of parts (isolated nodes are missing), and their range."""
    table = a.rows.own().select("part", "gid")
    out = _by_part(a, table, lambda block, rows: aggregate(block, epsilon)[0])
    local = out.select("gid", F.col("v").cast("long").alias("k")).join(table, "gid")
    counts = parts_table(a.df.sparkSession, a.rows.parts).join(local.groupBy("part").agg(F.max("k").alias("size")), "part", "left").select("part", F.coalesce("size", F.lit(0)).alias("size"))
    sizes = [int(r[1]) for r in counts.orderBy("part").collect()]  # one number for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    numbered = local.filter("k > 0").join(start, "part").select("part", "gid", (F.col("start") + F.col("k")).cast("long").alias("agg"))
    return numbered, variable_partition(a.df.sparkSession, sizes)


def constant_prolongator(aggs: DataFrame, coarse: PRange, fine: PRange) -> PSparseMatrix:
    """Ones from nodes to their aggregates."""
    return PSparseMatrix(aggs.select(F.col("gid").alias("gi"), F.col("agg").alias("gj"), F.lit(1.0).alias("v")), fine, coarse)


def nodes_in_aggregates(aggs: DataFrame) -> DataFrame:
    """(agg, nodes): ascending ids of each aggregate, which are few."""
    return aggs.groupBy("agg").agg(F.sort_array(F.collect_list("gid")).alias("nodes"))


def tentative_prolongator(aggs: DataFrame, coarse: PRange, fine: PRange, modes: DataFrame, block_size: int = 1) -> tuple[PSparseMatrix, DataFrame]:
    """The prolongator that keeps given modes, and the coarse modes.

    ``modes`` has (gid, b1, ...) on the unknowns, ``block_size`` of them at a node
    of ``aggs``. Each aggregate's rows are orthogonalised (thin QR); its columns
    are as many coarse unknowns as modes.
    """
    names = [c for c in modes.columns if c != "gid"]
    k = len(names)
    c = F.explode(F.sequence(F.lit(1), F.lit(block_size))).alias("c")
    dofs = aggs.select("agg", "gid", c).select("agg", ((F.col("gid") - 1) * block_size + F.col("c")).cast("long").alias("gid")).join(modes, "gid")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gid", ignore_index=True)
        if len(rows) < k:
            raise ValueError("an aggregate has fewer unknowns than modes")
        q, r = np.linalg.qr(rows[names].to_numpy(float))
        first = (int(rows["agg"].iloc[0]) - 1) * k
        up = [(0, int(g), first + j + 1, float(q[a, j])) for a, g in enumerate(rows.gid) for j in range(k)]
        down = [(1, first + a + 1, b + 1, float(r[a, b])) for a in range(k) for b in range(k)]
        return pd.DataFrame(up + down, columns=["kind", "gi", "gj", "v"])

    both = dofs.groupBy("agg").applyInPandas(split, "kind int, gi long, gj long, v double")
    both = cut(both)
    wide = node_to_dof_partition(coarse, k) if k > 1 else coarse
    prolongator = PSparseMatrix(both.filter("kind = 0").select("gi", "gj", "v"), fine, wide)
    return prolongator, both.filter("kind = 1").select(F.col("gi").alias("gid"), F.col("gj").alias("mode"), "v")


def strength_graph(a: DataFrame, block_size: int, epsilon: float) -> DataFrame:
    """(gi, gj, v = 1) between nodes of ``block_size`` unknowns.

    An edge needs a Frobenius norm of its block of at least epsilon times the
    geometric mean of the diagonal blocks' norms, and not 0; diagonals are in
    when epsilon <= 1. With one unknown the matrix is its own graph.
    """
    if block_size < 1 or epsilon < 0:
        raise ValueError("block_size >= 1 and epsilon >= 0")
    if block_size == 1:
        return a.select("gi", "gj", "v")
    node = lambda c: (F.floor((F.col(c) - 1) / block_size) + 1).cast("long")
    norms = a.select(node("gi").alias("gi"), node("gj").alias("gj"), "v").groupBy("gi", "gj").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    own = norms.filter("gi = gj").select(F.col("gi").alias("node"), F.col("n").alias("d"))
    edge = norms.filter("gi <> gj and n > 0")
    edge = edge.join(own.select(F.col("node").alias("gi"), F.col("d").alias("di")), "gi").join(own.select(F.col("node").alias("gj"), F.col("d").alias("dj")), "gj")
    edge = edge.filter(F.col("n") >= F.lit(float(epsilon)) * F.sqrt(F.col("di") * F.col("dj"))).select("gi", "gj", F.lit(1.0).alias("v"))
    if epsilon > 1:
        return edge
    return edge.unionAll(own.select(F.col("node").alias("gi"), F.col("node").alias("gj"), F.lit(1.0).alias("v")))


def node_partition(dofs: PRange, block_size: int) -> PRange:
    """The nodes of unknowns that lie ``block_size`` to a node on one part."""
    first = dofs.own().filter((F.col("gid") - 1) % block_size == 0)
    own = (F.floor((F.col("own_id") - 1) / block_size) + 1).cast("int")
    index = first.select("part", own.alias("lid"), ((F.col("gid") - 1) / block_size + 1).cast("long").alias("gid"), "owner", own.alias("own_id"), F.lit(0).alias("ghost_id"))
    return PRange(index, dofs.n // block_size, dofs.parts)


def wide_modes(low: DataFrame) -> DataFrame:
    """(gid, b1, ...) from (gid, mode, v)."""
    names = sorted({r.mode for r in low.select("mode").distinct().collect()})  # one for each mode
    return low.groupBy("gid").agg(*[F.sum(F.when(F.col("mode") == m, F.col("v")).otherwise(F.lit(0.0))).alias(f"b{m}") for m in names])
