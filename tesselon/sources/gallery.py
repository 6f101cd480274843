"""Model problems: a range of points, a literal stencil, a bounds filter.

Every generator gives triplets (part, gi, gj, v) and the partitions of rows and
columns; nothing is built on the driver but the stencil.
"""

from __future__ import annotations

from itertools import product
from math import prod, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.prange import PRange, node_to_dof_partition, uniform_partition


def _inside(coords: list[Column], shape: tuple[int, ...]) -> Column:
    ok = F.lit(True)
    for c, n in zip(coords, shape, strict=True):
        ok = ok & (c >= 1) & (c <= n)
    return ok


def stencil(spark: SparkSession, shape: tuple[int, ...], parts: tuple[int, ...], entries: list[tuple[tuple[int, ...], float]]) -> DataFrame:
    """(part, gi, gj, v): each point with its neighbours inside the grid, owned by the point's part."""
    dims = range(len(shape))
    literal = F.array(*[F.struct(*[F.lit(s[d]).alias(f"d{d}") for d in dims], F.lit(float(v)).alias("v")) for s, v in entries])
    points = spark.range(1, prod(shape) + 1).withColumnRenamed("id", "gi").withColumn("s", F.explode(literal))
    coords = [c + F.col(f"s.d{d}") for d, c in enumerate(ids.coordinates(F.col("gi"), shape))]
    found = points.filter(_inside(coords, shape))
    return found.select(ids.uniform_owner(F.col("gi"), shape, parts).alias("part"), "gi", ids.linear_id(coords, shape).alias("gj"), F.col("s.v").alias("v"))


def _cross(dims: int, centre: float, other: float) -> list[tuple[tuple[int, ...], float]]:
    found = [((0,) * dims, centre)]
    for d in range(dims):
        for step in (-1, 1):
            found.append((tuple(step if k == d else 0 for k in range(dims)), other))
    return found


def _shapes(nodes, parts) -> tuple[tuple[int, ...], tuple[int, ...]]:
    shape = tuple(nodes) if isinstance(nodes, (tuple, list)) else (nodes,)
    return shape, ids.per_dim(parts if parts is not None else 1, len(shape))


def laplacian_fdm(spark: SparkSession, nodes, parts=None) -> tuple[DataFrame, PRange, PRange]:
    """The finite-difference Laplacian on interior nodes, scaled by the product of n + 1."""
    shape, grid = _shapes(nodes, parts)
    a = float(prod(n + 1 for n in shape))
    rows = uniform_partition(spark, grid, shape)
    return stencil(spark, shape, grid, _cross(len(shape), 2 * len(shape) * a, -a)), rows, rows


def laplace_matrix(spark: SparkSession, nodes, parts=None) -> tuple[DataFrame, PRange, PRange]:
    """The same without scaling."""
    shape, grid = _shapes(nodes, parts)
    rows = uniform_partition(spark, grid, shape)
    return stencil(spark, shape, grid, _cross(len(shape), 2.0 * len(shape), -1.0)), rows, rows


def _gradients(shape: tuple[int, ...]) -> tuple[list[tuple[int, ...]], np.ndarray, float]:
    """Corners of a cell, shape function gradients [corner, point, direction] and the weight of a point."""
    corners = [c[::-1] for c in product((0, 1), repeat=len(shape))]
    h = [1 / (n + 1) for n in shape]
    gauss = (-1 / sqrt(3), 1 / sqrt(3))
    value = lambda corner, x: (1 + (2 * corner - 1) * x) / 2
    out = np.zeros((len(corners), len(corners), len(shape)))
    for a, corner in enumerate(corners):
        for p, point in enumerate(corners):
            for d in range(len(shape)):
                slope = (2 * corner[d] - 1) / h[d]
                out[a, p, d] = slope * prod(value(corner[k], gauss[point[k]]) for k in range(len(shape)) if k != d)
    return corners, out, prod(h) / 2 ** len(shape)


def element_laplacian(shape: tuple[int, ...]) -> np.ndarray:
    _, g, weight = _gradients(shape)
    return weight * np.einsum("apd,bpd->ab", g, g)


def element_elasticity(shape: tuple[int, ...], young: float = 1.0, poisson: float = 0.25, compat: bool = False) -> np.ndarray:
    """The stiffness of a cell, unknowns by node, then direction.

    ``compat`` leaves out the point weight and carries strains over from one
    point to the next.
    """
    corners, g, weight = _gradients(shape)
    dims, n = len(shape), len(corners)
    lam, mu = young * poisson / ((1 + poisson) * (1 - 2 * poisson)), young / (2 * (1 + poisson))
    out = np.zeros((n * dims, n * dims))
    for (a, ca), (b, cb) in product(product(range(n), range(dims)), repeat=2):
        left, right = np.zeros((dims, dims)), np.zeros((dims, dims))
        for p in range(n):
            if not compat:
                left[:], right[:] = 0, 0
            left[ca], right[cb] = g[a, p], g[b, p]
            left, right = (left + left.T) / 2, (right + right.T) / 2
            stress = lam * np.trace(right) * np.eye(dims) + 2 * mu * right
            out[a * dims + ca, b * dims + cb] += (1.0 if compat else weight) * np.trace(left @ stress)
    return out


def _fem(spark: SparkSession, shape: tuple[int, ...], grid: tuple[int, ...], element: np.ndarray, per_node: int) -> DataFrame:
    """Triplets of all cells, owned by the cell's part; positions repeat from cell to cell."""
    cells = tuple(n + 1 for n in shape)
    corners = [c[::-1] for c in product((0, 1), repeat=len(shape))]
    dims = range(len(shape))
    entries = []
    for (a, ca), (b, cb) in product(product(range(len(corners)), range(per_node)), repeat=2):
        v = float(element[a * per_node + ca, b * per_node + cb])
        fields = [F.lit(corners[a][d] - 1).alias(f"a{d}") for d in dims] + [F.lit(corners[b][d] - 1).alias(f"b{d}") for d in dims]
        entries.append(F.struct(*fields, F.lit(ca + 1).alias("ca"), F.lit(cb + 1).alias("cb"), F.lit(v).alias("v")))
    rows = spark.range(1, prod(cells) + 1).withColumn("part", ids.uniform_owner(F.col("id"), cells, grid)).withColumn("s", F.explode(F.array(*entries)))
    at = ids.coordinates(F.col("id"), cells)
    i = [c + F.col(f"s.a{d}") for d, c in enumerate(at)]
    j = [c + F.col(f"s.b{d}") for d, c in enumerate(at)]
    found = rows.filter(_inside(i, shape) & _inside(j, shape))
    dof = lambda coords, c: ((ids.linear_id(coords, shape) - 1) * per_node + F.col(c)).cast("long")
    return found.select("part", dof(i, "s.ca").alias("gi"), dof(j, "s.cb").alias("gj"), F.col("s.v").alias("v"))


def laplacian_fem(spark: SparkSession, nodes, parts=None) -> tuple[DataFrame, PRange, PRange]:
    """The bilinear finite-element Laplacian on interior nodes, one triplet for each cell and pair of corners."""
    shape, grid = _shapes(nodes, parts)
    rows = uniform_partition(spark, grid, shape)
    return _fem(spark, shape, grid, element_laplacian(shape), 1), rows, rows


def linear_elasticity_fem(spark: SparkSession, nodes, parts=None, young: float = 1.0, poisson: float = 0.25, compat: bool = False) -> tuple[DataFrame, PRange, PRange]:
    """Linear elasticity with as many unknowns at a node as dimensions."""
    shape, grid = _shapes(nodes, parts)
    rows = node_to_dof_partition(uniform_partition(spark, grid, shape), len(shape))
    return _fem(spark, shape, grid, element_elasticity(shape, young, poisson, compat), len(shape)), rows, rows


def node_coordinates_unit_cube(spark: SparkSession, nodes, parts=None) -> tuple[DataFrame, PRange]:
    """(gid, x1[, x2[, x3]]): interior nodes of the unit cube."""
    shape, grid = _shapes(nodes, parts)
    at = ids.coordinates(F.col("id"), shape)
    points = spark.range(1, prod(shape) + 1)
    columns = [(c * F.lit(1 / (n + 1))).alias(f"x{d + 1}") for d, (c, n) in enumerate(zip(at, shape, strict=True))]
    return points.select(F.col("id").alias("gid"), *columns), uniform_partition(spark, grid, shape)


def nullspace_linear_elasticity(coordinates: DataFrame, dims: int) -> DataFrame:
    """(gid, b1, ...): rigid-body modes on the unknowns; 1, 3 or 6 of them."""
    x = [F.col(f"x{d + 1}") for d in range(dims)]
    zero, one = F.lit(0.0), F.lit(1.0)
    shifts = [[one if c == d else zero for c in range(dims)] for d in range(dims)]
    turns = {1: [], 2: [[-x[1], x[0]]] if dims == 2 else [], 3: [[-x[1], x[0], zero], [zero, -x[2], x[1]], [x[2], zero, -x[0]]] if dims == 3 else []}
    if dims not in turns:
        raise NotImplementedError("one to three dimensions")
    modes = shifts + turns[dims]
    each = F.array(*[F.struct(F.lit(c + 1).alias("c"), *[m[c].alias(f"b{k + 1}") for k, m in enumerate(modes)]) for c in range(dims)])
    wide = coordinates.select("gid", F.explode(each).alias("s"))
    return wide.select(((F.col("gid") - 1) * dims + F.col("s.c")).cast("long").alias("gid"), *[F.col(f"s.b{k + 1}").alias(f"b{k + 1}") for k in range(len(modes))])


def near_nullspace_linear_elasticity(coordinates: DataFrame, dims: int) -> DataFrame:
    """Another name of ``nullspace_linear_elasticity``."""
    return nullspace_linear_elasticity(coordinates, dims)


def hpcg_stencil(spark: SparkSession, shape: tuple[int, int, int], parts: tuple[int, int, int] = (1, 1, 1)) -> tuple[DataFrame, DataFrame, PRange]:
    """The 27-point matrix (26 on the diagonal, -1 beside it), its right-hand side (gid, v) for ones, and the rows."""
    entries = [(s, 26.0 if s == (0, 0, 0) else -1.0) for s in product((-1, 0, 1), repeat=3)]
    coo = stencil(spark, shape, parts, entries)
    near = [F.lit(3) - (c == 1).cast("int") - (c == n).cast("int") if n > 1 else F.lit(1) for c, n in zip(ids.coordinates(F.col("id"), shape), shape, strict=True)]
    b = spark.range(1, prod(shape) + 1).select(F.col("id").alias("gid"), (F.lit(27) - near[0] * near[1] * near[2]).cast("double").alias("v"))
    return coo, b, uniform_partition(spark, parts, shape)
