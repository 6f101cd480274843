"""The conjugate-gradient benchmark: a 27-point problem, geometric multigrid, reports.

The same steps run on two paths: on tables (``spark_setup``), where levels are
distributed matrices, sweeps run part by part and moving between grids is
arithmetic on ids; and on one machine (``pc_setup``), since an iteration of a small
problem is all job overhead on a cluster.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.ids import near_cubic
from ..sources import gallery
from . import distributed
from .local import Local, Vector, sweeps
from .matrix import PSparseMatrix, psparse
from .vector import PVector, from_gvec

#: Fixed by the benchmark: iterations of a set and multigrid levels.
ITERATIONS, LEVELS = 50, 4


@dataclass
class Geometry:
    nx: int
    ny: int
    nz: int
    npx: int
    npy: int
    npz: int
    nnz: list[int] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)


def build_local(shape: tuple[int, int, int], grid: tuple[int, int, int] = (1, 1, 1)) -> tuple[Local, Vector]:
    """The 27-point matrix and right-hand side of a global box, with the part of each row."""
    n = math.prod(shape)
    at = np.stack(np.unravel_index(np.arange(n), shape, order="F"))
    limits, strides = np.array(shape)[:, None], np.array([1, shape[0], shape[0] * shape[1]])
    i, j, v = [], [], []
    for step in product((-1, 0, 1), repeat=3):
        moved = at + np.array(step)[:, None]
        inside = ((moved >= 0) & (moved < limits)).all(axis=0)
        rows = np.flatnonzero(inside)
        i.append(rows)
        j.append(strides @ moved[:, inside])
        v.append(np.full(len(rows), 26.0 if step == (0, 0, 0) else -1.0))
    box = np.array(shape) // np.array(grid)
    block = at // box[:, None]
    part = 1 + block[0] + grid[0] * (block[1] + grid[1] * block[2])
    a = Local.of(np.concatenate(i), np.concatenate(j), np.concatenate(v), n, n, part)
    return a, Vector.of(27.0 - np.diff(a.ptr))


def coarse_points(shape: tuple[int, int, int]) -> np.ndarray:
    """The fine index of each coarse point: every second one in each direction."""
    if any(n % 2 for n in shape):
        raise ValueError("every direction must have an even number of points")
    grid = np.meshgrid(*[np.arange(0, n, 2) for n in shape], indexing="ij")
    return np.ravel_multi_index([g.ravel(order="F") for g in grid], shape, order="F")


@dataclass
class Multigrid:
    """matrices from coarse to fine; points[k] are the fine points of level k + 1 that level k has."""

    matrices: list[Local]
    points: list[np.ndarray]

    def __call__(self, b: Vector) -> Vector:
        return self.cycle(b, len(self.matrices) - 1)

    def smooth(self, level: int, x: Vector, b: Vector) -> Vector:
        a = self.matrices[level]
        return a.relax(x, b) if len(np.unique(a.part)) > 1 else sweeps(a, np.array(x), np.asarray(b)).view(Vector)

    def cycle(self, b: Vector, level: int) -> Vector:
        a = self.matrices[level]
        x = self.smooth(level, a.zeros(), b)
        if level:
            at = self.points[level - 1]
            x[at] += self.cycle((b - a @ x)[at], level - 1)
            x = self.smooth(level, x, b)
        return x


def pc_setup(parts: int, levels: int, nx: int, ny: int, nz: int) -> tuple[Multigrid, Geometry, Vector]:
    """The preconditioner, the geometry and the finest right-hand side."""
    grid = near_cubic(parts)
    box, matrices, points, b = (nx, ny, nz), [], [], None
    for k in range(levels):
        shape = tuple(g * n for g, n in zip(grid, box, strict=True))
        a, rhs = build_local(shape, grid)
        b = rhs if b is None else b
        matrices.insert(0, a)
        if k + 1 < levels:
            points.insert(0, coarse_points(shape))
            box = tuple(n // 2 for n in box)
    geometry = Geometry(nx, ny, nz, *grid, [m.nnz() for m in matrices], [m.m for m in matrices])
    return Multigrid(matrices, points), geometry, b


@dataclass
class SparkMultigrid:
    """matrices and boxes from coarse to fine, on tables."""

    matrices: list[PSparseMatrix]
    shapes: list[tuple[int, int, int]]

    def __call__(self, b: PVector) -> PVector:
        return self.cycle(b, len(self.matrices) - 1)

    def smooth(self, level: int, x: PVector, b: PVector) -> PVector:
        return distributed.relax(self.matrices[level], x, b).cut()

    def restrict(self, v: PVector, level: int) -> PVector:
        """The values at every second point of each direction, on the level below."""
        at = ids.coordinates(F.col("gid"), self.shapes[level])
        odd = [c % 2 == 1 for c in at]
        coarse = ids.linear_id([ids.whole(c + 1, 2) for c in at], self.shapes[level - 1])
        return from_gvec(v.gvec().filter(odd[0] & odd[1] & odd[2]).select(coarse.alias("gid"), "v"), self.matrices[level - 1].rows)

    def prolongate(self, v: PVector, level: int) -> DataFrame:
        """(gid, v): the same values at the points of ``level``."""
        at = ids.coordinates(F.col("gid"), self.shapes[level - 1])
        return v.gvec().select(ids.linear_id([c * 2 - 1 for c in at], self.shapes[level]).alias("gid"), "v")

    def cycle(self, b: PVector, level: int) -> PVector:
        a = self.matrices[level]
        x = self.smooth(level, a.zeros(), b)
        if level:
            coarse = self.cycle(self.restrict(b.axpy(-1.0, a @ x), level).cut(), level - 1)
            x = x.axpy(1.0, from_gvec(self.prolongate(coarse, level), a.cols)).cut()
            x = self.smooth(level, x, b)
        return x


def spark_setup(spark: SparkSession, parts: int, levels: int, nx: int, ny: int, nz: int) -> tuple[SparkMultigrid, Geometry, PVector]:
    """``pc_setup`` on tables: nothing but sizes is on the driver."""
    grid = near_cubic(parts)
    box, matrices, shapes, b = (nx, ny, nz), [], [], None
    for k in range(levels):
        if k and any(n % 2 for n in box):
            raise ValueError("every direction must have an even number of points")
        box = tuple(n // 2 for n in box) if k else box
        shape = tuple(g * n for g, n in zip(grid, box, strict=True))
        coo, rhs, rows = gallery.hpcg_stencil(spark, shape, grid)
        matrices.insert(0, psparse(coo, rows, rows).cut())
        shapes.insert(0, shape)
        b = from_gvec(rhs, rows).cut() if b is None else b
    geometry = Geometry(nx, ny, nz, *grid, [m.nnz() for m in matrices], [math.prod(s) for s in shapes])
    return SparkMultigrid(matrices, shapes), geometry, b


def ref_cg(a, b, precondition, maxiter: int = ITERATIONS, tolerance: float = 0.0) -> tuple[Vector, list[float], dict[str, float]]:
    """The solution, residual norms over the first, and seconds by kind of step."""
    spent = {"total": 0.0, "dot": 0.0, "waxpby": 0.0, "spmv": 0.0, "mg": 0.0}
    began = time.perf_counter()

    def timed(kind, f, *args):
        t = time.perf_counter()
        out = f(*args)
        spent[kind] += time.perf_counter() - t
        return out

    x, r = a.zeros(), b
    norm0 = timed("dot", r.norm)
    norms: list[float] = []
    rho = p = None
    while len(norms) < maxiter and (not norms or norms[-1] > tolerance):
        z = timed("mg", precondition, r)
        rho, last = timed("dot", r.dot, z), rho
        p = z if p is None else timed("waxpby", lambda: z.axpy(rho / last, p).cut())
        q = timed("spmv", lambda: (a @ p).cut())
        alpha = rho / timed("dot", p.dot, q)
        x, r = timed("waxpby", lambda: x.axpy(alpha, p).cut()), timed("waxpby", lambda: r.axpy(-alpha, q).cut())
        norms.append(timed("dot", r.norm) / norm0)
    spent["total"] = time.perf_counter() - began
    return x, norms, spent


def flop_counts(geometry: Geometry, iterations: int) -> dict[str, float]:
    """Floating-point operations: dots and updates by rows, products and sweeps by entries."""
    rows, nnz = geometry.rows, geometry.nnz
    dots = (3 * iterations) * 2.0 * rows[-1]
    updates = (3 * iterations) * 2.0 * rows[-1]
    product_ = iterations * 2.0 * nnz[-1]
    mg = sum(iterations * (4.0 * n * (1 if k == 0 else 2) + (2.0 * n if k else 0.0)) for k, n in enumerate(nnz))
    return {"dot": dots, "waxpby": updates, "spmv": product_, "mg": mg, "total": dots + updates + product_ + mg}


def hpcg_benchmark(parts: int, nx: int, ny: int, nz: int, total_runtime: float = 60.0, iterations: int = ITERATIONS, levels: int = LEVELS, spark: SparkSession | None = None) -> dict:
    """Set-up, reference sets that fix the tolerance, optimised sets to it, then timed sets for the runtime.

    With a session everything runs on tables.
    """
    t = time.perf_counter()
    mg, geometry, b = pc_setup(parts, levels, nx, ny, nz) if spark is None else spark_setup(spark, parts, levels, nx, ny, nz)
    setup = time.perf_counter() - t
    a = mg.matrices[-1]
    _, norms, _ = ref_cg(a, b, mg, iterations)
    tolerance = norms[-1]
    _, opt, spent = ref_cg(a, b, mg, 10 * iterations, tolerance)
    sets = max(1, math.ceil(total_runtime / max(spent["total"], 1e-9))) if total_runtime > 0 else 0
    runs = [ref_cg(a, b, mg, len(opt))[2] for _ in range(sets)] or [spent]
    flops = flop_counts(geometry, len(opt))
    total = sum(r["total"] for r in runs)
    times = {k: {"max": max(r[k] for r in runs), "min": min(r[k] for r in runs), "avg": sum(r[k] for r in runs) / len(runs)} for k in runs[0]}
    return {
        "parts": parts,
        "equations": a.shape[0],
        "nonzeros": a.nnz(),
        "geometry": {"nx": nx, "ny": ny, "nz": nz, "npx": geometry.npx, "npy": geometry.npy, "npz": geometry.npz},
        "setup_seconds": setup,
        "ref_tolerance": tolerance,
        "opt_iterations": len(opt),
        "sets": len(runs),
        "seconds": times,
        "flops": {k: v * len(runs) for k, v in flops.items()},
        "gflops": {k: v * len(runs) / total / 1e9 for k, v in flops.items()},
        "gbytes_per_second": memory_bytes(geometry, len(opt)) * len(runs) / total / 1e9,
    }


def memory_bytes(geometry: Geometry, iterations: int) -> float:
    """Bytes read and written: entries with their columns, vectors once for each use."""
    rows, nnz = geometry.rows, geometry.nnz
    vectors = iterations * (3 * 2 + 3 * 3) * 8.0 * rows[-1]
    product_ = iterations * (12.0 * nnz[-1] + 16.0 * rows[-1])
    mg = sum(iterations * (2 if k else 1) * 2 * (12.0 * n + 16.0 * m) for k, (n, m) in enumerate(zip(nnz, rows, strict=True)))
    return vectors + product_ + mg


def report_results(result: dict, output_type: str = "json", path: str | None = None) -> str:
    """The report as JSON, as text, or nothing ("none"); written to a file when a path is given."""
    if output_type == "none":
        return ""
    if output_type == "json":
        out = json.dumps(result, indent=1)
    elif output_type == "txt":
        out = "\n".join(_lines(result, ""))
    else:
        raise ValueError("output_type: json, txt or none")
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(out)
    return out


def _lines(x: dict, indent: str):
    for k, v in x.items():
        if isinstance(v, dict):
            yield f"{indent}{k}:"
            yield from _lines(v, indent + "  ")
        else:
            yield f"{indent}{k}: {v}"


def report_table(spark: SparkSession, result: dict):
    """The report as one row of JSON."""
    return spark.createDataFrame([(report_results(result),)], "report string")
