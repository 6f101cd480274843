"""A second physical path for systems that fit one machine, and the kernels of a part.

The iterative solvers are written against ``@``, ``+``, ``*``, ``dot`` and a few
methods that both this path and the distributed one have. A part's kernels
(sweeps, aggregation, local solves) are also what grouped functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Vector(np.ndarray):
    """A numpy vector with the methods solvers use."""

    @staticmethod
    def of(values) -> Vector:
        return np.array(values, float).view(Vector)

    def norm(self, p: float = 2) -> float:
        return float(np.linalg.norm(np.asarray(self), p))

    def cut(self) -> Vector:
        return self

    def axpy(self, a: float, other: Vector) -> Vector:
        return self + a * other

    def dot(self, other) -> float:
        return float(np.dot(np.asarray(self), np.asarray(other)))

    def times(self, other: Vector) -> Vector:
        return self * other

    def over(self, other: Vector) -> Vector:
        return self / other


@dataclass
class Local:
    """A compressed-row matrix: ``ptr`` by row, ``col`` and ``val`` by entry; ``part`` of each row."""

    m: int
    n: int
    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray
    part: np.ndarray

    @staticmethod
    def of(i, j, v, m: int, n: int, part: np.ndarray | None = None) -> Local:
        """From 0-based triplets; repeated positions add up."""
        i, j, v = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(v, float)
        key, back = np.unique(i * max(n, 1) + j, return_inverse=True)
        val = np.bincount(back, v, len(key)) if len(key) else np.zeros(0)
        row = key // max(n, 1)
        ptr = np.searchsorted(row, np.arange(m + 1))
        return Local(m, n, ptr, key % max(n, 1), val, np.ones(m, np.int64) if part is None else np.asarray(part))

    @property
    def shape(self) -> tuple[int, int]:
        return self.m, self.n

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.m), np.diff(self.ptr))

    def nnz(self) -> int:
        return len(self.val)

    def __matmul__(self, other):
        if isinstance(other, Local):
            size = np.diff(other.ptr)[self.col]
            at = np.repeat(other.ptr[self.col] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            return Local.of(np.repeat(self.row(), size), other.col[at], np.repeat(self.val, size) * other.val[at], self.m, other.n, self.part)
        return np.bincount(self.row(), self.val * np.asarray(other)[self.col], self.m).view(Vector)

    def __mul__(self, a: float) -> Local:
        return Local(self.m, self.n, self.ptr, self.col, self.val * a, self.part)

    __rmul__ = __mul__

    def __add__(self, other: Local) -> Local:
        return Local.of(np.r_[self.row(), other.row()], np.r_[self.col, other.col], np.r_[self.val, other.val], self.m, self.n, self.part)

    def __sub__(self, other: Local) -> Local:
        return self + other * -1.0

    def identity_minus(self) -> Local:
        k = np.arange(self.m)
        return Local.of(k, k, np.ones(self.m), self.m, self.n, self.part) - self

    @property
    def T(self) -> Local:  # noqa: N802
        return Local.of(self.col, self.row(), self.val, self.n, self.m)

    def cut(self) -> Local:
        return self

    def diag(self) -> Vector:
        own = self.row() == self.col
        return np.bincount(self.col[own], self.val[own], self.m).view(Vector)

    def scale_rows(self, d) -> Local:
        return Local(self.m, self.n, self.ptr, self.col, self.val * np.asarray(d)[self.row()], self.part)

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.row(), self.col] = self.val
        return out

    def solve(self, b: Vector) -> Vector:
        return np.linalg.solve(self.dense(), np.asarray(b)).view(Vector)

    def own_blocks(self) -> Local:
        """Without entries between parts."""
        found = getattr(self, "own", None)
        if found is not None:
            return found
        row = self.row()
        same = self.part[row] == self.part[self.col]
        self.own = Local.of(row[same], self.col[same], self.val[same], self.m, self.n, self.part)
        return self.own

    def zeros(self) -> Vector:
        return np.zeros(self.n).view(Vector)

    def relax(self, x: Vector, b: Vector, sweep: str = "symmetric") -> Vector:
        """A Gauss-Seidel sweep in each part; values of other parts stay as they were."""
        old = np.asarray(x)
        own = self.own_blocks()
        outside = np.asarray(self @ old) - np.asarray(own @ old)
        return sweeps(own, np.array(old), np.asarray(b) - outside, sweep).view(Vector)

    def schwarz(self, r: Vector, local_solver=None) -> Vector:
        """Each part's own system solved for its part of ``r``."""
        out = np.zeros(self.m)
        own = self.own_blocks()
        for p in np.unique(self.part):
            rows = np.flatnonzero(self.part == p)
            out[rows] = (local_solver or solve_block)(own.take(rows), np.asarray(r)[rows])
        return out.view(Vector)

    def take(self, rows: np.ndarray) -> Local:
        """The square block of these rows and columns."""
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        row = self.row()
        keep = (place[row] >= 0) & (place[self.col] >= 0)
        return Local.of(place[row[keep]], place[self.col[keep]], self.val[keep], len(rows), len(rows), self.part[rows])

    def prolongator(self, epsilon: float) -> Local:
        """Zeros and ones from nodes to aggregates, which don't cross parts."""
        aggregate_of, part, first = np.full(self.m, -1), [], 0
        for p in np.unique(self.part):
            rows = np.flatnonzero(self.part == p)
            found, n = aggregate(self.take(rows), epsilon)
            aggregate_of[rows[found > 0]] = found[found > 0] - 1 + first
            part += [p] * n
            first += n
        nodes = np.flatnonzero(aggregate_of >= 0)
        out = Local.of(nodes, aggregate_of[nodes], np.ones(len(nodes)), self.m, first, self.part)
        out.coarse_part = np.array(part)
        return out

    def strength_graph(self, block_size: int, epsilon: float) -> Local:
        """Ones between nodes whose blocks are strong against the diagonal ones; itself for single unknowns."""
        if block_size == 1:
            return self
        n = self.m // block_size
        norms = Local.of(self.row() // block_size, self.col // block_size, self.val**2, n, n, self.part[::block_size])
        row, d = norms.row(), np.sqrt(np.asarray(norms.diag()))
        size = np.sqrt(norms.val)
        kept = (row == norms.col) | ((size > 0) & (size >= epsilon * np.sqrt(d[row] * d[norms.col])))
        return Local.of(row[kept], norms.col[kept], np.ones(kept.sum()), n, n, norms.part)

    def keeping(self, modes: np.ndarray, block_size: int, epsilon: float) -> tuple[Local, np.ndarray]:
        """A prolongator of aggregates of nodes that keeps ``modes`` (columns), and the coarse modes."""
        nodes = self.strength_graph(block_size, epsilon).prolongator(0.0)
        k = modes.shape[1]
        i, j, v, low = [], [], [], np.zeros((nodes.n * k, k))
        for g, own in enumerate(np.split(nodes.row()[np.argsort(nodes.col, kind="stable")], np.cumsum(np.bincount(nodes.col, minlength=nodes.n))[:-1])):
            rows = (own[:, None] * block_size + np.arange(block_size)).ravel()
            if len(rows) < k:
                raise ValueError("an aggregate has fewer unknowns than modes")
            q, r = np.linalg.qr(modes[rows])
            i.append(np.repeat(rows, k))
            j.append(np.tile(g * k + np.arange(k), len(rows)))
            v.append(q.ravel())
            low[g * k : (g + 1) * k] = r
        out = Local.of(np.concatenate(i), np.concatenate(j), np.concatenate(v), self.m, nodes.n * k, self.part)
        out.coarse_part = np.repeat(nodes.coarse_part, k)
        return out, low

    def galerkin(self, p: Local) -> Local:
        out = p.T @ (self @ p)
        out.part = getattr(p, "coarse_part", np.ones(out.m, np.int64))
        return out

    def smoothed(self, p0: Local, scaled: Local, omega: float) -> Local:
        """(I - omega scaled) p0."""
        out = p0 - (scaled @ p0) * omega
        out.coarse_part = p0.coarse_part
        return out

    def random(self, seed: int) -> Vector:
        return np.random.default_rng(seed).random(self.n).view(Vector)


def schedule(a: Local) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in groups that don't depend on each other, in an order in which sweeps give what row by row would.

    Of two coupled rows the one with the smaller number comes first. Each group
    has its rows, columns, values and where each row's entries begin.
    """
    found = getattr(a, "groups", None)
    if found is not None:
        return found
    row = a.row()
    low = np.concatenate([np.stack([row, a.col])[:, a.col < row], np.stack([a.col, row])[:, a.col > row]], axis=1)
    order = np.argsort(low[0], kind="stable")
    needs, starts = low[1][order], np.searchsorted(low[0][order], np.arange(a.m + 1)).tolist()
    level = [0] * a.m
    needed = needs.tolist()
    for i in range(a.m):
        s, e = starts[i], starts[i + 1]
        if e > s:
            level[i] = 1 + max(level[j] for j in needed[s:e])
    level = np.array(level, np.int64)
    found = []
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(level.max() + 2)) if a.m else [0]
    for s, e in zip(bounds, bounds[1:], strict=False):
        rows = by_level[s:e]
        size = a.ptr[rows + 1] - a.ptr[rows]
        at = np.repeat(a.ptr[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found.append((rows, a.col[at], a.val[at], np.cumsum(size) - size))
    a.groups = found
    return found


#: Rows up to which a part's system is solved by a dense factorisation.
DENSE_PART = 2_000


def solve_block(a: Local, b: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """A direct solve for few rows; beyond DENSE_PART, stabilised bi-conjugate gradients on the entries alone.

    Memory is in proportion to the entries. An error if the iterations don't converge.
    """
    if a.m <= DENSE_PART:
        return np.linalg.solve(a.dense(), b)
    d = np.asarray(a.diag())
    scale = 1 / np.where(d == 0, 1.0, d)
    x = np.zeros(a.m)
    r = np.array(b, float)
    first, size = r.copy(), float(np.linalg.norm(r))
    rho = alpha = omega = 1.0
    v, p = np.zeros(a.m), np.zeros(a.m)
    for _ in range(10 * a.m):
        if np.linalg.norm(r) <= tolerance * size:
            return x
        rho, last = float(first @ r), rho
        p = r + (rho / last) * (alpha / omega) * (p - omega * v)
        y = scale * p
        v = np.asarray(a @ y)
        alpha = rho / float(first @ v)
        s = r - alpha * v
        z = scale * s
        t = np.asarray(a @ z)
        omega = float(t @ s) / (float(t @ t) or 1.0)
        x += alpha * y + omega * z
        r = s - omega * t
        if omega == 0 or rho == 0:
            break
    if np.linalg.norm(np.asarray(a @ x) - b) <= 1e-8 * size:
        return x
    raise ValueError("a part's system didn't converge; give a local solver")


def sweeps(a: Local, x: np.ndarray, b: np.ndarray, sweep: str = "symmetric") -> np.ndarray:
    """x_i = (b_i - sum of a_ij x_j beside the diagonal) / a_ii, forwards, backwards or both."""
    if sweep not in ("symmetric", "forward", "backward"):
        raise ValueError("sweep: symmetric, forward or backward")
    d = np.asarray(a.diag())
    if (d == 0).any():
        raise ValueError("a row has no diagonal")
    ways = {"symmetric": (1, -1), "forward": (1,), "backward": (-1,)}[sweep]
    for way in ways:
        for rows, col, val, first in schedule(a)[::way]:
            x[rows] += (b[rows] - np.add.reduceat(val * x[col], first)) / d[rows]
    return x


def aggregate(a: Local, epsilon: float) -> tuple[np.ndarray, int]:
    """The aggregate (from 1) of each node, 0 for isolated ones, and the number of aggregates.

    First nodes whose strong neighbours are all free make aggregates; free nodes
    then join the most strongly coupled neighbouring aggregate of that pass; what
    is left makes aggregates with its free strong neighbours.
    """
    d = np.asarray(a.diag())
    if a.m == 1:
        return np.ones(1, np.int64), 1
    row = a.row()
    strong = (row != a.col) & (np.abs(a.val) > epsilon * np.sqrt(np.abs(d[row] * d[a.col])))
    near = [a.col[a.ptr[i] : a.ptr[i + 1]][strong[a.ptr[i] : a.ptr[i + 1]]] for i in range(a.m)]
    weight = [np.abs(a.val[a.ptr[i] : a.ptr[i + 1]][strong[a.ptr[i] : a.ptr[i + 1]]]) for i in range(a.m)]
    alone = np.bincount(row[row != a.col], minlength=a.m) == 0
    found, n = np.where(alone, -1, 0), 0
    for i in range(a.m):
        if found[i] == 0 and not found[near[i]].any():
            n += 1
            found[i] = n
            found[near[i]] = n
    before = found.copy()
    for i in range(a.m):
        if found[i] == 0:
            joined = before[near[i]] > 0
            if joined.any():
                best = np.where(joined, weight[i], 0.0)
                if best.max() > 0:
                    found[i] = before[near[i][int(best.argmax())]]
    for i in range(a.m):
        if found[i] == 0:
            n += 1
            found[i] = n
            found[near[i][before[near[i]] <= 0]] = n
    return np.maximum(found, 0), n


def localise(matrix, vector=None):
    """A distributed matrix (and vector) as a local one with the rows' parts; raises when it is too large."""
    entries = matrix.entries()
    owners = np.array([(r.gid, r.part) for r in matrix.rows.own().select("gid", "part").collect()], np.int64)
    part = np.ones(matrix.shape[0], np.int64)
    part[owners[:, 0] - 1] = owners[:, 1]
    a = Local.of(entries[:, 0] - 1, entries[:, 1] - 1, entries[:, 2], *matrix.shape, part)
    return a if vector is None else (a, Vector.of(vector.collect()))
