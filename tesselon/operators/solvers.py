"""Linear, nonlinear and time-stepping solvers as functional state machines.

A problem is an immutable record; ``update`` gives a new one. A solver is set up
for a problem and then stepped: state is None, then whatever the solver keeps,
until it says "stop". The code is the same for distributed and for local
matrices; distributed iterates are written to the checkpoint folder as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from . import distributed
from .local import Local, solve_block
from .matrix import PSparseMatrix
from .prange import trivial_partition
from .vector import PVector, pones, prand, pzeros

# -- what both kinds of matrices and vectors can do


def zeros_for(a):
    return a.zeros() if isinstance(a, Local) else pzeros(a.cols.remove_ghost())


def divide(x, d):
    return x.over(d) if not isinstance(x, PVector) else x.zip(d, lambda a, b: a / b)


def inverse(d):
    return 1.0 / d if not isinstance(d, PVector) else d.map(lambda v: 1 / v)


def relax(a, x, b, sweep: str):
    return a.relax(x, b, sweep) if isinstance(a, Local) else distributed.relax(a, x, b, sweep)


def schwarz(a, r, local_solver: Callable = solve_block):
    return a.schwarz(r, local_solver) if isinstance(a, Local) else distributed.schwarz(a, r, local_solver)


# -- problems


@dataclass(frozen=True)
class LinearProblem:
    solution: Any
    matrix: Any
    rhs: Any
    attributes: dict = field(default_factory=dict)

    @property
    def nullspace(self):
        return self.attributes.get("nullspace")

    def update(self, **changes) -> LinearProblem:
        return replace(self, **changes)


def linear_problem(solution, matrix, rhs, nullspace=None) -> LinearProblem:
    return LinearProblem(solution, matrix, rhs, {"nullspace": nullspace})


@dataclass(frozen=True)
class NonlinearProblem:
    """``statement(x)`` gives residual and jacobian."""

    statement: Callable
    solution: Any
    residual: Any = None
    jacobian: Any = None
    workspace: Any = None
    attributes: dict = field(default_factory=dict)

    def at(self, x) -> NonlinearProblem:
        r, j = self.statement(x)
        return replace(self, solution=x, residual=r, jacobian=j)

    update = LinearProblem.update


@dataclass(frozen=True)
class ODEProblem:
    """``statement(t, u, v, du, dv)`` gives F(t, u, v) and du * dF/du + dv * dF/dv."""

    statement: Callable
    solution: tuple
    interval: tuple[float, float]
    constant_jacobian: bool = False
    attributes: dict = field(default_factory=dict)

    update = LinearProblem.update


# -- the linear machine


@dataclass(frozen=True)
class LinearSolver:
    """setup(matrix, nullspace) -> workspace; step(x, workspace, b, state) -> x, state or "stop"."""

    problem: LinearProblem
    setup: Callable
    advance: Callable
    workspace: Any
    uses_initial_guess: bool = True

    def update(self, **changes) -> LinearSolver:
        """A new problem; the workspace is set up again only when the matrix changes."""
        problem = self.problem.update(**changes)
        ws = self.setup(problem.matrix, problem.nullspace) if "matrix" in changes else self.workspace
        return replace(self, problem=problem, workspace=ws)

    def step(self, state=None) -> tuple[LinearSolver, Any]:
        x, state = self.advance(self.problem.solution, self.workspace, self.problem.rhs, state)
        return replace(self, problem=self.problem.update(solution=x.cut())), state

    def history(self, f: Callable = lambda s: s) -> Iterator:
        solver, state = self, None
        while state != "stop":
            solver, state = solver.step(state)
            yield f(solver)

    def solve(self) -> LinearSolver:
        out = self
        for out in self.history():
            pass
        return out

    def apply(self, b, x=None, zero_guess: bool = False):
        """As a preconditioner: the solution for ``b``, from zero unless x is given."""
        if x is None or zero_guess:
            x = zeros_for(self.problem.matrix)
        return replace(self, problem=self.problem.update(rhs=b, solution=x)).solve().problem.solution


def linear_solver(problem: LinearProblem, setup: Callable, advance: Callable, uses_initial_guess: bool = True) -> LinearSolver:
    return LinearSolver(problem, setup, advance, setup(problem.matrix, problem.nullspace), uses_initial_guess)


def preconditioner(make: Callable, problem: LinearProblem) -> Callable:
    """b -> approximate solution."""
    return make(problem).apply


def lu(problem: LinearProblem) -> LinearSolver:
    """A direct solve, guarded by size."""
    return linear_solver(problem, lambda a, _: a, lambda x, a, b, state: (a.solve(b), "stop"), False)


def identity_solver(problem: LinearProblem) -> LinearSolver:
    return linear_solver(problem, lambda a, _: None, lambda x, ws, b, state: (b, "stop"), False)


def jacobi_correction(problem: LinearProblem) -> LinearSolver:
    return linear_solver(problem, lambda a, _: a.diag().cut(), lambda x, d, b, state: (divide(b, d), "stop"), False)


def richardson(problem: LinearProblem, make: Callable = identity_solver, iterations: int = 10, omega: float = 1.0, update_p: Callable | None = None) -> LinearSolver:
    """x - omega P(A x - b), a given number of times.

    When the matrix changes, P is made anew, or becomes ``update_p(P, problem)``.
    """
    made: list[LinearSolver] = []

    def setup(a, nullspace):
        own = problem.update(matrix=a)
        made.append(update_p(made[-1], own) if update_p and made else make(own))
        return a, made[-1]

    def advance(x, ws, b, state):
        a, p = ws
        done = (state or 0) + 1
        r = (a @ x).axpy(-1.0, b)
        return x.axpy(-omega, p.apply(r)), "stop" if done >= iterations else done

    return linear_solver(problem, setup, advance)


def jacobi(problem: LinearProblem, iterations: int = 10, omega: float = 1.0) -> LinearSolver:
    return richardson(problem, jacobi_correction, iterations, omega)


def gauss_seidel(problem: LinearProblem, iterations: int = 1, sweep: str = "symmetric") -> LinearSolver:
    """Sweeps within parts; what parts see of each other is renewed once an iteration."""

    def advance(x, a, b, state):
        done = (state or 0) + 1
        return relax(a, x, b, sweep), "stop" if done >= iterations else done

    return linear_solver(problem, lambda a, _: a, advance)


def additive_schwarz_correction(problem: LinearProblem, local_solver: Callable = solve_block) -> LinearSolver:
    """Each part's own system solved by ``local_solver(block, right-hand side)``."""
    return linear_solver(problem, lambda a, _: a, lambda x, a, b, state: (schwarz(a, b, local_solver), "stop"), False)


def additive_schwarz(problem: LinearProblem, iterations: int = 1, local_solver: Callable = solve_block) -> LinearSolver:
    return richardson(problem, lambda p: additive_schwarz_correction(p, local_solver), iterations)


@dataclass
class CGState:
    r: Any
    p: Any
    rho: float
    norm0: float
    iteration: int
    norms: list[float]


def cg(problem: LinearProblem, precondition: Callable | None = None, tolerance: float = 1e-10, maxiter: int = 1000) -> LinearSolver:
    """Preconditioned conjugate gradients until the residual is ``tolerance`` of the first."""
    apply = precondition or (lambda r: r)

    def advance(x, a, b, state):
        if state is None:
            r = b.axpy(-1.0, a @ x).cut()
            z = apply(r).cut()
            state = CGState(r, z, r.dot(z), r.norm(), 0, [])
            if state.norm0 == 0:
                return x, "stop"
        q = (a @ state.p).cut()
        alpha = state.rho / state.p.dot(q)
        x = x.axpy(alpha, state.p)
        r = state.r.axpy(-alpha, q).cut()
        z = apply(r).cut() if precondition else r
        rho, norm = r.dot(z), r.norm()
        p = z.axpy(rho / state.rho, state.p).cut()
        norms = [*state.norms, norm / state.norm0]
        if norm <= tolerance * state.norm0 or len(norms) >= maxiter:
            return x, "stop"
        return x, CGState(r, p, rho, state.norm0, state.iteration + 1, norms)

    return linear_solver(problem, lambda a, _: a, advance)


def default_solver(problem):
    return lu(problem) if isinstance(problem, LinearProblem) else newton_raphson(problem)


# -- multigrid by smoothed aggregation


def spectral_radius(a, x, iterations: int) -> float:
    """Power iterations and a Rayleigh quotient."""
    for _ in range(iterations):
        y = (a @ x).cut()
        x = (y * (1 / y.norm())).cut()
    return abs((a @ x).dot(x) / x.dot(x))


def omega_for_1d_laplace(scaled) -> float:
    return 2 / 3


def lambda_generic(scaled, iterations: int = 20, seed: int = 1) -> float:
    """4/3 over the spectral radius of D^-1 A."""
    x = scaled.random(seed) if isinstance(scaled, Local) else prand(scaled.cols.remove_ghost(), seed)
    return (4 / 3) / spectral_radius(scaled, x, iterations)


@dataclass(frozen=True)
class Coarsening:
    """Smoothed aggregation: epsilon of strong couplings, damping, and below how many rows a level moves to one part."""

    epsilon: float = 0.0
    omega: Callable = omega_for_1d_laplace
    repartition_threshold: int = 2000

    def __call__(self, a, modes=None) -> tuple[Any, Any, Any]:
        """The prolongator, the coarse matrix and its modes (constants have none)."""
        scaled = a.scale_rows(inverse(a.diag())).cut()
        omega = self.omega(scaled)
        if isinstance(a, Local):
            p = a.smoothed(a.prolongator(self.epsilon), scaled, omega)
            coarse = a.galerkin(p)
            if coarse.m <= self.repartition_threshold:
                coarse.part = coarse.part * 0 + 1
            return p, coarse, None
        found, coarse_rows = distributed.aggregates(a, self.epsilon)
        p0 = distributed.constant_prolongator(found, coarse_rows, a.rows.remove_ghost()).cut()
        p = (p0 - (scaled @ p0) * omega).cut()
        coarse = (a @ p).cut()
        coarse = p.spmtm(coarse).cut()
        if coarse.rows.n <= self.repartition_threshold:
            one = trivial_partition(a.df.sparkSession, a.rows.parts, coarse.rows.n)
            coarse = coarse.repartition(one, one)
            p = PSparseMatrix(p.df, p.rows, one)
        return p, coarse, None


smoothed_aggregation = Coarsening


@dataclass(frozen=True)
class BlockCoarsening:
    """Smoothed aggregation of nodes with several unknowns that keeps given modes.

    Modes are an array of columns on the local path and a table (gid, b1, ...) on
    the distributed one. A coarse node has as many unknowns as there are modes.
    """

    block_size: int
    epsilon: float = 0.0
    omega: Callable = None

    def __call__(self, a, modes) -> tuple[Any, Any, Any]:
        """The prolongator, the coarse matrix and its modes."""
        omega = self.omega or lambda_generic
        scaled = a.scale_rows(inverse(a.diag())).cut()
        if isinstance(a, Local):
            # Below the finest level a node has as many unknowns as modes.
            size = self.block_size if a.m % modes.shape[1] or not getattr(a, "coarse", False) else modes.shape[1]
            p0, low = a.keeping(modes, size, self.epsilon)
            p = a.smoothed(p0, scaled, omega(scaled))
            coarse = a.galerkin(p)
            coarse.coarse = True
            return p, coarse, low
        size = self.block_size if not isinstance(modes, tuple) else modes[1]
        table = modes if not isinstance(modes, tuple) else modes[0]
        graph = distributed.strength_graph(a.triplets(), size, self.epsilon)
        nodes = a.rows.remove_ghost() if size == 1 else distributed.node_partition(a.rows, size)
        found, coarse_rows = distributed.aggregates(PSparseMatrix(graph, nodes, nodes), 0.0)
        p0, low = distributed.tentative_prolongator(found, coarse_rows, a.rows.remove_ghost(), table, size)
        p = (p0 - (scaled @ p0) * omega(scaled)).cut()
        coarse = p.spmtm((a @ p).cut()).cut()
        return p, coarse, (distributed.wide_modes(low), len(table.columns) - 1)


@dataclass(frozen=True)
class LevelParams:
    pre: Callable = additive_schwarz
    post: Callable | None = None
    coarsening: Callable = Coarsening()
    visits: int = 1  # 1: V cycle, 2: W cycle


@dataclass
class Level:
    matrix: Any
    prolongator: Any
    restrictor: Any
    pre: LinearSolver
    post: LinearSolver
    visits: int


@dataclass
class Hierarchy:
    levels: list[Level]
    coarse: Any
    coarse_solver: LinearSolver


def amg_level_params_linear_elasticity(block_size: int, epsilon: float = 0.0) -> LevelParams:
    return LevelParams(pre=lambda p: gauss_seidel(p, 1), coarsening=BlockCoarsening(block_size, epsilon))


def amg_fine_params(params: LevelParams = LevelParams(), levels: int = 6) -> list[LevelParams]:
    return [params] * levels


def amg_setup(a, params: list[LevelParams], coarse_size: int = 10, coarse_solver: Callable = lu, modes=None) -> Hierarchy:
    levels: list[Level] = []
    for p in params:
        x = zeros_for(a)
        problem = linear_problem(x, a, x)
        pre = p.pre(problem)
        post = pre if p.post is None else p.post(problem)
        prolongator, coarse, modes = p.coarsening(a, modes)
        levels.append(Level(a, prolongator, prolongator.T, pre, post, p.visits))
        a = coarse
        if a.shape[0] <= coarse_size:
            break
    x = zeros_for(a)
    return Hierarchy(levels, a, coarse_solver(linear_problem(x, a, x)))


def amg_cycle(h: Hierarchy, x, b, level: int = 0):
    """Smooth, correct from the coarser level, smooth."""
    if level == len(h.levels):
        return h.coarse_solver.apply(b)
    own = h.levels[level]
    x = own.pre.apply(b, x).cut()
    rc = (own.restrictor @ b.axpy(-1.0, own.matrix @ x)).cut()
    e = zeros_for(h.coarse if level + 1 == len(h.levels) else h.levels[level + 1].matrix)
    for _ in range(own.visits):
        e = amg_cycle(h, e, rc, level + 1).cut()
    x = (x + own.prolongator @ e).cut()
    return own.post.apply(b, x)


def amg(problem: LinearProblem, params: list[LevelParams] | None = None, coarse_size: int = 10, coarse_solver: Callable = lu) -> LinearSolver:
    """One cycle for each solve; a new matrix sets the hierarchy up again."""

    def setup(a, nullspace):
        return amg_setup(a, params or amg_fine_params(), coarse_size, coarse_solver, nullspace)

    return linear_solver(problem, setup, lambda x, h, b, state: (amg_cycle(h, x, b), "stop"))


def amg_statistics(solver: LinearSolver) -> list[dict[str, float]]:
    """Rows and entries of each level, their shares, and the two complexities."""
    h: Hierarchy = solver.workspace
    matrices = [lv.matrix for lv in h.levels] + [h.coarse]
    rows, nnz = [m.shape[0] for m in matrices], [m.nnz() for m in matrices]
    return [
        {
            "level": k + 1,
            "unknowns": rows[k],
            "unknowns_rel": rows[k] / sum(rows),
            "nonzeros": nnz[k],
            "nonzeros_rel": nnz[k] / sum(nnz),
            "operator_complexity": sum(nnz) / nnz[0],
            "grid_complexity": sum(rows) / rows[0],
        }
        for k in range(len(rows))
    ]


def default_nullspace(a) -> list:
    """The constant vector."""
    return [a.zeros() + 1.0] if isinstance(a, Local) else [pones(a.cols.remove_ghost())]


# -- nonlinear problems and time


@dataclass(frozen=True)
class NewtonState:
    iteration: int
    residual_loss: float
    solution_loss: float


def _largest(x) -> float:
    return abs(float(x)) if not hasattr(x, "norm") else x.norm(float("inf"))


def _solve_linear(j, r, solver: Callable):
    if not hasattr(j, "diag"):
        return r / j  # a scalar equation
    return solver(linear_problem(zeros_for(j), j, r)).solve().problem.solution


def _minus(x, dx):
    return x.axpy(-1.0, dx) if hasattr(x, "axpy") else x - dx


def _cut(x):
    return x.cut() if hasattr(x, "cut") else x


@dataclass(frozen=True)
class NewtonRaphson:
    """x - J^-1 r until residual or step is small; largest absolute values count."""

    problem: NonlinearProblem
    solver: Callable = lu
    iterations: int = 1000
    residual_tol: float = 1e-8
    solution_tol: float = 0.0
    verbose: bool = False
    output_prefix: str = ""
    state: NewtonState | None = None

    def update(self, **changes) -> NewtonRaphson:
        return replace(self, problem=self.problem.update(**changes))

    def step(self, state: NewtonState | str | None = None) -> tuple[NewtonRaphson, NewtonState | str]:
        p = self.problem if state is not None else self.problem.at(self.problem.solution)
        dx = _solve_linear(p.jacobian, p.residual, self.solver)
        p = p.at(_cut(_minus(p.solution, dx)))  # else each task repeats the joins of all steps so far
        done = NewtonState((state.iteration if state else 0) + 1, _largest(p.residual), _largest(dx))
        if self.verbose:
            print(f"{self.output_prefix}{done.iteration:>6} {done.residual_loss:.3e} {done.solution_loss:.3e}")
        over = done.iteration >= self.iterations or done.residual_loss <= self.residual_tol or done.solution_loss <= self.solution_tol
        return replace(self, problem=p, state=done), "stop" if over else done

    history, solve = LinearSolver.history, LinearSolver.solve


def newton_raphson(problem: NonlinearProblem, **options) -> NewtonRaphson:
    return NewtonRaphson(problem, **options)


@dataclass(frozen=True)
class TrustRegion:
    """Dogleg steps within a trust radius, for starts from which plain Newton steps lead away.

    A step is the Newton step where that lies within the radius, else a point of
    the way from the steepest descent to it. The radius doubles after good steps at
    its edge and shrinks after poor ones, which aren't taken.
    """

    problem: NonlinearProblem
    solver: Callable = lu
    iterations: int = 1000
    residual_tol: float = 1e-8
    radius: float | None = None
    state: NewtonState | None = None

    def update(self, **changes) -> TrustRegion:
        return replace(self, problem=self.problem.update(**changes))

    def step(self, state: NewtonState | str | None = None) -> tuple[TrustRegion, NewtonState | str]:
        p = self.problem if state is not None else self.problem.at(self.problem.solution)
        r, j = p.residual, p.jacobian
        newton = _solve_linear(j, r, self.solver)
        gradient = _times(_transposed(j), r)
        image = _times(j, gradient)
        size2, image2 = _dot(gradient, gradient), _dot(image, image)
        cauchy = gradient * (size2 / image2) if image2 else newton
        radius = self.radius if self.radius is not None else max(1.0, _dot(p.solution, p.solution) ** 0.5)
        step = newton
        if _dot(newton, newton) ** 0.5 > radius:
            long = _dot(cauchy, cauchy) ** 0.5
            if long >= radius:
                step = cauchy * (radius / long)
            else:
                way = _minus(newton, cauchy)
                a, b, c = _dot(way, way), 2 * _dot(cauchy, way), long**2 - radius**2
                step = _plus(cauchy, way * ((-b + (b * b - 4 * a * c) ** 0.5) / (2 * a)))
        tried = p.at(_cut(_minus(p.solution, step)))
        before = _dot(r, r)
        expected = before - _dot(left := _minus(r, _times(j, step)), left)
        gain = (before - _dot(tried.residual, tried.residual)) / expected if expected > 0 else 1.0
        taken, long = gain > 1e-4, _dot(step, step) ** 0.5
        radius = 2 * radius if gain > 0.75 and long >= 0.99 * radius else radius / 2 if gain < 0.25 else radius
        p = tried if taken else p
        done = NewtonState((state.iteration if state else 0) + 1, _largest(p.residual), _largest(step))
        over = done.iteration >= self.iterations or done.residual_loss <= self.residual_tol
        return replace(self, problem=p, radius=radius, state=done), "stop" if over else done

    history, solve = LinearSolver.history, LinearSolver.solve


def trust_region(problem: NonlinearProblem, **options) -> TrustRegion:
    return TrustRegion(problem, **options)


def _dot(a, b) -> float:
    return a.dot(b) if hasattr(a, "dot") else float(a * b)


def _plus(a, b):
    return a.axpy(1.0, b) if hasattr(a, "axpy") else a + b


def _times(j, x):
    return j @ x if hasattr(j, "diag") else j * x


def _transposed(j):
    return j.T if hasattr(j, "diag") else j


def nonlinear_problem(statement: Callable, solution, workspace=None) -> NonlinearProblem:
    return NonlinearProblem(statement, solution, workspace=workspace)


def ode_problem(statement: Callable, solution: tuple, interval: tuple[float, float], constant_jacobian: bool = False) -> ODEProblem:
    return ODEProblem(statement, solution, interval, constant_jacobian)


@dataclass(frozen=True)
class BackwardEuler:
    """v = (x - u0) / dt, solved for x at the end of each step; dt defaults to a tenth of the interval."""

    problem: ODEProblem
    dt: float | None = None
    solver: Callable = newton_raphson

    def step(self, state=None) -> tuple[BackwardEuler, Any]:
        t, u0, _ = self.problem.solution
        end = self.problem.interval[1]
        dt = self.dt if self.dt is not None else (end - self.problem.interval[0]) / 10
        t = t + dt

        def stage(x):
            v = _minus(x, u0) * (1 / dt) if hasattr(x, "axpy") else (x - u0) / dt
            return self.problem.statement(t, x, v, 1.0, 1.0 / dt)

        x = self.solver(nonlinear_problem(stage, u0)).solve().problem.solution
        v = _minus(x, u0) * (1 / dt) if hasattr(x, "axpy") else (x - u0) / dt
        done = t >= end or abs(t - end) <= 1e-8 * max(abs(t), abs(end))
        return replace(self, problem=self.problem.update(solution=(t, x, v))), "stop" if done else t

    history, solve = LinearSolver.history, LinearSolver.solve


def backward_euler(problem: ODEProblem, **options) -> BackwardEuler:
    return BackwardEuler(problem, **options)
