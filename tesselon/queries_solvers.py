"""Registered queries of the sequential kernels and solvers, with SQL that steps through the same algorithms.

The SQL keeps vectors as lists and goes row by row (sweeps, aggregation) or column
by column (elimination) in recursive tables, so it shares nothing with the kernels.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .operators import distributed, hpcg, solvers
from .operators.matrix import psparse, sparse_diag_matrix
from .operators.vector import pfill
from .queries import _A8, _B8, _BOTH, _ONES8, _solved, query, small_system, two_vectors
from .sources import gallery

_PART8 = "1 + ((gid - 1) % 8) // 4 + 2 * ((gid - 1) // 32)"


def rows_sql(name: str, a: str, part: str) -> str:
    """A table of dense rows: the diagonal, entries beside it in the own part, entries of other parts, and all."""
    return f"""
{name}_e AS MATERIALIZED ({a}),
{name}_p AS MATERIALIZED (SELECT gid, {part} AS part FROM (SELECT DISTINCT gi AS gid FROM {name}_e)),
{name} AS MATERIALIZED (
  SELECT r.gid AS i, max(CASE WHEN c.gid = r.gid THEN v END) AS d,
         list(CASE WHEN c.part = r.part AND c.gid <> r.gid THEN coalesce(v, 0.0::DOUBLE) ELSE 0.0::DOUBLE END ORDER BY c.gid) AS own,
         list(CASE WHEN c.part <> r.part THEN coalesce(v, 0.0::DOUBLE) ELSE 0.0::DOUBLE END ORDER BY c.gid) AS ghost,
         list(coalesce(v, 0.0::DOUBLE) ORDER BY c.gid) AS full_row
  FROM {name}_p r CROSS JOIN {name}_p c LEFT JOIN {name}_e ON gi = r.gid AND gj = c.gid GROUP BY r.gid)"""


def product_sql(m: str, x: str) -> str:
    """The list of a matrix times a list."""
    return f"(SELECT list(list_inner_product(full_row, {x}) ORDER BY i) FROM {m})"


def sweeps_sql(name: str, m: str, n: int, x0: str, b: str, iterations: int = 1) -> str:
    """One row with ``x``: forward and backward sweeps, other parts' values renewed once an iteration."""
    both, total = 2 * n, 2 * n * iterations
    return f"""
{name}_s AS (
  SELECT 0 AS k, {x0} AS x, {x0} AS old
  UNION ALL
  SELECT s.k + 1, list_concat(s.x[1:m.i - 1], [({b}[m.i] - list_inner_product(m.own, s.x) - list_inner_product(m.ghost, s.old)) / m.d], s.x[m.i + 1:]), s.old
  FROM (SELECT k, x, CASE WHEN k % {both} = 0 THEN x ELSE old END AS old FROM {name}_s WHERE k < {total}) s
  JOIN {m} m ON m.i = CASE WHEN s.k % {both} < {n} THEN s.k % {both} + 1 ELSE {both} - s.k % {both} END),
{name} AS MATERIALIZED (SELECT x FROM {name}_s WHERE k = {total})"""


def solve_sql(name: str, n: int, matrix: str, b: str) -> str:
    """One row with ``x``: the solution by elimination; ``matrix`` is the list of rows."""
    return f"""
{name}_s AS (
  SELECT 1 AS k, list_transform(range(1, {n + 1}), lambda i: list_concat(g.a[i], [g.b[i]])) AS w FROM (SELECT {matrix} AS a, {b} AS b) g
  UNION ALL
  SELECT k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k THEN list_transform(w[k], lambda v: v / w[k][k])
    ELSE list_transform(range(1, {n + 2}), lambda j: w[i][j] - w[i][k] * w[k][j] / w[k][k]) END)
  FROM {name}_s WHERE k <= {n}),
{name} AS MATERIALIZED (SELECT list_transform(w, lambda r: r[{n + 1}]) AS x FROM {name}_s WHERE k = {n + 1})"""


_SYSTEM8 = f"WITH RECURSIVE {rows_sql('m', _A8, _PART8)}, b AS MATERIALIZED (SELECT list(v ORDER BY gid) AS x FROM ({_B8})), zeros AS (SELECT list_transform(range(0, 64), lambda i: 0.0::DOUBLE) AS x)"
_GS8 = sweeps_sql("gs", "m", 64, "(SELECT x FROM zeros)", "(SELECT x FROM b)", 3)


@query("gs_fdm", f"{_SYSTEM8}, {_GS8} SELECT gid, round(x[gid], 5) AS v FROM gs, range(1, 65) t(gid)")
def gs_fdm(spark, sf):
    return _solved(spark, lambda p: solvers.gauss_seidel(p, 3))


_BLOCK8 = "(SELECT list(list_concat(own[1:i - 1], [d], own[i + 1:]) ORDER BY i) FROM m)"
_REST8 = f"rest AS MATERIALIZED (SELECT list_transform(range(1, 65), lambda i: b.x[i] - ax.x[i]) AS x FROM b, (SELECT {product_sql('m', '(SELECT x FROM one)')} AS x) ax)"


@query("schwarz_fdm", f"{_SYSTEM8}, {solve_sql('one', 64, _BLOCK8, '(SELECT x FROM b)')}, {_REST8}, {solve_sql('two', 64, _BLOCK8, '(SELECT x FROM rest)')} SELECT gid, round(one.x[gid] + two.x[gid], 5) AS v FROM one, two, range(1, 65) t(gid)")
def schwarz_fdm(spark, sf):
    return _solved(spark, lambda p: solvers.additive_schwarz(p, 2))


_AGGREGATE = f"""WITH RECURSIVE {rows_sql('m', _A8, _PART8)},
near AS MATERIALIZED (SELECT i, list_filter(range(1, 65), lambda j: own[j] <> 0) AS near FROM m),
st AS MATERIALIZED (SELECT row_number() OVER (ORDER BY part, phase, gid) AS k, phase, gid AS i, row_number() OVER (PARTITION BY part, phase ORDER BY gid) = 1 AS first FROM m_p, range(1, 4) t(phase)),
s AS (
  SELECT 0::BIGINT AS k, list_transform(range(0, 64), lambda j: 0::BIGINT) AS f, list_transform(range(0, 64), lambda j: 0::BIGINT) AS bf, 0::BIGINT AS n
  UNION ALL
  SELECT k, list_transform(range(1, 65), lambda j: CASE WHEN make AND (j = i OR (list_contains(near, j) AND (phase = 1 OR bf[j] <= 0))) THEN n + 1
      WHEN phase = 2 AND j = i AND f[i] = 0 AND target IS NOT NULL THEN bf[target] ELSE f[j] END), bf, CASE WHEN make THEN n + 1 ELSE n END
  FROM (
    SELECT *, CASE phase WHEN 1 THEN f[i] = 0 AND list_sum(list_transform(near, lambda j: f[j])) = 0 WHEN 3 THEN f[i] = 0 ELSE false END AS make, list_filter(near, lambda j: bf[j] > 0)[1] AS target
    FROM (SELECT st.k, st.phase, st.i, near.near, s.f, CASE WHEN st.phase = 2 AND st.first THEN s.f ELSE s.bf END AS bf, s.n FROM s JOIN st ON st.k = s.k + 1 JOIN near ON near.i = st.i)))
SELECT CAST(part AS INTEGER) AS part, gid, f[gid] AS agg FROM s, m_p WHERE k = 192 AND f[gid] > 0"""


@query("aggregate", _AGGREGATE)
def aggregate(spark, sf):
    return distributed.aggregates(small_system(spark)[0])[0]


@query("nodes_in_aggregates", f"SELECT agg, count(*) AS nodes, min(gid) AS least, max(gid) AS largest FROM ({_AGGREGATE}) GROUP BY agg")
def nodes_in_aggregates(spark, sf):
    found = distributed.nodes_in_aggregates(distributed.aggregates(small_system(spark)[0])[0])
    return found.select("agg", F.size("nodes").cast("long").alias("nodes"), F.array_min("nodes").alias("least"), F.array_max("nodes").alias("largest"))


_SMOOTHED = f"SELECT a.gi, p.agg AS gj, sum(CASE WHEN a.gi = a.gj THEN 1 - 2 / 3.0::DOUBLE ELSE -2 / 3.0::DOUBLE * a.v / 4 END) AS v FROM ({_A8}) a JOIN ({_AGGREGATE}) p ON p.gid = a.gj GROUP BY 1, 2"


def _coarsened(spark):
    a, _ = small_system(spark)
    return solvers.Coarsening(repartition_threshold=0)(a)


@query("constant_prolongator", f"SELECT gid AS gi, agg AS gj, 1.0::DOUBLE AS v FROM ({_AGGREGATE})")
def constant_prolongator(spark, sf):
    a, _ = small_system(spark)
    found, coarse = distributed.aggregates(a)
    return distributed.constant_prolongator(found, coarse, a.rows).df


@query("smoothed_prolongator", f"SELECT gi, gj, round(v, 9) + 0.0 AS v FROM ({_SMOOTHED})")
def smoothed_prolongator(spark, sf):
    return _coarsened(spark)[0].df.select("gi", "gj", (F.round("v", 9) + 0.0).alias("v"))


@query("galerkin_coarse", f"SELECT p.gj AS gi, q.gj AS gj, round(sum(p.v * a.v * q.v), 9) + 0.0 AS v FROM ({_SMOOTHED}) p JOIN ({_A8}) a ON a.gi = p.gi JOIN ({_SMOOTHED}) q ON q.gi = a.gj GROUP BY 1, 2")
def galerkin_coarse(spark, sf):
    return _coarsened(spark)[1].df.select("gi", "gj", (F.round("v", 9) + 0.0).alias("v"))


_NODE_MODES = "SELECT gid, 1.0::DOUBLE AS b1, CAST((gid - 1) % 8 + 1 AS DOUBLE) AS b2 FROM range(1, 65) t(gid)"


@query("tentative_prolongator", f"SELECT gid, round(b1, 7) AS b1, round(b2, 7) AS b2 FROM ({_NODE_MODES})")
def tentative_prolongator(spark, sf):
    """The prolongator times the coarse modes gives the modes back."""
    a, _ = small_system(spark)
    found, coarse = distributed.aggregates(a)
    modes = a.rows.own().select("gid", F.lit(1.0).alias("b1"), F.pmod(F.col("gid") - 1, F.lit(8)).cast("double").alias("b2")).withColumn("b2", F.col("b2") + 1)
    p, low = distributed.tentative_prolongator(found, coarse, a.rows, modes)
    wide = distributed.wide_modes(low)
    joined = p.df.join(wide.withColumnRenamed("gid", "gj"), "gj").groupBy(F.col("gi").alias("gid"))
    return joined.agg(*[F.round(F.sum(F.col("v") * F.col(c)), 7).alias(c) for c in ("b1", "b2")])


@query("amg_fdm", _ONES8)
def amg_fdm(spark, sf):
    """Conjugate gradients preconditioned by a multigrid cycle."""
    params = solvers.amg_fine_params(solvers.LevelParams(pre=lambda p: solvers.jacobi(p, 1, 2 / 3)), 2)
    return _solved(spark, lambda p: solvers.cg(p, solvers.preconditioner(lambda q: solvers.amg(q, params), p), 1e-8))


@query("amg_statistics", f"SELECT level, unknowns, nonzeros FROM (SELECT 1 AS level, 64 AS unknowns, (SELECT count(*) FROM ({_A8})) AS nonzeros UNION ALL SELECT 2, (SELECT max(agg) FROM ({_AGGREGATE})), (SELECT count(*) FROM (SELECT DISTINCT p.gj, q.gj FROM ({_SMOOTHED}) p JOIN ({_A8}) a ON a.gi = p.gi JOIN ({_SMOOTHED}) q ON q.gi = a.gj) t))")
def amg_statistics(spark, sf):
    a, b = small_system(spark)
    params = [solvers.LevelParams(pre=lambda p: solvers.jacobi(p, 1, 2 / 3))]
    found = solvers.amg_statistics(solvers.amg(solvers.linear_problem(solvers.zeros_for(a), a, b), params))
    return spark.createDataFrame([(r["level"], int(r["unknowns"]), int(r["nonzeros"])) for r in found], "level int, unknowns long, nonzeros long")


@query("preconditioned_cg", _ONES8)
def preconditioned_cg(spark, sf):
    return _solved(spark, lambda p: solvers.cg(p, solvers.preconditioner(solvers.jacobi_correction, p), 1e-9))


@query("identity_solver", f"SELECT gid, v FROM ({_B8})")
def identity_solver(spark, sf):
    return _solved(spark, solvers.identity_solver)


@query("default_solver", _ONES8)
def default_solver(spark, sf):
    return _solved(spark, solvers.default_solver)


@query("solver_update", "SELECT gid, 0.5::DOUBLE AS v FROM range(1, 65) t(gid)")
def solver_update(spark, sf):
    """The solver of a system after its matrix has been doubled."""
    return _solved(spark, lambda p: solvers.lu(p).update(matrix=p.matrix * 2.0))


@query("default_nullspace", _ONES8)
def default_nullspace(spark, sf):
    return solvers.default_nullspace(small_system(spark)[0])[0].gvec()


@query("richardson_history", "SELECT k, round(1 - pow(0.5::DOUBLE, k), 9) AS largest FROM range(1, 6) t(k)")
def richardson_history(spark, sf):
    """The largest entry after each half step towards ones under the identity matrix."""
    rows = small_system(spark)[0].rows
    ones = pfill(1.0, rows)
    eye = sparse_diag_matrix(ones)
    solver = solvers.richardson(solvers.linear_problem(solvers.zeros_for(eye), eye, ones), iterations=5, omega=0.5)
    found = [s.problem.solution.norm(float("inf")) for s in solver.history()]
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(found)], "k long, largest double").select("k", F.round("largest", 9).alias("largest"))


# -- nonlinear problems and time, over distributed vectors


@query("newton_vector", f"SELECT gid, round(sqrt(v), 6) AS v FROM ({_BOTH})")
def newton_vector(spark, sf):
    """Square roots of all balances by Newton steps with a diagonal Jacobian."""
    c = two_vectors(spark, sf)[0].cut()

    def statement(x):
        return x.zip(c, lambda a, b: a * a - b), sparse_diag_matrix(x * 2.0)

    found = solvers.newton_raphson(solvers.nonlinear_problem(statement, c), solver=solvers.jacobi_correction, residual_tol=1e-9, iterations=40)
    state, last = None, found
    while state != "stop":
        last, state = last.step(state)
        last = last.update(solution=last.problem.solution.cut())
        last = last.update(residual=last.problem.statement(last.problem.solution)[0].cut(), jacobian=last.problem.statement(last.problem.solution)[1].cut())
    return last.problem.solution.gvec().select("gid", F.round("v", 6).alias("v"))


@query("trust_region_scalar", "SELECT round(sqrt(2.0::DOUBLE), 7) AS root, 0.0::DOUBLE AS arc")
def trust_region_scalar(spark, sf):
    """A root, and one from a start from which plain Newton steps lead away."""
    import math

    root = solvers.trust_region(solvers.nonlinear_problem(lambda x: (x * x - 2, 2 * x), 10.0)).solve().problem.solution
    arc = solvers.trust_region(solvers.nonlinear_problem(lambda x: (math.atan(x), 1 / (1 + x * x)), 3.0), residual_tol=1e-12).solve().problem.solution
    return spark.createDataFrame([(root, arc)], "root double, arc double").select(F.round("root", 7).alias("root"), (F.round("arc", 7) + 0.0).alias("arc"))


@query("backward_euler_vector", f"SELECT gid, round(v / pow(1.5::DOUBLE, 4), 6) AS u, round(-v / pow(1.5::DOUBLE, 4), 6) AS rate FROM ({_BOTH})")
def backward_euler_vector(spark, sf):
    """Four steps of u' = -u from the balances, whose result depends on the step."""
    u0 = two_vectors(spark, sf)[0].cut()

    def statement(t, u, v, du, dv):
        return v.axpy(1.0, u), sparse_diag_matrix(pfill(du + dv, u.rows))

    problem = solvers.ode_problem(statement, (0.0, u0, u0), (0.0, 2.0), constant_jacobian=True)
    newton = lambda p: solvers.newton_raphson(p, solver=solvers.jacobi_correction, residual_tol=1e-6)
    _, u, v = solvers.backward_euler(problem, dt=0.5, solver=newton).solve().problem.solution
    return u.gvec().withColumnRenamed("v", "u").join(v.gvec().withColumnRenamed("v", "rate"), "gid").select("gid", F.round("u", 6).alias("u"), F.round("rate", 6).alias("rate"))


# -- the conjugate-gradient benchmark on tables

_FINE, _COARSE = (8, 4, 4), (4, 2, 2)


def _stencil27(shape: tuple[int, int, int]) -> str:
    x, y, z = shape
    grid = f"range(1, {x + 1}) a(x), range(1, {y + 1}) b(y), range(1, {z + 1}) c(z), range(-1, 2) d(dx), range(-1, 2) e(dy), range(-1, 2) f(dz)"
    inside = f"x + dx BETWEEN 1 AND {x} AND y + dy BETWEEN 1 AND {y} AND z + dz BETWEEN 1 AND {z}"
    gid = lambda a, b, c: f"{a} + {x} * ({b} - 1) + {x * y} * ({c} - 1)"
    return f"SELECT {gid('x', 'y', 'z')} AS gi, {gid('x + dx', '(y + dy)', '(z + dz)')} AS gj, CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN 26.0 ELSE -1.0 END::DOUBLE AS v FROM {grid} WHERE {inside}"


def _list(n: int, value: str) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: {value})"


def _benchmark_sql(iterations: int) -> str:
    n, low = 128, 16
    points = "(SELECT list(x + 8 * (y - 1) + 32 * (z - 1) ORDER BY z, y, x) FROM range(1, 9, 2) a(x), range(1, 5, 2) b(y), range(1, 5, 2) c(z))"
    # The first half of the points of a direction of the box belongs to the first part.
    out = "WITH RECURSIVE " + rows_sql("m", _stencil27(_FINE), "1 + ((gid - 1) % 8) // 4") + "," + rows_sql("c", _stencil27(_COARSE), "1 + ((gid - 1) % 4) // 2")
    out += f", points AS MATERIALIZED (SELECT {points} AS p), zeros AS (SELECT {_list(n, '0.0::DOUBLE')} AS x, {_list(low, '0.0::DOUBLE')} AS low)"
    out += ", r0 AS MATERIALIZED (SELECT list(27.0::DOUBLE - entries ORDER BY gi) AS x FROM (SELECT gi, count(*) AS entries FROM m_e GROUP BY gi))"
    for k in range(iterations):
        r = f"(SELECT x FROM r{k})"
        out += "," + sweeps_sql(f"u{k}", "m", n, "(SELECT x FROM zeros)", r)
        out += f", d{k} AS MATERIALIZED (SELECT list_transform(p, lambda i: r.x[i] - au.x[i]) AS x FROM points, r{k} r, (SELECT {product_sql('m', f'(SELECT x FROM u{k})')} AS x) au)"
        out += "," + sweeps_sql(f"e{k}", "c", low, "(SELECT low FROM zeros)", f"(SELECT x FROM d{k})")
        out += f", w{k} AS MATERIALIZED (SELECT {_list(n, 'u.x[i] + coalesce(e.x[list_position(p, i)], 0.0::DOUBLE)')} AS x FROM u{k} u, e{k} e, points)"
        out += "," + sweeps_sql(f"z{k}", "m", n, f"(SELECT x FROM w{k})", r)
        out += f", rho{k} AS MATERIALIZED (SELECT list_inner_product(r.x, z.x) AS v FROM r{k} r, z{k} z)"
        if k:
            out += f", p{k} AS MATERIALIZED (SELECT {_list(n, 'z.x[i] + a.v / b.v * p.x[i]')} AS x FROM z{k} z, p{k - 1} p, rho{k} a, rho{k - 1} b)"
        else:
            out += ", p0 AS MATERIALIZED (SELECT x FROM z0)"
        out += f", q{k} AS MATERIALIZED (SELECT {product_sql('m', f'(SELECT x FROM p{k})')} AS x)"
        out += f", r{k + 1} AS MATERIALIZED (SELECT {_list(n, 'r.x[i] - a.v / list_inner_product(p.x, q.x) * q.x[i]')} AS x FROM r{k} r, p{k} p, q{k} q, rho{k} a)"
    each = " UNION ALL ".join(f"SELECT {k + 1}::BIGINT AS iteration, sqrt(list_inner_product(b.x, b.x)) / sqrt(list_inner_product(a.x, a.x)) AS v FROM r0 a, r{k + 1} b" for k in range(iterations))
    return f"{out} SELECT iteration, round(v, 10) AS ratio FROM ({each})"


@query("hpcg_cg_k", _benchmark_sql(2))
def hpcg_cg_k(spark, sf):
    """Residual ratios of two iterations with two levels and two parts."""
    mg, _, b = hpcg.spark_setup(spark, 2, 2, 4, 4, 4)
    _, norms, _ = hpcg.ref_cg(mg.matrices[-1], b, mg, 2)
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(norms)], "iteration long, ratio double").select("iteration", F.round("ratio", 10).alias("ratio"))


@query("hpcg_restrict_prolongate", "SELECT gid, CASE WHEN x % 2 = 1 AND y % 2 = 1 AND z % 2 = 1 THEN gid ELSE 0 END::DOUBLE AS v FROM (SELECT x + 8 * (y - 1) + 32 * (z - 1) AS gid, x, y, z FROM range(1, 9) a(x), range(1, 5) b(y), range(1, 5) c(z))")
def hpcg_restrict_prolongate(spark, sf):
    """Every second point's id, down to the coarse grid and back."""
    mg, _, b = hpcg.spark_setup(spark, 2, 2, 4, 4, 4)
    ids = type(b)(b.df.withColumn("v", F.col("gid").cast("double")), b.rows)
    back = mg.prolongate(mg.restrict(ids, 1), 1)
    return b.rows.own().select("gid").join(back, "gid", "left").select("gid", F.coalesce("v", F.lit(0.0)).alias("v"))


@query("hpcg_report", f"SELECT 128::BIGINT AS equations, (SELECT count(*) FROM ({_stencil27(_FINE)})) AS nonzeros, 2 AS npx, 1 AS npy, 1 AS npz, 2::BIGINT * 2 * (SELECT count(*) FROM ({_stencil27(_FINE)})) AS spmv_flops")
def hpcg_report(spark, sf):
    result = hpcg.hpcg_benchmark(2, 4, 4, 4, total_runtime=0, iterations=2, levels=2)
    read = json.loads(hpcg.report_table(spark, result).first()[0])
    flops = read["flops"]["spmv"] / read["sets"] / read["opt_iterations"] * 2
    row = (read["equations"], read["nonzeros"], *(read["geometry"][k] for k in ("npx", "npy", "npz")), int(flops))
    return spark.createDataFrame([row], "equations long, nonzeros long, npx int, npy int, npz int, spmv_flops long")


# -- elasticity

#: The stiffness of a square cell for a Young's modulus of 1 and a Poisson ratio of 1/4, times 60.
_STIFF = (
    (32, 12, -20, 0, 4, 0, -16, -12),
    (12, 32, 0, 4, 0, -20, -12, -16),
    (-20, 0, 32, -12, -16, 12, 4, 0),
    (0, 4, -12, 32, 12, -16, 0, -20),
    (4, 0, -16, 12, 32, -12, -20, 0),
    (0, -20, 12, -16, -12, 32, 0, 4),
    (-16, -12, 4, 0, -20, 0, 32, 12),
    (-12, -16, 0, -20, 0, 4, 12, 32),
)
_STIFF_SQL = ", ".join(f"({a // 2 % 2}, {a // 4}, {a % 2 + 1}, {b // 2 % 2}, {b // 4}, {b % 2 + 1}, {_STIFF[a][b]})" for a in range(8) for b in range(8))
_ELASTIC = f"SELECT 2 * (x + ax - 2 + 8 * (y + ay - 2)) + ca AS gi, 2 * (x + bx - 2 + 8 * (y + by_ - 2)) + cb AS gj, round(sum(v) / 60.0::DOUBLE, 6) + 0.0 AS v FROM range(1, 10) a(x), range(1, 10) b(y), (VALUES {_STIFF_SQL}) c(ax, ay, ca, bx, by_, cb, v) WHERE x + ax - 1 BETWEEN 1 AND 8 AND y + ay - 1 BETWEEN 1 AND 8 AND x + bx - 1 BETWEEN 1 AND 8 AND y + by_ - 1 BETWEEN 1 AND 8 GROUP BY 1, 2"


@query("gallery_elasticity_2d", _ELASTIC)
def gallery_elasticity_2d(spark, sf):
    coo, rows, cols = gallery.linear_elasticity_fem(spark, (8, 8), (2, 2))
    return psparse(coo, rows, cols).df.select("gi", "gj", (F.round("v", 6) + 0.0).alias("v"))


@query("near_nullspace", "SELECT 3 * (x + 4 * (y - 1) + 20 * (z - 1) - 1) + c AS gid, round(CASE c WHEN 1 THEN -y / 6.0::DOUBLE WHEN 2 THEN x / 5.0::DOUBLE ELSE 0 END, 9) + 0.0 AS b4 FROM range(1, 5) a(x), range(1, 6) b(y), range(1, 4) e(z), range(1, 4) d(c)")
def near_nullspace(spark, sf):
    coords, _ = gallery.node_coordinates_unit_cube(spark, (4, 5, 3))
    return gallery.near_nullspace_linear_elasticity(coords, 3).select("gid", (F.round("b4", 9) + 0.0).alias("b4"))


@query("node_partition", "SELECT CAST(1 + ((gid - 1) % 8) // 4 + 2 * ((gid - 1) // 32) AS INTEGER) AS part, gid FROM range(1, 65) t(gid)")
def node_partition(spark, sf):
    _, rows, _ = gallery.linear_elasticity_fem(spark, (8, 8), (2, 2))
    return distributed.node_partition(rows, 2).index.select("part", "gid")
