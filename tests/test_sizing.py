"""Large sums and joins take as many tasks as their rows need, with the same results."""

import re

import numpy as np
import pytest

from tesselon.operators import blocks, matrix, solvers
from tesselon.operators.blocks import BMatrix, BVector, block_multiply
from tesselon.operators.matrix import psparse, rap, sparse_diag_matrix
from tesselon.operators.prange import uniform_partition
from tesselon.operators.vector import PVector, pfill
from tesselon.plans import sizing


@pytest.fixture
def small_tasks(monkeypatch):
    for module in (sizing, matrix, blocks):
        monkeypatch.setattr(module, "ROWS_PER_TASK", 5)
    for module in (matrix, blocks):
        monkeypatch.setattr(module, "BROADCAST_IDS", 0)


@pytest.fixture
def made(spark, small_tasks):
    """60 triplets of 20 rows and 10 columns, five positions twice."""
    rows, cols = uniform_partition(spark, 3, 20), uniform_partition(spark, 3, 10)
    coo = spark.range(60).selectExpr("1 AS part", "id % 20 + 1 AS gi", "(id * id) % 10 + 1 AS gj", "double(id % 7 - 3) AS v")
    dense = np.zeros((20, 10))
    for r in coo.collect():
        dense[r.gi - 1, r.gj - 1] += r.v
    return psparse(coo, rows, cols, entries=60), dense


def tasks(df):
    """Partitions without Catalyst putting small ones together."""
    return df.rdd.getNumPartitions()


def test_block_products(spark, made):
    a, d = made
    x = PVector(pfill(0.0, a.cols).df.selectExpr("part", "lid", "gid", "owner", "own", "double(gid) AS v"), a.cols)
    b = BMatrix.of([[a, a * 2.0], [a * 3.0, a * 4.0]])
    found = b @ BVector.of([x, x * 2.0])
    y = d @ np.arange(1.0, 11.0)
    assert tasks(found.df) >= 240 // 5 and found.collect() == [*(5 * y), *(11 * y)]


def test_transposed_products(made):
    a, d = made
    found = a.spmtm(a)
    assert tasks(found.df) >= 60 * 60 // 20 // 5 and np.allclose(found.dense(), d.T @ d)


def dealt(df, *keys):
    """Into how many tasks the plan deals rows out by these keys, fewest first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sorted(int(n) for found, n in re.findall(r"RepartitionByExpression \[(.*?)\], (\d+)", plan) if tuple(c.split("#")[0] for c in found.split(", ")) == keys)


def test_joins_of_transposed_products_follow_the_partial_products(made):
    a, d = made
    found = a.spmtm(a)
    assert dealt(found.df, "gi") == [60 * 60 // 20 // 5] * 2 and np.allclose(found.dense(), d.T @ d)


def test_joins_of_products_of_three_follow_the_partial_products(spark, made):
    a, d = made
    ones = psparse(spark.range(10).selectExpr("1 AS part", "id + 1 AS gi", "1 AS gj", "1d AS v"), a.cols, uniform_partition(spark, 1, 1), entries=10)
    found = rap(ones.T, a.spmtm(a), ones)
    assert dealt(found.df, "gi")[-2:] == [60 * 60 // 20 // 5] * 2 and np.allclose(found.dense(), (d.T @ d).sum())


def test_joins_with_a_small_matrix_follow_the_partial_products(made, monkeypatch):
    a, d = made
    monkeypatch.setattr(matrix, "BROADCAST_IDS", 60)
    found = a.spmtm(a)
    assert dealt(found.df, "gi", "__j", "__w") == [60 * 60 // 20 // 5] and np.allclose(found.dense(), d.T @ d)
    found = a @ a.T
    assert dealt(found.df, "__k", "__j", "__w") == [60 * 60 // 10 // 5] and np.allclose(found.dense(), d @ d.T)


def groups(spark, n):
    """(by, dense): 10 ids to n groups, an entry each."""
    rows = uniform_partition(spark, 3, 10)
    by = psparse(spark.range(10).selectExpr("1 AS part", "id + 1 AS gi", f"id % {n} + 1 AS gj", "double(id - 4) AS v"), rows, uniform_partition(spark, 1, n), entries=10)
    dense = np.zeros((10, n))
    dense[np.arange(10), np.arange(10) % n] = np.arange(10) - 4
    return by, dense


@pytest.mark.parametrize("n", [2, 7])
def test_a_product_by_groups_is_summed_once(spark, made, monkeypatch, n):
    a, d = made
    monkeypatch.setattr(matrix, "BROADCAST_IDS", 10)
    by, g = groups(spark, n)
    found = rap(by.T, a.spmtm(a), by)
    sums = [4] * 2 + [60 // 5] * 2 + [60 * 60 // 20 // 5] * (n * n > 5)  # two assemblies of each matrix, then the result
    assert dealt(found.df, "gi", "gj") == sums and np.allclose(found.dense(), g.T @ d.T @ d @ g)


def test_products_that_grow_are_summed_first(spark, made, monkeypatch):
    a, d = made
    by, g = groups(spark, 2)
    monkeypatch.setattr(matrix, "BROADCAST_IDS", 60)
    ata = a.spmtm(a)
    found = a @ ata @ by
    assert 60 * 60 // 20 // 5 in dealt(found.df, "gi", "gj") and np.allclose(found.dense(), d @ d.T @ d @ g)
    small = by.spmtm(by)
    assert np.allclose((by @ small @ small).dense(), g @ g.T @ g @ g.T @ g)
    assert np.allclose(((ata * 2.0).T @ by).dense(), 2 * d.T @ d @ g)


def test_identity_minus_a_product(made):
    a, d = made
    found = a.spmtm(a).identity_minus()
    assert tasks(found.df) >= (100 + 10) // 5 and np.allclose(found.dense(), np.eye(10) - d.T @ d)


def test_galerkin_product(spark, made):
    a, d = made
    found = rap(a.T, sparse_diag_matrix(pfill(2.0, a.rows)), a)
    assert tasks(found.df) >= 60 * 60 // 20 // 5 and np.allclose(found.dense(), 2 * d.T @ d)


def test_block_alpha_beta(made):
    a, d = made
    ones = pfill(1.0, a.cols)
    found = BMatrix.of([[a, a * 2.0]]).mul(BVector.of([ones, ones]), 0.5, 4.0, BVector.of([pfill(1.0, a.rows)]))
    assert tasks((BMatrix.of([[a, a * 2.0]]) @ BVector.of([ones, ones])).df) >= 120 // 5 and np.allclose(found.collect(), 1.5 * d.sum(1) + 4)


def test_diagonal_of_a_product(made):
    a, d = made
    found = a.spmtm(a).diag()
    joins = found.df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [gi" in joins and np.allclose(found.collect(), np.diag(d.T @ d))


def test_block_product_of_stored_rows(spark, small_tasks):
    a = spark.createDataFrame([("R", "O", k, 1 + k % 3, 1.0) for k in range(1, 31)], "block_i string, block_j string, gi long, gj long, v double")
    x = spark.createDataFrame([("O", k, float(k)) for k in (1, 2, 3)], "block_i string, gid long, v double")
    found = block_multiply(a, x, 3, 30)
    assert tasks(found) >= 30 // 5 and sorted(map(tuple, found.collect())) == [("R", k, 1.0 + k % 3) for k in range(1, 31)]


def test_newton_iterates_have_no_joins_behind_them(spark):
    rows = uniform_partition(spark, 2, 4)
    c = pfill(9.0, rows)
    problem = solvers.nonlinear_problem(lambda x: (x.zip(c, lambda a, b: a * a - b), sparse_diag_matrix(x * 2.0)), pfill(4.0, rows))
    found, _ = solvers.newton_raphson(problem, solver=solvers.jacobi_correction).step()
    x = found.problem.solution
    assert "Join" not in x.df._jdf.queryExecution().optimizedPlan().toString() and x.collect() == [3.125] * 4
