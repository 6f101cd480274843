import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators.blocks import BMatrix, BRange, BVector
from tesselon.operators.matrix import compress, psparse, psparse_from_split_blocks, psystem, rap, sparse_diag_matrix
from tesselon.operators.prange import partition_from_color, uniform_partition
from tesselon.operators.vector import PVector, pfill, pones, pzeros
from tesselon.sources import gallery, tables

M4 = {1: ([1, 2, 1, 2, 2], [2, 6, 1, 2, 1], [1, 2, 30, 10, 1]), 2: ([3, 3, 4, 6], [3, 9, 4, 2], [10, 2, 30, 2]), 3: ([5, 5, 6, 7], [5, 6, 6, 7], [10, 2, 30, 1]), 4: ([9, 9, 8, 10, 6], [9, 3, 8, 10, 5], [10, 2, 30, 50, 2])}


def m4(spark, extra=(), **options):
    rows = [(p, i, j, float(v)) for p, (a, b, c) in M4.items() for i, j, v in zip(a, b, c, strict=True)] + list(extra)
    r = uniform_partition(spark, 4, 10)
    return psparse(spark.createDataFrame(rows, "part int, gi long, gj long, v double"), r, r, **options)


def dense():
    out = np.zeros((10, 10))
    for a, b, c in M4.values():
        for i, j, v in zip(a, b, c, strict=True):
            out[i - 1, j - 1] += v
    return out


def test_assembly_ignores_ids_below_one(spark):
    assert (m4(spark).dense() == dense()).all()
    assert (m4(spark, [(2, 0, 0, 2.0), (4, -1, 1, 1.0)]).dense() == dense()).all()
    late = m4(spark, assemble=False)
    assert not late.assembled and (late.assemble().dense() == dense()).all()
    coo = spark.createDataFrame([(1, 3, 4.0), (2, 6, 5.0), (5, 1, 3.0), (4, 1, 2.0), (1, 3, 5.0), (9, 1, 1.0)], "gi long, gj long, v double")
    assert {(r.gi, r.gj): r.v for r in compress(coo, 7, 6).collect()} == {(1, 3): 9, (2, 6): 5, (5, 1): 3, (4, 1): 2}
    assert compress(coo.filter("false"), 0, 0).count() == 0


def test_algebra(spark):
    a, d = m4(spark).cut(), dense()
    x = PVector(pzeros(a.cols).df.withColumn("v", F.col("gid") * 1.0), a.cols)
    v = np.arange(1.0, 11)
    assert np.allclose((a @ x).collect(), d @ v) and np.allclose((a.T @ x).collect(), d.T @ v)
    assert np.allclose(a.mul(x, 2.0, 3.0, x).collect(), 2 * d @ v + 3 * v)
    assert np.allclose((a @ a).dense(), d @ d) and np.allclose(a.spmtm(a).dense(), d.T @ d)
    assert np.allclose(rap(a.T, a, a).dense(), d.T @ d @ d)
    assert np.allclose((a + a * 2.0 - a).dense(), 2 * d) and np.allclose(a.identity_minus().dense(), np.eye(10) - d)
    assert np.allclose(a.diag().collect(), np.diag(d)) and np.allclose(sparse_diag_matrix(x).dense(), np.diag(v))
    assert np.allclose(a.scale_rows(x).dense(), np.diag(v) @ d)
    b = a @ x
    assert np.allclose((a @ a.solve(b)).collect(), b.collect(), atol=1e-9)
    assert (a.fill_stored(1.0) @ pfill(3.0, a.cols)).collect() == [3.0 * n for n in (d != 0).sum(axis=1)]


def test_blocks_of_parts(spark):
    a = m4(spark)
    parts = [a.own_own_values(), a.own_ghost_values(), a.ghost_own_values(), a.ghost_ghost_values()]
    assert [p.count() for p in parts[2:]] == [0, 0] and parts[0].count() + parts[1].count() == a.nnz()
    again = psparse_from_split_blocks(parts[:2], a.rows, a.cols)
    assert (again.dense() == dense()).all()
    late = m4(spark, assemble=False)
    assert late.ghost_own_values().count() + late.ghost_ghost_values().count() == 2  # row 6 of parts 2 and 4
    dropped = m4(spark, drop_offpart=True)
    assert dropped.nnz() == parts[0].count()


def test_layout(spark):
    a = m4(spark)
    new = partition_from_color(a.rows.index.select("gid", (F.col("gid") % 4 + 1).alias("owner")), 4)
    moved = a.repartition(new, new)
    assert moved.with_owners().filter("part <> gi % 4 + 1").isEmpty()
    order = [int(r.gid) - 1 for r in new.new_ids().orderBy("new_gid").collect()]
    assert np.allclose(moved.renumber().dense(), dense()[np.ix_(order, order)])
    wide = a.rows.union_ghost(spark.createDataFrame([(1, 9, 1)], "part int, gid long, pos int"))
    assert a.consistent(wide).filter("part = 1 and gi = 9").count() == 2
    ids = spark.createDataFrame([(9,), (6,)], "gid long")
    assert sorted((r.gi, r.gj) for r in a.submatrix(ids, ids).collect()) == [(6, 6), (9, 9)]
    with pytest.raises(ValueError):
        m4(spark, assemble=False).repartition(new, new)
    m, b = psystem(a.df.withColumn("part", F.lit(1)), spark.createDataFrame([(1, 2, 5.0), (2, 2, 1.0)], "part int, gid long, v double"), a.rows, a.cols)
    assert b.collect()[1] == 6 and m.nnz() == a.nnz()


def test_block_arrays(spark):
    p = uniform_partition(spark, (2, 2), (6, 6))
    v = BVector.of([pones(p), pzeros(p)])
    assert len(v) == 72 and v.norm() == 6 and v.dot(v) == 36 and (v + v).reduce() == 72 and v.block(2).sum() == 0
    coo, rows, cols = gallery.laplacian_fem(spark, (6, 6), (2, 2))
    a = psparse(coo, rows, cols).cut()
    m = BMatrix.of([[a, a], [a, a]])
    assert m.shape == (72, 72) and m.nnz() == 4 * a.nnz()
    w = m @ v
    assert np.allclose(w.collect()[:36], (a @ pones(p)).collect()) and np.allclose(w.collect()[:36], w.collect()[36:])
    assert BRange([p, p]).find_block(36) == 1 and BRange([p, p]).find_block(37) == 2


def test_generators(spark):
    for nodes, parts in (((6,), (3,)), ((4, 5), (2, 2)), ((3, 4, 2), (1, 2, 1))):
        coo, rows, cols = gallery.laplacian_fdm(spark, nodes, parts)
        d = psparse(coo, rows, cols).dense()
        scale = np.prod([n + 1 for n in nodes])
        assert (d == d.T).all() and (np.diag(d) == 2 * len(nodes) * scale).all()
        assert coo.join(rows.own().select(F.col("gid").alias("gi"), F.col("part").alias("p")), "gi").filter("p <> part").isEmpty()
    coo, rows, _ = gallery.laplacian_fem(spark, (3, 3))
    d = psparse(coo, rows, rows).dense()
    assert np.allclose(d[4], np.array([-1, -1, -1, -1, 8, -1, -1, -1, -1]) / 3)
    for nodes in ((5, 5), (4, 4, 4)):
        dims = len(nodes)
        coo, rows, _ = gallery.linear_elasticity_fem(spark, nodes)
        d = psparse(coo, rows, rows).dense()
        coords, _ = gallery.node_coordinates_unit_cube(spark, nodes)
        modes = np.array([list(r)[1:] for r in gallery.nullspace_linear_elasticity(coords, dims).orderBy("gid").collect()])
        inner = [k for k in range(len(d)) if all(1 <= (k // dims // 1) // int(np.prod(nodes[:a])) % nodes[a] <= nodes[a] - 2 for a in range(dims))]
        assert np.allclose(d, d.T) and np.allclose((d @ modes)[inner], 0, atol=1e-12) and modes.shape[1] == {2: 3, 3: 6}[dims]
    coo, b, rows = gallery.hpcg_stencil(spark, (8, 8, 8), (2, 2, 1))
    a = psparse(coo, rows, rows)
    assert (a @ pones(rows)).collect() == [r.v for r in b.orderBy("gid").collect()] and a.nnz() == (3 * 8 - 2) ** 3


def test_files(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n2 1 -1.0\n3 3 4.5\n")
    found = {(r.gi, r.gj): r.v for r in tables.read_matrix_market(spark, str(tmp_path / "a.mtx")).collect()}
    assert found == {(1, 1): 2, (2, 1): -1, (1, 2): -1, (3, 3): 4.5}
    a = m4(spark)
    tables.write_coo(a.df, str(tmp_path / "a.parquet"))
    assert tables.read_coo(spark, str(tmp_path / "a.parquet")).count() == a.nnz()


def test_centralize_keeps_entries_off_the_driver(spark, monkeypatch):
    from tesselon.operators import matrix as module

    monkeypatch.setattr(module, "LOCAL_ENTRIES", 5)
    rows = uniform_partition(spark, 3, 10)
    a = psparse(spark.range(1, 11).selectExpr("1 AS part", "id AS gi", "11 - id AS gj", "double(id) AS v"), rows, rows)
    one = a.centralize(2)
    assert sorted(map(tuple, one.own_own_values().select("part", "gi", "gj", "v").collect())) == [(2, k, 11 - k, float(k)) for k in range(1, 11)]
    assert one.rows.parts == 3 and one.own_ghost_values().isEmpty()
    with pytest.raises(ValueError, match="too many entries"):
        a.entries()
