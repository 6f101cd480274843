import math

import pytest
from pyspark.sql import functions as F

from tesselon.operators.blocks import BVector
from tesselon.operators.matrix import psparse, psparse_by_part
from tesselon.operators.prange import partition_from_color, uniform_partition
from tesselon.operators.vector import PVector, from_gvec, from_split_blocks, pfill, pones, prand, prandn, pvector, pvector_by_part, pzeros, subassembled

from .test_partitions import arbitrary


def by_part(v):
    rows = v.df.orderBy("part", "lid").collect()
    return [[r.v for r in rows if r.part == p] for p in range(1, v.rows.parts + 1)]


def test_consistent_and_assemble(spark):
    p = arbitrary(spark)
    v = PVector(pzeros(p).df.withColumn("v", F.when(F.col("own"), F.col("part") * 10.0).otherwise(0.0)), p).consistent()
    assert v.df.filter("v <> owner * 10").isEmpty()
    w = pfill(10.0, p).assemble()
    assert by_part(w) == [[20, 20, 20, 0, 0, 0], [0, 20, 30, 0], [10, 30, 20, 0, 0, 0], [0, 0, 0, 10, 30]]
    assert w.collect() == [20, 20, 20, 20, 30, 10, 30, 20, 10, 30]
    assert pfill(10.0, p).assemble(keep_ghosts=False).collect() == w.collect()
    assert pfill(10.0, p).assemble("max").collect() == [10.0] * 10


def test_documented_assembly(spark):
    p = uniform_partition(spark, 2, 6, True)
    assert by_part(pones(p).assemble()) == [[1, 1, 2, 0], [0, 2, 1, 1]]


def test_entries(spark):
    lists = [[1, 4, 6], [3, 1, 2, 8], [1, 9, 6], [3, 2, 8, 10]]
    e = spark.createDataFrame([(p + 1, k, g, float(g)) for p, gs in enumerate(lists) for k, g in enumerate(gs + [0, -1])], "part int, pos int, gid long, v double")
    rows = uniform_partition(spark, 4, 10)
    v = pvector(e, rows)
    assert v.collect() == [3, 4, 6, 4, 0, 12, 0, 16, 9, 10]
    assert v.maximum() == 16 and v.minimum() == 0 and v.any(lambda x: x > 4) and v.all(lambda x: x < 17) and v.sum() == 64
    apart = pvector(e, rows, assemble=False)
    assert apart.df.filter("not own").count() == 9
    assert apart.assemble().collect() == v.collect()
    assert pvector(e, rows, combine="max").collect() == [1, 2, 3, 4, 0, 6, 0, 8, 9, 10]


def test_arithmetic(spark):
    p = uniform_partition(spark, (2, 2), (6, 6), True)
    a, b = prand(p, 1), prandn(p, 2)
    assert len(a.collect()) == 36 and 0 <= a.minimum() and a.maximum() < 1
    assert a.df.groupBy("gid").agg(F.count_distinct("v").alias("n")).filter("n > 1").isEmpty()
    assert abs((a + b).sum() - a.sum() - b.sum()) < 1e-9
    assert (a - a).norm() == 0 and (2.0 * a).sum() == pytest.approx(2 * a.sum()) and (-a / 2).sum() == pytest.approx(-a.sum() / 2)
    assert a.dot(a) == pytest.approx(a.norm() ** 2) and a.norm(1) == pytest.approx(a.sum()) and a.norm(math.inf) == a.maximum()
    x, y = a.collect(), b.collect()
    assert a.distance(b, "euclidean") == pytest.approx(math.dist(x, y)) and a.distance(b, "sqeuclidean") == pytest.approx(math.dist(x, y) ** 2)
    assert a.axpy(3.0, b).collect() == pytest.approx([i + 3 * j for i, j in zip(x, y, strict=True)])
    assert a.equals(+a) and not a.equals(b)
    assert set(prand(p, 3, [1, 7]).collect()) <= {1, 7}


def test_layouts(spark):
    p = uniform_partition(spark, 4, 10)
    v = PVector(pzeros(p).df.withColumn("v", F.col("gid") * 1.0), p)
    new = partition_from_color(p.index.select("gid", (F.col("gid") % 4 + 1).alias("owner")), 4)
    moved = v.repartition(new)
    assert moved.collect() == v.collect() and moved.df.filter("part <> gid % 4 + 1").isEmpty()
    assert moved.renumber().collect() == [4, 8, 1, 5, 9, 2, 6, 10, 3, 7]
    assert v.renumber() is v
    dofs, local = v.map(lambda x: x % 3 == 0).find_local_indices()
    assert dofs.n == 3 and sorted((r.part, r.dof, r.node) for r in local.collect()) == [(2, 1, 1), (3, 1, 2), (4, 1, 2)]
    two = p.index.select("part", "lid", F.lit(1.0).alias("v"))
    assert subassembled(two.unionAll(two), p).collect() == [2.0] * 10
    assert from_gvec(v.gvec().filter("gid > 8"), p).collect() == [0] * 8 + [9, 10]
    split = from_split_blocks(p.index.select("part", "own_id", F.lit(1.0).alias("v")), p.index.filter("false").select("part", "ghost_id", F.lit(1.0).alias("v")), p)
    assert split.collect() == [1.0] * 10


def test_layouts_must_match(spark):
    a, b = pfill(1.0, uniform_partition(spark, 2, 10)), pfill(1.0, uniform_partition(spark, 2, 6))
    for f in (lambda: a + b, lambda: a.dot(b), lambda: a.distance(b, "cityblock"), lambda: a.axpy(2.0, b), lambda: a.repartition(b.rows), lambda: a + pfill(1.0, uniform_partition(spark, 5, 10))):
        with pytest.raises(ValueError, match="match"):
            f()
    assert not a.equals(b)
    m = psparse(spark.createDataFrame([(1, 1, 1, 2.0), (1, 10, 6, 3.0)], "part int, gi long, gj long, v double"), a.rows, b.rows)
    for f in (lambda: m @ a, lambda: m + m.T, lambda: m @ m, lambda: m.spmtm(m.T), lambda: m.scale_rows(b), lambda: m.repartition(b.rows, b.rows)):
        with pytest.raises(ValueError):
            f()
    assert (m @ b).collect() == [2.0, *[0.0] * 8, 3.0]
    with pytest.raises(ValueError, match="blocks"):
        BVector.of([a, b]).dot(BVector.of([b, a]))


def test_entries_of_arrays(spark):
    p = uniform_partition(spark, 2, 6, ghost=True)
    v = PVector(pfill(0.0, p).df.withColumn("v", F.when(F.col("gid") == 4, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0), F.col("gid").cast("double")))), p)
    assert {r.gid: r.v for r in v.assemble_arrays().gvec().collect()} == {g: [] if g == 4 else [n, n * g] for g, n in ((1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0), (5, 1.0), (6, 1.0))}


def test_builders_by_part(spark):
    p = uniform_partition(spark, 3, 10)
    assert pvector_by_part(p, lambda part, gids: gids * 10.0 + part).collect() == [g * 10.0 + part for g, part in zip(range(1, 11), (1, 1, 1, 2, 2, 2, 3, 3, 3, 3), strict=True)]
    a = psparse_by_part(p, p, lambda part, gids: (gids, gids[::-1].copy(), gids * 0.0 + part))
    assert sorted((r.gi, r.gj, r.v) for r in a.df.collect())[:3] == [(1, 3, 1.0), (2, 2, 1.0), (3, 1, 1.0)]
