from pyspark.sql import functions as F

from tesselon.functions.ids import local_range, near_cubic
from tesselon.operators.prange import from_local, node_to_dof_partition, partition_from_color, trivial_partition, uniform_partition, variable_partition

L4 = {1: ([1, 2, 3, 5, 7, 8], [1, 1, 1, 2, 3, 3]), 2: ([2, 4, 5, 10], [1, 2, 2, 4]), 3: ([6, 7, 8, 5, 4, 10], [3, 3, 3, 2, 2, 4]), 4: ([1, 3, 7, 9, 10], [1, 1, 3, 4, 4])}


def arbitrary(spark):
    rows = [(p, k + 1, g, o) for p, (gs, os) in L4.items() for k, (g, o) in enumerate(zip(gs, os, strict=True))]
    return from_local(spark.createDataFrame(rows, "part int, lid int, gid long, owner int"), 10, 4)


def gids(p):
    rows = p.index.orderBy("part", "lid").collect()
    return [[r.gid for r in rows if r.part == k] for k in range(1, p.parts + 1)]


def test_local_range():
    assert [local_range(p, 3, 10) for p in (1, 2, 3)] == [(1, 3), (4, 6), (7, 10)]
    assert [local_range(p, 3, 10, 1) for p in (1, 2, 3)] == [(1, 4), (3, 7), (6, 10)]
    assert [local_range(p, 3, 10, 1, True) for p in (1, 2, 3)] == [(0, 4), (3, 7), (6, 11)]
    assert near_cubic(4) == (2, 2, 1)


def test_uniform(spark):
    assert gids(uniform_partition(spark, 4, 10)) == [[1, 2], [3, 4], [5, 6, 7], [8, 9, 10]]
    assert gids(uniform_partition(spark, (2, 2), (5, 4))) == [[1, 2, 6, 7], [3, 4, 5, 8, 9, 10], [11, 12, 16, 17], [13, 14, 15, 18, 19, 20]]
    ghost = uniform_partition(spark, (2, 2), (5, 4), (True, True))
    assert gids(ghost)[0] == [1, 2, 3, 6, 7, 8, 11, 12, 13]
    assert gids(uniform_partition(spark, (2, 2), (4, 4), True, True))[0] == [16, 13, 14, 15, 4, 1, 2, 3, 8, 5, 6, 7, 12, 9, 10, 11]
    assert gids(uniform_partition(spark, (2, 2), (4, 4), (True, True), (False, True)))[0] == [13, 14, 15, 1, 2, 3, 5, 6, 7, 9, 10, 11]
    own = {(r.part, r.gid) for r in ghost.index.filter("own_id > 0").collect()}
    assert own == {(p + 1, g) for p, gs in enumerate(gids(uniform_partition(spark, (2, 2), (5, 4)))) for g in gs}


def test_more_parts_than_ids(spark):
    p = uniform_partition(spark, 5, 3)
    assert gids(p) == [[], [], [1], [2], [3]]
    found = p.find_owner(spark.createDataFrame([(0,), (1,), (2,), (3,)], "gid long"))
    assert [r.owner for r in found.orderBy("gid").collect()] == [0, 3, 4, 5]


def test_variable_and_color(spark):
    v = variable_partition(spark, [4, 2, 6, 3])
    assert gids(v) == [[1, 2, 3, 4], [5, 6], [7, 8, 9, 10, 11, 12], [13, 14, 15]]
    u = uniform_partition(spark, 4, 21)
    c = partition_from_color(u.index.select("gid", "owner"), 4)
    assert gids(c) == gids(u)
    wanted = spark.createDataFrame([(g,) for g in (1, 4, 6, 3, 2, 8, 9, 10, 0, -1)], "gid long")
    by = lambda p: sorted((r.gid, r.owner) for r in p.find_owner(wanted).collect())
    assert by(c) == by(u)
    assert dict(by(u))[0] == dict(by(u))[-1] == 0
    empty = variable_partition(spark, [2, 0, 3])
    assert dict(sorted((r.gid, r.owner) for r in empty.find_owner(wanted.filter("gid between 1 and 4")).collect())) == {1: 1, 2: 1, 3: 3, 4: 3}


def test_ghosts(spark):
    p = uniform_partition(spark, 4, 10)
    wanted = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (1, 9, 3), (1, 1, 4), (1, 0, 5), (2, -1, 1), (2, 3, 2), (2, 10, 3)], "part int, gid long, pos int")
    wide = p.union_ghost(wanted)
    assert gids(wide)[:2] == [[1, 2, 9, 4], [3, 4, 10]]
    assert [r.owner for r in wide.ghosts().orderBy("part", "ghost_id").collect()] == [4, 2, 4]
    assert gids(wide.remove_ghost()) == gids(p)
    again = wide.replace_ghost(spark.createDataFrame([(1, 5, 1)], "part int, gid long, pos int"))
    assert gids(again)[0] == [1, 2, 5]
    assert sorted((r.src, r.dst) for r in wide.assembly_graph().collect()) == [(1, 2), (1, 4), (2, 4)]
    lengths = {r.part: (r.local_length, r.own_length, r.ghost_length) for r in wide.lengths().collect()}
    assert lengths == {1: (4, 2, 2), 2: (3, 2, 1), 3: (3, 3, 0), 4: (3, 3, 0)}


def test_arbitrary_local(spark):
    p = arbitrary(spark)
    assert gids(p) == [v[0] for v in L4.values()]
    asked = spark.createDataFrame([(1, 5), (1, 4), (3, 4), (3, 0), (3, -2)], "part int, gid long")
    found = {(r.part, r.gid): r.lid for r in p.translate(asked, "gid", "lid", "gid", "lid").collect()}
    assert found == {(1, 5): 4, (1, 4): 0, (3, 4): 5, (3, 0): 0, (3, -2): -2}
    place = {(r.part, r.lid): r.perm for r in p.local_permutation().collect()}
    assert [place[2, k] for k in range(1, 5)] == [3, 1, 2, 4]
    assert p.matches(p.renumber())  # its owners are contiguous already
    odd = partition_from_color(uniform_partition(spark, 1, 6).index.select("gid", (F.col("gid") % 2 + 1).alias("owner")), 2)
    assert gids(odd.renumber()) == [[1, 2, 3], [4, 5, 6]] and not odd.matches(odd.renumber())


def test_trivial_and_dofs(spark):
    assert gids(trivial_partition(spark, 3, 4, 2)) == [[], [1, 2, 3, 4], []]
    d = node_to_dof_partition(uniform_partition(spark, 2, 3), 2)
    assert gids(d) == [[1, 2], [3, 4, 5, 6]]
    owned = d.find_owner(d.index.select("gid", "part"), "gid", "o")
    assert owned.filter(F.col("o") != F.col("part")).isEmpty()
