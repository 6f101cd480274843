import pytest

from tesselon.operators import collectives as co

SND = [[3, 4], [1, 3], [1, 4], [2]]


def table(spark, xs, kind="int"):
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(xs)], f"part int, x {kind}")


def values(df):
    return [r.x for r in df.orderBy("part").collect()]


def test_gather_scatter_multicast(spark):
    tens = table(spark, [10, 20, 30, 40])
    assert [(r.part, r.pos, r.x) for r in co.gather(tens, 4, 2).orderBy("pos").collect()] == [(2, k, 10 * k) for k in range(1, 5)]
    assert co.gather(tens, 4, "all").count() == 16
    whole = spark.createDataFrame([(1, [1]), (3, [5, 6, 7, 8])], "part int, x array<int>")
    assert values(co.scatter(whole, 3, 4)) == [5, 6, 7, 8]
    with pytest.raises(Exception, match="one item for each part"):
        co.scatter(whole, 1, 4).collect()
    assert values(co.multicast(table(spark, [1, 2, 3, 4]), 2, 4)) == [2, 2, 2, 2]


def test_scan_reduction(spark):
    a, b = table(spark, [3, 6, 0, 3]), table(spark, [4, 2, 6, 3])
    assert values(co.scan(a, 0)) == [3, 9, 9, 12] and values(co.scan(a, 1, "exclusive")) == [1, 4, 10, 10]
    assert values(co.scan(b, 0)) == [4, 6, 12, 15] and values(co.scan(b, 1, "exclusive")) == [1, 5, 7, 13]
    assert values(co.scan(b, 0, op="max")) == [4, 4, 6, 6]
    assert values(co.scan(b, 1, op=lambda x, y: x * y)) == [4, 8, 48, 144]
    ranks = table(spark, [1, 2, 3, 4])
    assert values(co.reduction(ranks, 10, "all")) == [20] * 4
    assert values(co.reduction(ranks, 0, 2)) == [0, 10, 0, 0]
    assert values(co.map_main(ranks, lambda x: x * 5)) == [5, None, None, None]


def test_exchange(spark):
    edges = spark.createDataFrame([(s + 1, k + 1, d) for s, ds in enumerate(SND) for k, d in enumerate(ds)], "src int, snd_pos int, dst int")
    graph = co.exchange_graph(edges)
    rcv = {d: [r.src for r in graph.filter(f"dst = {d}").orderBy("rcv_pos").collect()] for d in range(1, 5)}
    assert rcv == {1: [2, 3], 2: [4], 3: [1, 2], 4: [1, 3]}
    payload = edges.selectExpr("src", "snd_pos", "10 * dst as x")
    got = co.exchange(payload, graph).orderBy("part", "pos").collect()
    assert [(r.part, r.x) for r in got] == [(1, 10), (1, 10), (2, 20), (3, 30), (3, 30), (4, 40), (4, 40)]
    assert co.is_consistent(edges, graph) and not co.is_consistent(edges, graph.filter("dst <> 2"))
    assert sorted(map(tuple, co.reverse(co.reverse(graph)).collect())) == sorted(map(tuple, graph.collect()))
    with pytest.raises(ValueError):
        co.exchange_graph(edges, edges.filter("dst <> 2"))
