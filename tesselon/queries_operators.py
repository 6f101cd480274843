"""Registered queries of partitions, exchanges, vectors, matrices and blocks beyond the running example.

Each calls the operator itself, not a shortcut that would give the same.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .operators import collectives as co
from .operators.blocks import BMatrix, BRange, BVector
from .operators.matrix import PSparseMatrix, compress, local_triplets, psparse, psparse_by_part, psparse_from_split_blocks, refill_system
from .operators.prange import PRange, from_local, partition_from_color, uniform_partition, variable_partition
from .operators.vector import PVector, already_assembled, from_split_blocks, local_entries, pfill, prand, prandn, pvector, pvector_by_part, refill_vector, same_rows, subassembled
from .plans.lineage import checkpoint_dir
from .plans.timer import PTimer
from .queries import _BOTH, _DISTANCES, _EDGES, _ENTRIES, _ITEMS, _GHOSTS, _SUMMED, COO, CUSTOMERS, MAT, ORDERS, PARTS, SUPPLIERS, X, balances, by_color, customers, customers_seen, entries, items, matrix, orders, own_part, query, read, summed, suppliers, triplets, two_vectors
from .sources import tables


def one_row(spark: SparkSession, **values) -> DataFrame:
    """Figures that an operator gave to the driver."""
    return spark.createDataFrame([tuple(values.values())], list(values))


def listed(spark: SparkSession, values: list) -> DataFrame:
    """(k, v) of a list on the driver."""
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(values)], "k long, v double")


# -- reductions and distances through the vectors' own methods


@query("vec_sum", f"SELECT sum(v) AS v, 10 + sum(v) AS from_ten, max(v) AS largest FROM ({_BOTH})")
def vec_sum(spark, sf):
    v = two_vectors(spark, sf)[0]
    return one_row(spark, v=v.sum(), from_ten=v.reduce("+", 10.0), largest=v.reduce("max"))


@query("vec_min_max", f"SELECT min(v) AS lo, max(v) AS hi, max(-v * v) AS hi_f, min(2 * v) AS lo_f FROM ({_BOTH})")
def vec_min_max(spark, sf):
    v = two_vectors(spark, sf)[0]
    return one_row(spark, lo=v.minimum(), hi=v.maximum(), hi_f=v.maximum(lambda x: -x * x), lo_f=v.minimum(lambda x: x * 2))


@query("vec_any_all", f"SELECT bool_or(v > 10000) AS some, bool_and(v > 0) AS every FROM ({_BOTH})")
def vec_any_all(spark, sf):
    v = two_vectors(spark, sf)[0]
    return one_row(spark, some=v.any(lambda x: x > 10000), every=v.all(lambda x: x > 0))


for _p, _sql in (("1", "sum(abs(v))"), ("2", "sqrt(sum(v * v))"), ("inf", "max(abs(v))")):

    @query(f"vec_norm{_p}", f"SELECT {_sql} AS norm FROM ({_BOTH})")
    def vec_norm(spark, sf, p=_p):
        return one_row(spark, norm=two_vectors(spark, sf)[0].norm(float(p)))


@query("vec_norm3", f"SELECT round(pow(sum(pow(abs(v), 3)), 1 / 3.0::DOUBLE), 4) AS norm FROM ({_BOTH})")
def vec_norm3(spark, sf):
    return one_row(spark, norm=round(two_vectors(spark, sf)[0].norm(3), 4))


for _metric, _sql in _DISTANCES.items():

    @query(f"dist_{_metric}", f"SELECT round({_sql}, 3) AS d FROM ({_BOTH})")
    def dist(spark, sf, metric=_metric):
        a, b = two_vectors(spark, sf)
        return one_row(spark, d=round(float(a.distance(b, metric)), 3))


@query("vec_equals", "SELECT true AS same, false AS other, false AS longer, true AS rows_alike, false AS rows_other")
def vec_equals(spark, sf):
    a, b = two_vectors(spark, sf)
    more = pfill(1.0, uniform_partition(spark, PARTS, a.rows.n + 1))
    return one_row(spark, same=a.equals(a * 1.0), other=a.equals(b), longer=a.equals(more), rows_alike=same_rows(a, b), rows_other=same_rows(a, a.repartition(by_reverse(a.rows))))


def by_reverse(rows: PRange) -> PRange:
    """The same ids on the parts in reverse."""
    return partition_from_color(rows.own().select("gid", (F.lit(rows.parts + 1) - F.col("owner")).alias("owner")), rows.parts, rows.n)


@query("vec_guards", "SELECT 'vectors' AS zip, 'dot' AS dot, 'distance' AS distance, 'product' AS product, 'rows' AS plus")
def vec_guards(spark, sf):
    """What operations on layouts that don't match say, up to the colon."""
    a, short, m = two_vectors(spark, sf)[0], pfill(1.0, uniform_partition(spark, PARTS, 6)), matrix(spark, sf)

    def said(f) -> str:
        try:
            f()
        except ValueError as e:
            return str(e).split(":")[0]
        return ""

    return one_row(spark, zip=said(lambda: a + short), dot=said(lambda: a.dot(short)), distance=said(lambda: a.distance(short, "euclidean")), product=said(lambda: m @ short), plus=said(lambda: m + m.T))


@query("vec_collect", f"SELECT gid AS k, v FROM ({_BOTH})")
def vec_collect(spark, sf):
    return listed(spark, two_vectors(spark, sf)[0].collect())


@query("shown", f"SELECT 'vector of length ' || {CUSTOMERS} || ' partitioned into 4 parts' AS v, {ORDERS} || 'x' || {SUPPLIERS} || ' sparse matrix partitioned into 4 parts (not assembled)' AS m, '1:' || {ORDERS} || ' partitioned into 4 parts' AS r")
def shown(spark, sf):
    raw = psparse(triplets(spark, sf), orders(spark, sf), suppliers(spark, sf), assemble=False)
    return one_row(spark, v=repr(summed(spark, sf)), m=repr(raw), r=repr(orders(spark, sf)))


# -- building vectors


@query("pvector_function", f"SELECT CAST({own_part('gid', CUSTOMERS)} AS INTEGER) AS part, gid, CAST(100 * gid + {own_part('gid', CUSTOMERS)} AS DOUBLE) AS v FROM range(1, {CUSTOMERS} + 1) t(gid)")
def pvector_function(spark, sf):
    """A vector from a function of the part and its ids."""
    return pvector_by_part(customers(spark, sf), lambda part, gids: gids * 100.0 + part).own_values()


@query("pvector_local_ids", f"SELECT gid, CAST(3 * {own_part('gid', CUSTOMERS)} AS DOUBLE) AS v FROM range(1, {CUSTOMERS} + 1) t(gid)")
def pvector_local_ids(spark, sf):
    """Contributions by local id, own ids three times, ids below 1 ignored."""
    p = customers(spark, sf)
    once = p.index.select("part", "lid", F.col("part").cast("double").alias("v"))
    more = once.unionAll(once).unionAll(once).unionAll(spark.createDataFrame([(1, 0, 5.0)], "part int, lid int, v double"))
    return pvector(local_entries(more, p), p).gvec()


@query("pvector_already_assembled", f"SELECT gid, coalesce(e.v, 0) AS v FROM range(1, {CUSTOMERS} + 1) t(gid) LEFT JOIN (SELECT gid, sum(v) AS v FROM ({_ENTRIES}) WHERE gid >= 1 AND part = {own_part('gid', CUSTOMERS)} GROUP BY 1) e USING (gid)")
def pvector_already_assembled(spark, sf):
    return already_assembled(entries(spark, sf), customers(spark, sf)).gvec()


@query("pvector_refill", f"SELECT gid, -2 * v AS v FROM ({_SUMMED})")
def pvector_refill(spark, sf):
    o = read(spark, sf, "orders").select((F.col("o_orderkey") % 4 + 1).cast("int").alias("part"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("gid"), (F.floor("o_totalprice") * -2.0).alias("v"))
    return refill_vector(o.select("part", "k", "gid"), o.select("part", "k", "v"), customers(spark, sf)).gvec()


@query("pvector_split_blocks", f"SELECT CAST(part AS INTEGER) AS part, gid, -CAST(ghost_id AS DOUBLE) AS v FROM ({_GHOSTS}) UNION ALL SELECT CAST({own_part('gid', CUSTOMERS)} AS INTEGER), gid, CAST(row_number() OVER (PARTITION BY {own_part('gid', CUSTOMERS)} ORDER BY gid) AS DOUBLE) FROM range(1, {CUSTOMERS} + 1) t(gid)")
def pvector_split_blocks(spark, sf):
    p = customers_seen(spark, sf)
    own = p.own().select("part", "own_id", F.col("own_id").cast("double").alias("v"))
    ghost = p.ghosts().select("part", "ghost_id", (-F.col("ghost_id")).cast("double").alias("v"))
    return from_split_blocks(own, ghost, p).local_values().select("part", "gid", "v")


@query("vec_assemble_drop", _SUMMED)
def vec_assemble_drop(spark, sf):
    """Assembly that leaves the ghosts out."""
    v = pvector(entries(spark, sf), customers(spark, sf), assemble=False).assemble(keep_ghosts=False)
    return v.df.select("gid", "v")


_PER_CUSTOMER = f"SELECT gid, 1 + (SELECT count(*) FROM ({_GHOSTS}) g WHERE g.gid = t.gid) AS copies FROM range(1, {CUSTOMERS} + 1) t(gid)"


@query("vec_assemble_arrays", f"SELECT gid, copies::DOUBLE AS first, CAST(gid * copies AS DOUBLE) AS second, CASE WHEN gid % 2 = 0 THEN copies::DOUBLE END AS third FROM ({_PER_CUSTOMER})")
def vec_assemble_arrays(spark, sf):
    """Arrays as entries: every copy of an id adds its array, which has a third place for even ids."""
    p = customers_seen(spark, sf)
    v = PVector(pfill(0.0, p).df.withColumn("v", F.when(F.col("gid") % 2 == 0, F.array(F.lit(1.0), F.col("gid").cast("double"), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.col("gid").cast("double")))), p)
    return v.assemble_arrays().gvec().select("gid", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"), F.get("v", F.lit(2)).alias("third"))


@query("vec_consistent_arrays", f"SELECT CAST(part AS INTEGER) AS part, gid, CAST(owner AS DOUBLE) AS first, CAST(gid AS DOUBLE) AS second FROM ({_GHOSTS})")
def vec_consistent_arrays(spark, sf):
    p = customers_seen(spark, sf)
    arrays = F.when(F.col("own"), F.array(F.col("part").cast("double"), F.col("gid").cast("double"))).otherwise(F.array())
    v = PVector(pfill(0.0, p).df.withColumn("v", arrays.cast("array<double>")), p).consistent()
    return v.ghost_values().select("part", "gid", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))


@query("vec_repartition_back", f"SELECT CAST({own_part('gid', CUSTOMERS)} AS INTEGER) AS part, gid, v FROM ({_SUMMED}) UNION ALL SELECT CAST(part AS INTEGER), gid, s.v FROM ({_GHOSTS}) JOIN ({_SUMMED}) s USING (gid)")
def vec_repartition_back(spark, sf):
    """To the nations and back to the layout with ghosts."""
    there = summed(spark, sf).repartition(by_color(spark, sf))
    return there.repartition(customers_seen(spark, sf), reversed=True).local_values().select("part", "gid", "v")


@query("vec_renumber_onto", f"SELECT row_number() OVER (ORDER BY c_nationkey, gid) AS gid, v FROM ({_SUMMED}) JOIN customer ON c_custkey + 1 = gid")
def vec_renumber_onto(spark, sf):
    moved = summed(spark, sf).repartition(by_color(spark, sf))
    return moved.renumber(by_color(spark, sf).renumber()).gvec()


@query("vec_random", f"SELECT {CUSTOMERS} AS n, true AS inside, true AS spread, true AS copies_alike, true AS chosen, true AS normal")
def vec_random(spark, sf):
    """Numbers in 0..1 and from choices, alike for all copies of an id; normal ones with mean 0 and deviation 1."""
    p = customers_seen(spark, sf)
    u, c, g = prand(p, 7), prand(p, 7, [2.0, 5.0]), prandn(p, 7)
    n = p.n
    alike = u.df.groupBy("gid").agg(F.countDistinct("v").alias("k")).filter("k > 1").isEmpty()
    z = g.own().agg(F.avg("v"), F.stddev("v")).first()
    return one_row(
        spark,
        n=n,
        inside=u.all(lambda v: (v >= 0) & (v < 1)),
        spread=abs(u.sum() / n - 0.5) < 3 / n**0.5,
        copies_alike=alike,
        chosen=c.all(lambda v: v.isin(2.0, 5.0)) and c.any(lambda v: v == 2.0) and c.any(lambda v: v == 5.0),
        normal=abs(z[0]) < 5 / n**0.5 and abs(z[1] - 1) < 5 / n**0.5,
    )


# -- partitions


@query("local_range", f"SELECT CAST(p AS INTEGER) AS part, min(gid) AS first, max(gid) AS last, greatest(min(gid) - 2, 1) AS ghost_first, least(max(gid) + 2, 103) AS ghost_last, min(gid) - 2 AS around_first, max(gid) + 2 AS around_last FROM (SELECT {own_part('gid', '103', 7)} AS p, gid FROM range(1, 104) t(gid)) GROUP BY p")
def local_range(spark, sf):
    rows = [(p, *ids.local_range(p, 7, 103), *ids.local_range(p, 7, 103, 2), *ids.local_range(p, 7, 103, 2, True)) for p in range(1, 8)]
    return spark.createDataFrame(rows, "part int, first long, last long, ghost_first long, ghost_last long, around_first long, around_last long")


@query("near_cubic", "WITH d AS (SELECT p, x, y, p // (x * y) AS z FROM range(1, 65) a(p), range(1, 65) b(x), range(1, 65) c(y) WHERE x <= y AND y * x <= p AND p % (x * y) = 0 AND p // (x * y) >= y) SELECT p, min(x * y + y * z + x * z) AS surface FROM d GROUP BY p")
def near_cubic(spark, sf):
    """Half the surface of the box of each number of parts."""
    boxes = [(p, ids.near_cubic(p)) for p in range(1, 65)]
    return spark.createDataFrame([(p, x * y + y * z + x * z) for p, (x, y, z) in boxes], "p long, surface long")


@query("permute_indices", f"SELECT CAST({own_part('gid', CUSTOMERS)} AS INTEGER) AS part, gid, CAST(row_number() OVER (PARTITION BY {own_part('gid', CUSTOMERS)} ORDER BY gid DESC) AS INTEGER) AS lid FROM range(1, {CUSTOMERS} + 1) t(gid)")
def permute_indices(spark, sf):
    """Local ids the other way round."""
    p = customers(spark, sf)
    size = p.lengths().select("part", "local_length")
    perm = p.index.join(size, "part").select("part", F.col("lid").cast("long").alias("k"), (F.col("local_length") + 1 - F.col("lid")).alias("lid"))
    return p.permute(perm).index.select("part", "gid", "lid")


@query("matching_indices", "SELECT true AS itself, false AS own_other, true AS own_seen, false AS local_seen, false AS ghost_seen")
def matching_indices(spark, sf):
    a, b, seen = customers(spark, sf), by_reverse(customers(spark, sf)), customers_seen(spark, sf)
    return one_row(spark, itself=a.matches(customers(spark, sf)), own_other=a.matches(b, "own"), own_seen=a.matches(seen, "own"), local_seen=a.matches(seen), ghost_seen=a.matches(seen, "ghost"))


@query("renumber_local", f"SELECT CAST(part AS INTEGER) AS part, gid, CAST(row_number() OVER (PARTITION BY part ORDER BY own DESC, place) AS INTEGER) AS lid FROM (SELECT p AS part, c_custkey + 1 AS gid, (c_custkey % 4 + 1 = p)::INT AS own, c_custkey AS place FROM customer, range(1, 5) t(p))")
def renumber_local(spark, sf):
    """Own ids first and ghosts behind them, where they were mixed; ids contiguous already."""
    every = read(spark, sf, "customer").withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(1, 5)])))
    local = every.select("part", (F.col("c_custkey") + 1).cast("int").alias("lid"), (F.col("c_custkey") + 1).alias("gid"), (F.col("c_custkey") % 4 + 1).cast("int").alias("owner"))
    mixed = from_local(local, every.count() // 4, 4)
    back = mixed.new_ids().select(F.col("new_gid").alias("gid"), F.col("gid").alias("old"))
    moved = mixed.renumber(local=True).index.join(back, "gid")
    return moved.select("part", F.col("old").alias("gid"), "lid")


@query("owner_function", f"SELECT o_custkey AS gid, CAST(o_custkey % 4 + 1 AS INTEGER) AS owner, count(*) AS n FROM orders WHERE o_custkey >= 1 GROUP BY 1, 2")
def owner_function(spark, sf):
    """Owners by a given function of the id."""
    p = from_local(spark.createDataFrame([], "part int, lid int, gid long, owner int"), customers(spark, sf).n, PARTS, lambda gid: (gid % 4 + 1).cast("int"))
    wanted = read(spark, sf, "orders").filter("o_custkey >= 1").groupBy(F.col("o_custkey").alias("gid")).agg(F.count("*").alias("n"))
    return p.find_owner(wanted)


@query("owner_of_blocks", f"SELECT gid, CAST(coalesce(b.part, 0) AS INTEGER) AS owner FROM range(-1, {CUSTOMERS} + 3) t(gid) LEFT JOIN (SELECT part, start, start + size - 1 AS stop FROM (SELECT *, 1 + coalesce(sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT 1 AS part, 0 AS size UNION ALL SELECT 2, {CUSTOMERS} - 9 UNION ALL SELECT 3, 0 UNION ALL SELECT 4, 2 UNION ALL SELECT 5, 7))) b ON gid BETWEEN start AND stop")
def owner_of_blocks(spark, sf):
    """Uneven and empty blocks."""
    n = customers(spark, sf).n
    p = variable_partition(spark, [0, n - 9, 0, 2, 7])
    return p.find_owner(spark.range(-1, n + 3).select(F.col("id").alias("gid")))


# -- exchanges


@query("exchange_within", f"SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(row_number() OVER (PARTITION BY dst ORDER BY src) AS INTEGER) AS rcv_pos FROM ({_EDGES}) WHERE src < dst")
def exchange_within(spark, sf):
    """Edges among known neighbours."""
    whole = customers_seen(spark, sf).assembly_graph()
    return co.exchange_graph(whole.filter("src < dst").select("src", "snd_pos", "dst"), within=whole).select("src", "dst", "rcv_pos")


_TWO_WAYS = f"SELECT src, dst FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})"


@query("exchange_symmetric", f"SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS INTEGER) AS snd_pos, CAST(row_number() OVER (PARTITION BY dst ORDER BY src) AS INTEGER) AS rcv_pos FROM ({_TWO_WAYS})")
def exchange_symmetric(spark, sf):
    """A graph in which each part receives from those it sends to."""
    return co.exchange_graph(_two_ways(customers_seen(spark, sf)), symmetric=True).select("src", "dst", "snd_pos", "rcv_pos")


def _two_ways(p: PRange) -> DataFrame:
    one = p.neighbours().select(F.col("part").alias("src"), F.col("neighbour").alias("dst"))
    both = one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.withColumn("snd_pos", F.row_number().over(co.Window.partitionBy("src").orderBy("dst")))


@query("exchange_given", f"SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(row_number() OVER (PARTITION BY dst ORDER BY src DESC) AS INTEGER) AS rcv_pos FROM ({_EDGES})")
def exchange_given(spark, sf):
    """The receiving side found by a function, in descending order of the senders."""
    snd = customers_seen(spark, sf).assembly_graph().select("src", "snd_pos", "dst")
    place = F.row_number().over(co.Window.partitionBy("dst").orderBy(F.desc("src")))
    return co.exchange_graph(snd, find_rcv=lambda s: s.select("src", "dst", place.alias("rcv_pos"))).select("src", "dst", "rcv_pos")


@query("graph_is_consistent", "SELECT true AS whole, false AS without_one")
def graph_is_consistent(spark, sf):
    g = customers_seen(spark, sf).assembly_graph()
    return one_row(spark, whole=co.is_consistent(g, g), without_one=co.is_consistent(g, g.filter("src <> 1")))


@query("exchange_vector", f"SELECT CAST(owner AS INTEGER) AS part, sum(gid)::BIGINT AS x FROM ({_GHOSTS}) GROUP BY part, owner")
def exchange_vector(spark, sf):
    """Sums of ghost ids sent to their owners."""
    p = customers_seen(spark, sf)
    g = p.assembly_graph()
    sums = p.ghosts().groupBy(F.col("part").alias("src"), F.col("owner").alias("dst")).agg(F.sum("gid").alias("x"))
    return co.exchange(sums.join(g.select("src", "dst", "snd_pos"), ["src", "dst"]).select("src", "snd_pos", "x"), g).select("part", "x")


@query("map_parts", f"SELECT CAST(part AS INTEGER) AS part, CAST(part * x AS BIGINT) AS x FROM ({_ITEMS})")
def map_parts(spark, sf):
    """A function of each part's rows."""
    return co.map_parts(items(spark, sf), lambda part, rows: pd.DataFrame({"part": [part], "x": [part * int(rows["x"].sum())]}), "part int, x long")


@query("any_item", f"SELECT CAST(x AS BIGINT) AS x FROM ({_ITEMS}) WHERE part = 1")
def any_item(spark, sf):
    return one_row(spark, x=co.any_item(items(spark, sf)))


@query("tuples_of_arrays", f"SELECT part, CAST(x AS BIGINT) AS x, CAST(part + x AS BIGINT) AS y, true AS back FROM ({_ITEMS})")
def tuples_of_arrays(spark, sf):
    """A struct column taken apart and put together again."""
    wide = items(spark, sf).select("part", F.struct("x", (F.col("part") + F.col("x")).alias("y")).alias("t"))
    apart = co.tuple_of_arrays(wide, "t")
    again = co.array_of_tuples(apart, ["x", "y"], "t").select("part", F.col("t").alias("u"))
    return wide.join(again, "part").select("part", "t.x", "t.y", (F.col("t") == F.col("u")).alias("back"))


# -- matrices


@query("centralize", MAT)
def centralize(spark, sf):
    """The own rows and columns of the part that all of the matrix has gone to."""
    return matrix(spark, sf).centralize().own_own_values().select("gi", "gj", "v")


@query("psparse_function", f"SELECT gid AS gi, 1 + gid % {SUPPLIERS} AS gj, CAST({own_part('gid', ORDERS)} AS DOUBLE) AS v FROM range(1, {ORDERS} + 1) t(gid)")
def psparse_function(spark, sf):
    """A matrix from a function of the part and its rows."""
    cols = suppliers(spark, sf)
    n = cols.n
    return psparse_by_part(orders(spark, sf), cols, lambda part, gids: (gids, 1 + gids % n, gids * 0.0 + part)).df


@query("psparse_local_ids", f"SELECT {own_part('gid', ORDERS)} AS owner_row, gid AS gi, gid AS gj, 2.0::DOUBLE AS v FROM range(1, {ORDERS} + 1) t(gid)")
def psparse_local_ids(spark, sf):
    """A diagonal from local ids, each given twice."""
    rows = orders(spark, sf)
    once = rows.index.select("part", F.col("lid").alias("gi"), F.col("lid").alias("gj"), F.lit(1.0).alias("v"))
    a = psparse(once.unionAll(once), rows, rows, indices="local")
    return a.with_owners().select(F.col("row_owner").cast("long").alias("owner_row"), "gi", "gj", "v")


@query("local_triplets", f"SELECT CAST(part AS INTEGER) AS part, gid AS gi, count(*) AS n FROM ({_GHOSTS}) WHERE ghost_id <= 50 GROUP BY 1, 2")
def q_local_triplets(spark, sf):
    """Local ids of ghosts back to global ones."""
    p = customers_seen(spark, sf)
    coo = p.ghosts().filter("ghost_id <= 50").select("part", F.col("lid").alias("gi"), F.col("lid").alias("gj"), F.lit(1.0).alias("v"))
    return local_triplets(coo, p, p).filter("gi = gj").groupBy("part", "gi").agg(F.count("*").alias("n"))


@query("psparse_already_assembled", f"SELECT gi, gj, sum(v) AS v FROM ({COO}) WHERE part = {own_part('gi', ORDERS)} GROUP BY gi, gj")
def psparse_already_assembled(spark, sf):
    return psparse(triplets(spark, sf), orders(spark, sf), suppliers(spark, sf), assembled=True).df


@query("psparse_split_blocks", MAT)
def psparse_split_blocks(spark, sf):
    a = matrix(spark, sf)
    return psparse_from_split_blocks([a.own_own_values(), a.own_ghost_values()], a.rows, a.cols).df


@query("coo_combine_function", f"SELECT gi, gj, round(avg(v), 6) AS v FROM ({COO}) GROUP BY gi, gj")
def coo_combine_function(spark, sf):
    """Any aggregation in place of a sum."""
    return compress(triplets(spark, sf), combine=F.avg).select("gi", "gj", F.round("v", 6).alias("v"))


@query("psystem_refill", f"SELECT gi AS gid, sum(3 * l_quantity) AS row_sum, CAST(sum(2 * l_linenumber) AS DOUBLE) AS rhs FROM (SELECT l_orderkey + 1 AS gi, l_quantity, l_linenumber FROM lineitem) GROUP BY gi")
def psystem_refill(spark, sf):
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("k")
    li = read(spark, sf, "lineitem").select(key, F.col("l_linenumber").alias("part"), (F.col("l_orderkey") + 1).alias("gi"), (F.col("l_suppkey") + 1).alias("gj"), "l_quantity", "l_linenumber")
    li = li.groupBy("k", "part", "gi", "gj").agg(F.sum("l_quantity").alias("q"), F.sum("l_linenumber").cast("double").alias("n"))
    plan, values = li.select("part", "k", "gi", "gj"), li.select("part", "k", (F.col("q") * 3).alias("v"))
    a, b = refill_system(plan, values, plan.select("part", "k", F.col("gi").alias("gid")), li.select("part", "k", (F.col("n") * 2).alias("v")), orders(spark, sf), suppliers(spark, sf))
    sums = a.df.groupBy(F.col("gi").alias("gid")).agg(F.sum("v").alias("row_sum"))
    return sums.join(b.gvec().withColumnRenamed("v", "rhs"), "gid")


@query("repartition_system", f"SELECT CAST({PARTS} + 1 - {own_part('gid', SUPPLIERS)} AS INTEGER) AS part, sum(v) AS v, (SELECT count(*) FROM ({MAT}) WHERE {PARTS} + 1 - {own_part('gj', SUPPLIERS)} = 1) AS entries_of_first FROM ({X}) GROUP BY 1")
def repartition_system(spark, sf):
    """A transposed matrix and its right-hand side on the parts in reverse."""
    a, b = matrix(spark, sf).T, balances(spark, sf)
    rows = by_reverse(suppliers(spark, sf))
    moved, rhs = a.repartition_system(b, rows, a.cols)
    first = moved.with_owners().filter("part = 1").agg(F.count("*").alias("entries_of_first"))
    return rhs.own_values().groupBy("part").agg(F.sum("v").alias("v")).join(F.broadcast(first), F.lit(True))


@query("mat_renumber_onto", f"SELECT n.new_gid AS gi, a.gj, a.v FROM ({MAT}) a JOIN (SELECT gid, row_number() OVER (ORDER BY gid % {PARTS}, gid) AS new_gid FROM range(1, {ORDERS} + 1) t(gid)) n ON n.gid = a.gi")
def mat_renumber_onto(spark, sf):
    """Onto renumbered layouts that are there already."""
    a = matrix(spark, sf)
    new = partition_from_color(a.rows.index.select("gid", (F.col("gid") % PARTS + 1).alias("owner")), PARTS, a.rows.n)
    return a.repartition(new, a.cols).renumber(new.renumber(), a.cols).df


@query("mat_nzindex", f"WITH m AS ({MAT}), k AS (SELECT gi, gj, row_number() OVER (PARTITION BY gi ORDER BY gj) AS k FROM m) SELECT w.gi, w.gj, coalesce(k.k, 0) AS k FROM (SELECT DISTINCT l_orderkey + 1 AS gi, l_linenumber::BIGINT AS gj FROM lineitem) w LEFT JOIN k USING (gi, gj)")
def mat_nzindex(spark, sf):
    """The place of positions among the stored ones of their rows."""
    wanted = read(spark, sf, "lineitem").select((F.col("l_orderkey") + 1).alias("gi"), F.col("l_linenumber").cast("long").alias("gj")).distinct()
    return matrix(spark, sf).nzindex(wanted)


@query("mat_mul_alpha_beta", f"SELECT gid, 2 * coalesce(p.v, 0) - 3.0 AS v FROM range(1, {ORDERS} + 1) t(gid) LEFT JOIN (SELECT a.gi AS gid, sum(a.v * x.v) AS v FROM ({MAT}) a JOIN ({X}) x ON x.gid = a.gj GROUP BY 1) p USING (gid)")
def mat_mul_alpha_beta(spark, sf):
    a = matrix(spark, sf)
    return a.mul(balances(spark, sf), 2.0, -3.0, pfill(1.0, a.rows)).gvec()


@query("sub_matrix_multiply", f"SELECT a.gi AS gid, sum(7 * x.v) AS v FROM ({MAT}) a JOIN ({X}) x ON x.gid = a.gj WHERE a.gj <= 5 GROUP BY 1")
def sub_matrix_multiply(spark, sf):
    """Stored entries of a submatrix set to 7, times a vector."""
    a = matrix(spark, sf)
    cols = a.cols.own().filter("gid <= 5").select("gid")
    sub = PSparseMatrix(a.submatrix(a.rows.own().select("gid"), cols), a.rows, a.cols).fill_stored(7.0)
    hit = sub.df.select(F.col("gi").alias("gid")).distinct()
    return (sub @ balances(spark, sf)).gvec().join(hit, "gid", "left_semi")


def _kept(spark: SparkSession, df: DataFrame, write, load) -> DataFrame:
    """What ``load`` reads after ``write`` in the shared folder."""
    path = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    write(df, path)
    return load(path)


@query("files_parquet", MAT)
def files_parquet(spark, sf):
    """Triplets written and read again."""
    return _kept(spark, matrix(spark, sf).df, tables.write_coo, lambda path: tables.read_coo(spark, path))


@query("files_matrix_market", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS gi, CAST(n_regionkey + 1 AS BIGINT) AS gj, CAST(n_nationkey AS DOUBLE) AS v FROM nation")
def files_matrix_market(spark, sf):
    """A coordinate file of nations by regions."""
    rows = read(spark, sf, "nation").select(F.concat_ws(" ", F.col("n_nationkey") + 1, F.col("n_regionkey") + 1, F.col("n_nationkey").cast("double")).alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("25 5 25",)], "value string")
    whole = head.coalesce(1).unionAll(rows).coalesce(1)
    return _kept(spark, whole, lambda df, path: df.write.text(path), lambda path: tables.read_matrix_market(spark, path))


@query("timer_table", "SELECT * FROM (VALUES ('assemble', 1.0::DOUBLE, 3.0::DOUBLE, 2.0::DOUBLE), ('solve', 4.0::DOUBLE, 4.0::DOUBLE, 4.0::DOUBLE)) t(section, min, max, avg)")
def timer_table(spark, sf):
    t = PTimer()
    t.data = {"assemble": {1: 1.0, 2: 3.0, 3: 2.0}, "solve": {1: 4.0}}
    return t.table(spark)


# -- blocks

_BLOCKS = f"SELECT 1 AS block_i, gid, v FROM ({_BOTH}) UNION ALL SELECT 2, gid, w FROM ({_BOTH})"


def blocks(spark, sf) -> BVector:
    """Balances and numbers of orders, one block after another."""
    return BVector.of(list(two_vectors(spark, sf)))


@query("bvector_reductions", f"SELECT sum(v) AS total, min(v) AS lo, max(v) AS hi, bool_or(v > 10000) AS some, bool_and(v > 0) AS every, sqrt(sum(v * v)) AS norm, sum(2 * v * v) AS dot, true AS same, false AS other FROM ({_BLOCKS})")
def bvector_reductions(spark, sf):
    b = blocks(spark, sf)
    figures = {"total": b.sum(), "lo": b.minimum(), "hi": b.maximum(), "some": b.any(lambda v: v > 10000), "every": b.all(lambda v: v > 0)}
    return one_row(spark, **figures, norm=b.norm(), dot=b.dot(2.0 * b), same=b.equals(b * 1.0), other=b.equals(b.fill(1.0)))


@query("bvector_arithmetic", f"SELECT CAST(block_i AS INTEGER) AS block_i, gid, 3 * v - abs(v) AS v FROM ({_BLOCKS})")
def bvector_arithmetic(spark, sf):
    b = blocks(spark, sf)
    return (b + 2.0 * b - b.map(F.abs)).df


@query("bvector_collect", f"SELECT row_number() OVER (ORDER BY block_i, gid) AS k, v FROM ({_BLOCKS})")
def bvector_collect(spark, sf):
    return listed(spark, blocks(spark, sf).collect())


@query("bvector_axes", f"SELECT 2 * {CUSTOMERS} AS length, {CUSTOMERS} AS first_last, 2::BIGINT AS block_of_next, (SELECT sum(w) FROM ({_BOTH})) AS second_sum")
def bvector_axes(spark, sf):
    b = blocks(spark, sf)
    lasts = b.axis.lasts()
    return one_row(spark, length=len(b), first_last=lasts[0], block_of_next=b.axis.find_block(lasts[0] + 1), second_sum=b.block(2).sum())


@query("bvector_distances", f"SELECT round(sqrt(sum(v * v)), 3) AS euclidean, sum(abs(v)) AS cityblock, max(abs(v)) AS chebyshev FROM ({_BLOCKS})")
def bvector_distances(spark, sf):
    b = blocks(spark, sf)
    other = 2.0 * b
    return one_row(spark, euclidean=round(b.distance(other, "euclidean"), 3), cityblock=b.distance(other, "cityblock"), chebyshev=b.distance(other, "chebyshev"))


@query("bvector_ghosts", f"SELECT CAST(b AS INTEGER) AS block_i, CAST(part AS INTEGER) AS part, gid, CAST(b * owner AS DOUBLE) AS v FROM ({_GHOSTS}), range(1, 3) t(b)")
def bvector_ghosts(spark, sf):
    """Ghosts of both blocks after their owners' values have come."""
    p = customers_seen(spark, sf)
    v = PVector(pfill(0.0, p).df.withColumn("v", F.when(F.col("own"), F.col("part") * 1.0).otherwise(F.lit(0.0))), p)
    return BVector.of([v, v * 2.0]).consistent().ghost_values()


@query("bvector_assemble", f"SELECT CAST(b AS INTEGER) AS block_i, CAST({own_part('gid', CUSTOMERS)} AS INTEGER) AS part, gid, CAST(b * copies AS DOUBLE) AS v FROM ({_PER_CUSTOMER}), range(1, 3) t(b)")
def bvector_assemble(spark, sf):
    ones = pfill(1.0, customers_seen(spark, sf))
    return BVector.of([ones, ones * 2.0]).assemble().own_values()


_BPRODUCT = f"SELECT i.i, gid, coalesce(p.v, 0.0) AS v FROM range(1, 3) i(i), range(1, {ORDERS} + 1) t(gid) LEFT JOIN (SELECT a.gi AS gid, sum(a.v * x.v) AS v FROM ({MAT}) a JOIN ({X}) x ON x.gid = a.gj GROUP BY 1) p USING (gid)"


def block_matrix(spark, sf) -> BMatrix:
    """The running example four times, with factors 1, 2, 3 and 4."""
    a = matrix(spark, sf)
    return BMatrix.of([[a, a * 2.0], [a * 3.0, a * 4.0]])


@query("bmatrix_multiply", f"SELECT CAST(i AS INTEGER) AS block_i, gid, CASE i WHEN 1 THEN 5 * v ELSE 11 * v END AS v FROM ({_BPRODUCT})")
def bmatrix_multiply(spark, sf):
    x = balances(spark, sf)
    return (block_matrix(spark, sf) @ BVector.of([x, x * 2.0])).df


@query("bmatrix_mul_alpha_beta", f"SELECT CAST(i AS INTEGER) AS block_i, gid, 0.5 * CASE i WHEN 1 THEN 5 * v ELSE 11 * v END + 4.0 * i AS v FROM ({_BPRODUCT})")
def bmatrix_mul_alpha_beta(spark, sf):
    x = balances(spark, sf)
    ones = pfill(1.0, orders(spark, sf))
    return block_matrix(spark, sf).mul(BVector.of([x, x * 2.0]), 0.5, 4.0, BVector.of([ones, ones * 2.0])).df


@query("bmatrix_figures", f"SELECT 2 * {ORDERS} AS rows, 2 * {SUPPLIERS} AS cols, 4 * (SELECT count(*) FROM ({MAT})) AS nnz, (SELECT 3 * sum(v) FROM ({MAT})) AS third, (SELECT 6 * count(*) FROM ({MAT})) AS filled")
def bmatrix_figures(spark, sf):
    b = block_matrix(spark, sf)
    total = lambda m: m.df.agg(F.sum("v")).first()[0]
    return one_row(spark, rows=b.shape[0], cols=b.shape[1], nnz=b.nnz(), third=float(total(b.block(2, 1))), filled=int(total(b.fill_stored(6.0).block(1, 2))))


@query("brange_blocks", "SELECT 3::BIGINT AS blocks, 12::BIGINT AS length, 2::BIGINT AS block_of_6")
def brange_blocks(spark, sf):
    axis = BRange([uniform_partition(spark, 2, n) for n in (5, 3, 4)])
    return one_row(spark, blocks=len(axis.blocks), length=len(axis), block_of_6=axis.find_block(6))


@query("subassembled_ghosts", f"SELECT CAST(part AS INTEGER) AS part, gid, CAST(2 * ghost_id AS DOUBLE) AS v FROM ({_GHOSTS})")
def subassembled_ghosts(spark, sf):
    """Contributions by local id that stay on the ghosts they were given for."""
    p = customers_seen(spark, sf)
    one = p.ghosts().select("part", "lid", F.col("ghost_id").cast("double").alias("v"))
    return subassembled(one.unionAll(one), p).ghost_values()

