"""Partitioned index ranges.

``index`` has a row for every local id: part, lid, gid, owner, own_id, ghost_id
(0: not own, not a ghost). Ids below 1 are ignored wherever ids come in. Local ids
are 32-bit, so a part has fewer than 2^31 ids; more are an error, not a wrap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids

#: Ids that one array holds while ranges are expanded.
STEP = 65_536


def parts_table(spark: SparkSession, parts: int) -> DataFrame:
    """(part) from 1."""
    return spark.range(1, parts + 1).select(F.col("id").cast("int").alias("part"))


def expand(df: DataFrame, start: Column, stop: Column, name: str) -> DataFrame:
    """A row for each id in start..stop, without an array longer than STEP."""
    out = df.withColumn("__from", start.cast("long")).withColumn("__to", stop.cast("long")).filter("__from <= __to")
    out = out.withColumn("__from", F.explode(F.sequence("__from", "__to", F.lit(STEP).cast("long"))))
    return out.withColumn(name, F.explode(F.sequence("__from", F.least("__to", F.col("__from") + STEP - 1)))).drop("__from", "__to")


def numbered(local: DataFrame) -> DataFrame:
    """own_id and ghost_id by local order, from (part, lid, gid, owner, own)."""
    by = Window.partitionBy("part", "own").orderBy("lid")
    n = F.row_number().over(by)
    return local.select(
        "part",
        F.col("lid").cast("int").alias("lid"),
        F.col("gid").cast("long").alias("gid"),
        F.col("owner").cast("int").alias("owner"),
        F.when(F.col("own"), n).otherwise(F.lit(0)).alias("own_id"),
        F.when(F.col("own"), F.lit(0)).otherwise(n).alias("ghost_id"),
    )


@dataclass(frozen=True)
class PRange:
    """1..n dealt out to parts, with what each part also sees of others."""

    index: DataFrame
    n: int
    parts: int
    #: The owner of an id as an expression, where there is a closed form.
    owner_of: Callable[[Column], Column] | None = None
    #: (gid, owner) where there isn't.
    owners: DataFrame | None = None
    #: (part, start, stop) of contiguous blocks.
    blocks: DataFrame | None = None

    def __repr__(self) -> str:
        return f"1:{self.n} partitioned into {self.parts} parts"

    @property
    def partition(self) -> DataFrame:
        return self.index

    def own(self) -> DataFrame:
        return self.index.filter("own_id > 0")

    def ghosts(self) -> DataFrame:
        return self.index.filter("ghost_id > 0")

    def lengths(self) -> DataFrame:
        """(part, local_length, own_length, ghost_length, global_length), parts without ids included."""
        seen = self.index.groupBy("part").agg(F.count("*").alias("l"), F.sum((F.col("own_id") > 0).cast("long")).alias("o"))
        every = parts_table(self.index.sparkSession, self.parts).join(seen, "part", "left")
        local, own = F.coalesce("l", F.lit(0)), F.coalesce("o", F.lit(0))
        return every.select("part", local.alias("local_length"), own.alias("own_length"), (local - own).alias("ghost_length"), F.lit(self.n).cast("long").alias("global_length"))

    def find_owner(self, df: DataFrame, gid: str = "gid", out: str = "owner") -> DataFrame:
        """``df`` with the owner of each id; 0 for ids below 1."""
        if self.owner_of is not None:
            return df.withColumn(out, self.owner_of(F.col(gid)))
        if self.blocks is not None:  # empty blocks own nothing
            wide = max(1, -(-self.n // max(self.parts, 1)))
            real = self.blocks.filter("stop >= start").select(F.col("part").alias("__p"), F.col("start").alias("__a"), F.col("stop").alias("__b"))
            # Blocks meet ids in stretches of the average length, of which all blocks together touch two a block at most.
            real = real.withColumn("__k", F.explode(F.sequence(ids.whole(F.col("__a") - 1, wide), ids.whole(F.col("__b") - 1, wide))))
            keyed = df.withColumn("__k", ids.whole(F.col(gid).cast("long") - 1, wide))
            found = keyed.join(real, (keyed["__k"] == real["__k"]) & F.col(gid).between(F.col("__a"), F.col("__b")), "left").drop("__k")
            return found.withColumn(out, F.coalesce("__p", F.lit(0)).cast("int")).drop("__p", "__a", "__b")
        table = self.owners if self.owners is not None else self.own().select("gid", "owner")
        table = table.select(F.col("gid").alias("__g"), F.col("owner").alias("__o"))
        return df.join(table, F.col(gid) == F.col("__g"), "left").withColumn(out, F.coalesce("__o", F.lit(0)).cast("int")).drop("__g", "__o")

    def translate(self, df: DataFrame, source: str, target: str, column: str, out: str | None = None) -> DataFrame:
        """Ids of one kind (gid, lid, own_id, ghost_id) to another (or owner) in (part, column); 0 where there is none, ids below 1 unchanged."""
        table = self.index.filter(F.col(source) > 0).select(F.col("part").alias("__p"), F.col(source).alias("__s"), F.col(target).alias("__t"))
        found = df.join(table, (F.col("part") == F.col("__p")) & (F.col(column) == F.col("__s")), "left")
        value = F.when(F.col(column) < 1, F.col(column)).otherwise(F.coalesce("__t", F.lit(0)))
        return found.withColumn("__v", value).drop("__p", "__s", "__t", out or column).withColumnRenamed("__v", out or column)

    def local_permutation(self) -> DataFrame:
        """(part, lid, perm): the place of each local id in own, then ghosts."""
        own = F.sum((F.col("own_id") > 0).cast("int")).over(Window.partitionBy("part"))
        return self.index.select("part", "lid", F.when(F.col("own_id") > 0, F.col("own_id")).otherwise(own + F.col("ghost_id")).cast("long").alias("perm"))

    def remove_ghost(self) -> PRange:
        own = self.own()
        return replace(self, index=own.withColumn("lid", F.col("own_id").cast("int")))

    def filter_ghost(self, wanted: DataFrame) -> DataFrame:
        """(part, gid, owner, pos) of new ghosts, first appearances of ids >= 1 that the part doesn't have.

        ``wanted`` has part, gid, pos and may have owner.
        """
        found = wanted.filter("gid >= 1")
        found = found.groupBy("part", "gid").agg(F.min("pos").alias("pos"))
        found = found.join(self.index.select("part", "gid"), ["part", "gid"], "left_anti")
        return self.find_owner(found).filter("owner <> part")

    def union_ghost(self, wanted: DataFrame) -> PRange:
        """With further ghosts behind the local ids, in order of first appearance."""
        new = self.filter_ghost(wanted)
        last = self.index.groupBy("part").agg(F.max("lid").alias("l"), F.max("ghost_id").alias("g"))
        k = F.row_number().over(Window.partitionBy("part").orderBy("pos"))
        added = new.withColumn("k", k).join(last, "part", "left").select(
            "part", (F.coalesce("l", F.lit(0)) + F.col("k")).cast("int").alias("lid"), "gid", "owner", F.lit(0).alias("own_id"), (F.coalesce("g", F.lit(0)) + F.col("k")).cast("int").alias("ghost_id")
        )
        return replace(self, index=self.index.unionByName(added))

    def replace_ghost(self, wanted: DataFrame) -> PRange:
        """With these ghosts instead."""
        return self.remove_ghost().union_ghost(wanted)

    def permute(self, perm: DataFrame) -> PRange:
        """``perm`` (part, k, lid): the local id k of the result is the own-then-ghost place given by lid."""
        place = self.local_permutation()
        joined = self.index.join(place, ["part", "lid"]).drop("lid").join(perm.select("part", F.col("lid").alias("perm"), F.col("k")), ["part", "perm"])
        return replace(self, index=joined.select("part", F.col("k").cast("int").alias("lid"), "gid", "owner", "own_id", "ghost_id"))

    def starts(self) -> DataFrame:
        """(part, start) of new contiguous ids, one row per part."""
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return self.lengths().select("part", (F.coalesce(F.sum("own_length").over(before), F.lit(0)) + 1).alias("start"))

    def new_ids(self) -> DataFrame:
        """(gid, new_gid): contiguous ids that follow the parts."""
        return self.own().join(self.starts(), "part").select("gid", (F.col("start") + F.col("own_id") - 1).cast("long").alias("new_gid"))

    def renumber(self, local: bool = False) -> PRange:
        """The same layout under contiguous ids; itself if it is one already.

        With ``local`` the local ids change too: own ones first, then ghosts.
        """
        if local:
            place = self.local_permutation().select("part", "lid", F.col("perm").cast("int").alias("__lid"))
            moved = self.index.join(place, ["part", "lid"]).drop("lid").withColumnRenamed("__lid", "lid")
            return replace(self, index=moved.select("part", "lid", "gid", "owner", "own_id", "ghost_id")).renumber()
        if self.blocks is not None:
            return self
        moved = self.index.join(self.new_ids(), "gid").drop("gid").withColumnRenamed("new_gid", "gid")
        own = self.lengths().join(self.starts(), "part").select("part", "start", (F.col("start") + F.col("own_length") - 1).alias("stop"))
        return PRange(moved.select("part", "lid", "gid", "owner", "own_id", "ghost_id"), self.n, self.parts, blocks=own)

    def neighbours(self) -> DataFrame:
        """(part, neighbour): owners of a part's ghosts, to which assembly sends."""
        return self.ghosts().select("part", F.col("owner").alias("neighbour")).distinct()

    def assembly_graph(self) -> DataFrame:
        """(src, snd_pos, dst, rcv_pos) of assembly, positions by part."""
        edge = self.neighbours().select(F.col("part").alias("src"), F.col("neighbour").alias("dst"))
        snd = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        rcv = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
        return edge.select("src", snd.alias("snd_pos"), "dst", rcv.alias("rcv_pos"))

    def assembly_local_indices(self) -> DataFrame:
        """(src, dst, gid, snd_lid, rcv_lid): what assembly sends and where it arrives."""
        ghost = self.ghosts().select(F.col("part").alias("src"), F.col("owner").alias("dst"), "gid", F.col("lid").alias("snd_lid"))
        own = self.own().select(F.col("part").alias("dst"), "gid", F.col("lid").alias("rcv_lid"))
        return ghost.join(own, ["dst", "gid"]).select("src", "dst", "gid", "snd_lid", "rcv_lid")

    def check_like(self, other: PRange, what: str, parts: bool = True) -> None:
        """An error unless both have as many ids (and parts)."""
        if self.n != other.n or (parts and self.parts != other.parts):
            raise ValueError(f"{what}: {self} and {other} don't match")

    def matches(self, other: PRange, kind: str = "local") -> bool:
        """Whether the ids (local, own or ghost) are the same in the same order."""
        pick = {"local": ("lid", self.index, other.index), "own": ("own_id", self.own(), other.own()), "ghost": ("ghost_id", self.ghosts(), other.ghosts())}
        order, a, b = pick[kind]
        a, b = (x.select("part", order, "gid", "owner") for x in (a, b))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def uniform_partition(spark: SparkSession, parts, n, ghost=False, periodic=False) -> PRange:
    """A Cartesian block partition in any number of dimensions; ``ghost`` counts layers."""
    dims = len(n) if isinstance(n, (tuple, list)) else 1
    shape, grid = ids.per_dim(n, dims), ids.per_dim(parts, dims)
    layers, around = [int(g) for g in ids.per_dim(ghost, dims)], ids.per_dim(periodic, dims)
    count = ids.total(grid)
    owner_of = lambda gid: ids.uniform_owner(gid, shape, grid)
    place = ids.coordinates(F.col("part"), grid)
    blocks = None
    if dims == 1:
        start, size = ids.block_start(place[0], grid[0], shape[0]), ids.block_size(place[0], grid[0], shape[0])
        blocks = parts_table(spark, count).select("part", start.cast("long").alias("start"), (start + size - 1).cast("long").alias("stop"))
    if not any(layers):  # every id by itself, over as many tasks as the session likes
        at = ids.coordinates(F.col("id"), shape)
        owners = [ids.block_owner(c, p, m) for c, p, m in zip(at, grid, shape, strict=True)]
        lid, stride = F.lit(1).cast("long"), F.lit(1).cast("long")
        for c, o, p, m in zip(at, owners, grid, shape, strict=True):
            lid, stride = lid + (c - ids.block_start(o, p, m)) * stride, stride * ids.block_size(o, p, m)
        part, lid = ids.linear_id(owners, grid).cast("int"), lid.cast("int")
        every = spark.range(1, ids.total(shape) + 1)
        index = every.select(part.alias("part"), lid.alias("lid"), F.col("id").alias("gid"), part.alias("owner"), lid.alias("own_id"), F.lit(0).alias("ghost_id"))
        return PRange(index, ids.total(shape), count, owner_of, blocks=blocks)
    out = parts_table(spark, count)
    lid, stride, coords, own = F.lit(1).cast("long"), F.lit(1).cast("long"), [], F.lit(True)
    for d in range(dims):
        a = ids.block_start(place[d], grid[d], shape[d])
        b = a + ids.block_size(place[d], grid[d], shape[d]) - 1
        first, last = a - layers[d], b + layers[d]
        if not around[d]:
            first, last = F.greatest(first, F.lit(1)), F.least(last, F.lit(shape[d]))
        out = expand(out, first, last, f"__c{d}")
        c = F.col(f"__c{d}")
        lid, stride = lid + (c - first) * stride, stride * (last - first + 1)
        own = own & (c >= a) & (c <= b)
        coords.append(ids.wrapped(c, shape[d]) if around[d] else c)
    local = out.select("part", lid.alias("lid"), ids.linear_id(coords, shape).alias("gid"), own.alias("own"))
    local = local.withColumn("owner", owner_of(F.col("gid")))
    return PRange(numbered(local), ids.total(shape), count, owner_of, blocks=blocks)


def variable_partition(spark: SparkSession, sizes: list[int], ghost: bool = False, periodic: bool = False) -> PRange:
    """Contiguous blocks of given sizes, one number per part."""
    if ghost or periodic:
        raise NotImplementedError("ghosts of variable partitions")
    table = spark.createDataFrame([(p + 1, int(s)) for p, s in enumerate(sizes)], "part int, size long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + 1).withColumn("stop", F.col("start") + F.col("size") - 1)
    rows = expand(table, F.col("start"), F.col("stop"), "gid")
    own = (F.col("gid") - F.col("start") + 1).cast("int")
    index = rows.select("part", own.alias("lid"), "gid", F.col("part").alias("owner"), own.alias("own_id"), F.lit(0).alias("ghost_id"))
    return PRange(index, sum(map(int, sizes)), len(sizes), blocks=table.select("part", "start", "stop"))


def partition_from_color(owners: DataFrame, parts: int, n: int | None = None) -> PRange:
    """Own ids of each part are the ids of its color, ascending; ``owners`` has gid and owner."""
    own = F.row_number().over(Window.partitionBy("owner").orderBy("gid"))
    table = owners.select(F.col("gid").cast("long").alias("gid"), F.col("owner").cast("int").alias("owner"))
    index = table.select(F.col("owner").alias("part"), own.alias("lid"), "gid", "owner", own.alias("own_id"), F.lit(0).alias("ghost_id"))
    return PRange(index, table.count() if n is None else n, parts, owners=table)


def trivial_partition(spark: SparkSession, parts: int, n: int, destination: int = 1) -> PRange:
    """Everything on one part."""
    rows = spark.range(1, n + 1)
    index = rows.select(F.lit(destination).alias("part"), F.col("id").cast("int").alias("lid"), F.col("id").alias("gid"), F.lit(destination).alias("owner"), F.col("id").cast("int").alias("own_id"), F.lit(0).alias("ghost_id"))
    return PRange(index, n, parts, lambda gid: F.when(gid < 1, 0).otherwise(F.lit(destination)).cast("int"))


def from_local(local: DataFrame, n: int, parts: int, owner_of: Callable[[Column], Column] | None = None) -> PRange:
    """Any local ids in any order, from (part, lid, gid, owner); ``owner_of`` says the owner of any id, where that is known."""
    return PRange(numbered(local.withColumn("own", F.col("part") == F.col("owner"))), n, parts, owner_of)


def node_to_dof_partition(nodes: PRange, per_node: int) -> PRange:
    """``per_node`` unknowns for each node, owned as their node."""
    c = F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("c")
    wide = nodes.own().select("part", "own_id", "gid", "owner", c)
    own = ((F.col("own_id") - 1) * per_node + F.col("c")).cast("int")
    index = wide.select("part", own.alias("lid"), ((F.col("gid") - 1) * per_node + F.col("c")).cast("long").alias("gid"), "owner", own.alias("own_id"), F.lit(0).alias("ghost_id"))
    owner = nodes.owner_of
    of = None if owner is None else lambda gid: F.when(gid < 1, F.lit(0)).otherwise(owner(ids.whole(gid - 1, per_node) + 1)).cast("int")
    return PRange(index, nodes.n * per_node, nodes.parts, of)
