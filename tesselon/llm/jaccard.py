"""Exact Jaccard join of word shingles.

Equal shingle sets are one node. Nodes meet in size-banded tiles: sizes fall in
bands so narrow that linked sets lie in the same band or in neighbouring ones, and
within two bands linked sets differ in a bounded number of shingles. The hash
space is cut into more parts than that, so linked sets agree in a part; the band,
the part and its content make the key of a tile. Tiles with the same nodes are one.

In a tile, parity bitmaps of hashed shingles are compared: the bits in which two
differ bound their overlap from above. Pairs that may be linked connect nodes to
blocks, which no link leaves, and within a block sorted arrays are intersected
exactly for pairs that aren't connected yet. Tiles and blocks too large for a task
are dealt out to chunks (see ``hot_groups``), so every task has bounded work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .components import components
from .hot_groups import NAMED, connecting_edges
from .words import mix64, one_array, slices, sums, tidy, words

#: A part may be empty in so many cases before empty parts count as content.
SPARE = 1
#: Documents and shingles of a chunk of a large block, about.
CHUNK_DOCS, CHUNK_SHINGLES = 2048, 1_000_000
#: Shingles of small blocks that share a task, about.
BUNDLE_SHINGLES = 200_000
#: Candidate rows that are broadcast to the texts at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
BITS_LEAST, BITS_MOST = 64, 32_768
#: Nodes of a chunk of a large tile, and tile rows that share a task, about.
CHUNK_NODES, BUNDLE_ROWS = 8192, 25_000
#: Tiles of so many nodes at most are compared together, all pairs of each at once.
FEW = 8
#: Nodes of a tile whose pairs are compared in one step; larger ones go node by node.
MATRIX = 256
#: Members of a chunk by which the others' partners are counted.
SEEN = 256
#: One in so many rows shows which keys have very many; seen so often, a key is dealt out by node too, the most frequent ones only.
HOT_SAMPLE, HOT_SEEN, HOT_KEYS = 1024, 16, 100_000

#: Texts whose sets a worker makes at once.
SLICE = 500

ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Likeness:
    """Link when den * intersection >= num * union, over sets of ``words``-word shingles."""

    words: int = 5
    num: int = 80
    den: int = 100

    def difference(self, both: int | np.ndarray) -> int | np.ndarray:
        """The most shingles in which linked sets of ``both`` shingles together differ."""
        return both - 2 * -(-self.num * both // (self.num + self.den))

    def bound(self, both: int) -> int:
        """The same, never falling as sets grow."""
        return (self.den - self.num) * both // (self.num + self.den)

    def bits(self, size: int) -> int:
        """Bits of the bitmap of a set, some more than linked sets of its size can differ in."""
        found = BITS_LEAST
        while found < min(BITS_MOST, 4 * self.bound(2 * size)):
            found *= 2
        return found

    @cached_property
    def bands(self) -> np.ndarray:
        """The least size of each band; the last entry is beyond any size."""
        found = [1]
        while found[-1] < 1 << 40:
            found.append(found[-1] * self.den // self.num + 1)
        return np.array(found, np.int64)

    @cached_property
    def parts(self) -> np.ndarray:
        """The parts into which each band cuts the hash space; 0 where only equal sets can be linked."""
        tops = (self.bands[1:] - 1).tolist()
        differ = [self.bound(2 * top) for top in tops]
        return np.array([d + 1 + SPARE if d else 0 for d in differ] + [0], np.int64)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and where each text's begin (and the end).

    Words are lower-cased in A-Z only. A text with fewer words than ``size`` has
    its whole sequence as one shingle; one without words has none.
    """
    split = words(pc.ascii_lower(texts))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in split.distinct.cast(pa.binary()).to_pylist()), np.uint64, len(split.distinct))
    own, n = hashed[split.codes], split.lengths()
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(starts[-1], np.uint64)
    owner = np.repeat(np.arange(len(n)), count)
    first = np.repeat(split.starts[:-1] - starts[:-1], count) + np.arange(starts[-1])
    span = np.minimum(n, size)[owner]
    for length in np.unique(span).tolist():
        at = np.flatnonzero(span == length)
        acc = np.full(len(at), length, np.uint64)
        for k in range(length):
            acc = mix64(acc * ODD + own[first[at] + k])
        out[at] = acc
    for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(n)))))


def set_names(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set that don't depend on each other."""
    size = np.diff(starts).astype(np.uint64)
    one = mix64(sums(mix64(sets), starts) + size * ODD)
    two = mix64(sums(mix64(sets ^ ODD), starts) ^ (size * ODD))
    return one, two


def tile_keys(sets: np.ndarray, starts: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for every tile of every set: those of its own band and of the next one."""
    size = np.diff(starts)
    owner = np.repeat(np.arange(len(size)), size)
    band = np.searchsorted(like.bands, size, side="right") - 1
    mixed = mix64(sets ^ np.uint64(0xA0761D6478BD642F))
    high = sets >> np.uint64(32)
    texts, keys = [], []
    for step in (0, 1):
        tile = np.minimum(band + step, len(like.parts) - 1)
        parts = np.where(size > 0, like.parts[tile], 0)
        slots = np.concatenate(([0], np.cumsum(parts)))
        cut_up = parts[owner] > 0
        at = (slots[owner] + ((high * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64))[cut_up]
        inside = np.bincount(at, minlength=slots[-1])
        total = sums(mixed[cut_up], np.concatenate(([0], np.cumsum(inside))))
        text = np.repeat(np.arange(len(size)), parts)
        place = np.arange(slots[-1]) - slots[text]
        key = mix64(total + mix64((tile[text].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)) + inside.astype(np.uint64))
        empty = np.bincount(text, inside == 0, len(size))
        kept = (inside > 0) | (empty[text] > SPARE)
        texts.append(text[kept])
        keys.append(key[kept])
    return np.concatenate(texts), np.concatenate(keys)


def rows_of(df: DataFrame, id_col: str, text_col: str, like: Likeness) -> DataFrame:
    """doc_id, row, n_shingles, node, check, bitmap and tile keys of every row; node is null for an empty set.

    ``row`` is a hash of the identifier and the text, by which the text is found
    again. Of equal sets that come together only the first has its keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts in enumerate(slices(batch.column(2), SLICE)):
                sets, starts = shingle_sets(texts, like.words)
                node, check = set_names(sets, starts)
                n = np.diff(starts)
                maps = [bitmap(sets[a:b], like.bits(b - a)).tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
                first = np.zeros(len(node), bool)
                first[np.unique(node, return_index=True)[1]] = True
                text, key = tile_keys(sets, starts, like)
                text, key = text[first[text]], key[first[text]]  # equal sets have equal keys
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(n))))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[np.argsort(text, kind="stable")].view(np.int64)))
                own = batch.slice(k * SLICE, SLICE)
                columns = [own.column(0), own.column(1), pa.array(n), pa.array(node.view(np.int64), mask=n == 0), pa.array(check.view(np.int64)), pa.array(maps, pa.binary()), keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "node", "check", "bitmap", "keys"])
            tidy()

    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = df.select(ident.alias("doc_id"), row_of(ident, text).alias("row"), text)
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, node long, check long, bitmap binary, keys array<long>")


def row_of(ident: Column, text: Column) -> Column:
    return F.xxhash64(ident.cast("long"), text)


def tiles_of(docs: DataFrame) -> DataFrame:
    """(tile, nodes, node): the nodes of each tile that has several, tiles with the same nodes being one.

    Keys of very many rows, as a sample shows them, are dealt out by node as
    well; the others are sorted key by key. Both ways give the same rows.
    """
    rows = docs.filter("node is not null").select(F.explode("keys").alias("key"), "node")
    often = rows.filter(F.rand(11) < 1 / HOT_SAMPLE).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_SEEN)
    hot = cut(often.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key"))
    if hot.isEmpty():
        return shared_tiles(rows)
    spread = rows.join(F.broadcast(hot), "key", "left_semi").distinct()
    one, two = (F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2))
    tiles = spread.groupBy("key").agg(F.count("*").alias("nodes"), one.alias("one"), two.alias("two")).filter("nodes > 1")
    tiles = tiles.select("key", F.xxhash64("nodes", "one", "two").alias("tile"), "nodes")
    wide = spread.join(F.broadcast(tiles), "key").select("tile", "nodes", "node")  # HOT_KEYS tiles at most
    return shared_tiles(rows.join(F.broadcast(hot), "key", "left_anti")).unionByName(wide).distinct()


def shared_tiles(rows: DataFrame) -> DataFrame:
    """(tile, nodes, node) of the keys (key, node) that several nodes have; keys with the same nodes are one tile."""
    by, whole = Window.partitionBy("key").orderBy("node"), Window.partitionBy("key")
    rows = rows.withColumn("before", F.lag("node").over(by)).withColumn("after", F.lead("node").over(by))
    rows = rows.filter("before is not null or after is not null")  # most keys have one row
    # Equal sets of other batches repeat rows, so a node counts where it comes first.
    rows = rows.select("key", "node", F.coalesce(F.col("before") != F.col("node"), F.lit(True)).alias("new"))
    rows = rows.withColumn("nodes", F.sum(F.col("new").cast("long")).over(whole))
    # An exclusive or can't overflow, however many nodes there are.
    one, two = (F.bit_xor(F.when(F.col("new"), F.xxhash64("node", F.lit(k)))).over(whole) for k in (1, 2))
    rows = rows.withColumn("one", one).withColumn("two", two).filter("nodes > 1 and new")
    return rows.select(F.xxhash64("nodes", "one", "two").alias("tile"), "nodes", "node").distinct()


def edges_of(docs: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): pairs of nodes that may be linked and connect what all such pairs connect."""
    tiles = cut(tiles_of(docs).select(F.col("tile").alias("group"), "nodes", F.col("node").alias("item")))
    maps = docs.filter("node is not null").groupBy(F.col("node").alias("item")).agg(F.first("n_shingles").alias("size"), F.first("bitmap").alias("bitmap"))
    bundles = max(1, -(-tiles.count() // BUNDLE_ROWS))

    def compare(rows: DataFrame, hubs: bool) -> DataFrame:
        joined = rows.join(maps, "item").select("task", "i", "j", "group", "item", "side", "size", "bitmap")

        def run(part: pa.Table) -> pa.Table:
            part = part.combine_chunks().sort_by([("group", "ascending"), ("size", "ascending"), ("item", "ascending")])
            group, item, side, size = (np.asarray(part.column(c)) for c in ("group", "item", "side", "size"))
            bitmaps = Bitmaps(part.column("bitmap").to_pylist())
            a, b = possible_edges(group, size, side, bitmaps, like)
            top, degree = central(Closeness(size, side, bitmaps.alike(np.arange(len(size))), like), NAMED) if hubs else (a[:0], a[:0])
            return edge_table(group[np.concatenate((a, top))], item[a], item[b], item[top], degree)

        return joined.groupBy("task", "i", "j").applyInArrow(run, EDGES)

    small = tiles.filter(F.col("nodes") <= CHUNK_NODES).select("group", "item", F.pmod("group", F.lit(bundles)).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(2).alias("side"))
    edges = compare(small, False).select("a", "b")
    large = cut(tiles.filter(F.col("nodes") > CHUNK_NODES).select("group", "item", F.ceil(F.col("nodes") / CHUNK_NODES).cast("int").alias("chunks")))
    if large.isEmpty():
        return edges.distinct()
    edges = cut(edges.distinct())
    return edges.unionByName(connecting_edges(large, edges, compare)).distinct()


#: What the tasks of a comparison return: edges, or members with their number of possible partners.
EDGES = "group long, a long, b long, degree long"


def edge_table(group: np.ndarray, a: np.ndarray, b: np.ndarray, top: np.ndarray, degree: np.ndarray) -> pa.Table:
    edge = np.arange(len(a) + len(top)) < len(a)
    both = lambda x, y: np.concatenate((np.asarray(x, np.int64), np.asarray(y, np.int64)))
    columns = {"group": pa.array(group, pa.int64()), "a": pa.array(both(a, top))}
    return pa.table(columns | {"b": pa.array(both(b, top), mask=~edge), "degree": pa.array(both(b, degree), mask=edge)})


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the hashed shingles at each of ``bits`` places."""
    place = ((own >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little")


class Bitmaps:
    """Bitmaps by width; a wider one is folded to the width of what it is compared with."""

    def __init__(self, rows: list[bytes]):
        width = np.array([len(r) for r in rows], np.int64)
        self.width = width
        self.place = np.zeros(len(rows), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            self.place[at] = np.arange(len(at))
            self.tables[w] = np.frombuffer(b"".join(rows[k] for k in at), np.uint64).reshape(len(at), w // 8)

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(rows), width // 8), np.uint64)
        for w in np.unique(self.width[rows]).tolist():
            at = self.width[rows] == w
            found = self.tables[w][self.place[rows[at]]]
            while found.shape[1] > width // 8:
                half = found.shape[1] // 2
                found = found[:, :half] ^ found[:, half:]
            out[at] = found
        return out

    def alike(self, rows: np.ndarray) -> np.ndarray:
        """The bitmaps of rows at the least of their widths."""
        return self.folded(rows, int(self.width[rows].min()))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the bitmaps of rows a and b differ."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.width[a], self.width[b])
        for w in np.unique(least).tolist():
            for at in np.array_split(np.flatnonzero(least == w), 1 + len(a) * w // 8_000_000):
                out[at] = np.bitwise_count(self.folded(a[at], w) ^ self.folded(b[at], w)).sum(axis=1, dtype=np.int64)
        return out


def reach(n: int, partners: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Edges (f, others) of a spanning forest; ``partners`` tells which of some nodes are f's.

    Nodes that were reached are not asked about again, so a group of alike nodes takes one step.
    """
    left = np.arange(n)
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            f = front.pop()
            hit = partners(f, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                front.extend(found.tolist())
                yield f, found


@dataclass
class Closeness:
    """Which nodes of a group may be linked by size, side and bitmap."""

    size: np.ndarray
    side: np.ndarray
    maps: np.ndarray
    like: Likeness

    def all_pairs(self) -> np.ndarray:
        """The same for all pairs of a small group."""
        a, b = self.size[:, None], self.size[None, :]
        good = (self.like.num * np.maximum(a, b) <= self.like.den * np.minimum(a, b)) & ((self.side[:, None] != self.side[None, :]) | (self.side == 2)[:, None])
        np.fill_diagonal(good, False)
        i, j = np.nonzero(good)
        apart = np.bitwise_count(self.maps[i] ^ self.maps[j]).sum(axis=1, dtype=np.int64)
        good[i, j] = apart <= self.like.difference(self.size[i] + self.size[j])
        return good

    def partners(self, f: int, others: np.ndarray) -> np.ndarray:
        own, size = self.size[f], self.size[others]
        good = (self.like.num * np.maximum(size, own) <= self.like.den * np.minimum(size, own)) & ((self.side[others] != self.side[f]) | (self.side[f] == 2))
        at = np.flatnonzero(good)
        apart = np.bitwise_count(self.maps[others[at]] ^ self.maps[f]).sum(axis=1, dtype=np.int64)
        good[at] = apart <= self.like.difference(own + size[at])
        return good


def central(may: Closeness, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The members with the most possible partners among SEEN of them, and how many those are."""
    n = len(may.size)
    degree = np.zeros(n, np.int64)
    for f in np.unique(np.linspace(0, n - 1, min(n, SEEN)).astype(np.int64)).tolist() if n and most else []:
        degree += may.partners(f, np.arange(n))
    best = np.argsort(-degree, kind="stable")[:most]
    return best, degree[best]


def possible_edges(tile: np.ndarray, size: np.ndarray, side: np.ndarray, maps: Bitmaps, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b that may be linked and connect what all such pairs of a tile connect; rows come by tile and size."""
    bounds = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True]))) if len(tile) else np.zeros(1, np.int64)
    first, count = bounds[:-1], np.diff(bounds)
    out_a, out_b = [], []
    for n in range(2, FEW + 1):
        at = first[count == n]
        i, j = np.triu_indices(n, 1)
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        near = (like.den * size[a] >= like.num * size[b]) & ((side[a] != side[b]) | (side[a] == 2))
        a, b = a[near], b[near]
        good = maps.apart(a, b) <= like.difference(size[a] + size[b])
        out_a.append(a[good])
        out_b.append(b[good])
    for s, n in zip(first[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
        may = Closeness(size[s : s + n], side[s : s + n], maps.alike(np.arange(s, s + n)), like)
        pairs = may.all_pairs() if n <= MATRIX else None
        some = np.arange(n) if pairs is None else np.flatnonzero(pairs.any(axis=1))
        known = may.partners if pairs is None else (lambda f, others, pairs=pairs[np.ix_(some, some)]: pairs[f, others])
        for f, found in reach(len(some), known):
            out_a.append(np.full(len(found), s + some[f]))
            out_b.append(s + some[found])
    return np.concatenate(out_a), np.concatenate(out_b)


def spanning_links(sets: list[np.ndarray], side: np.ndarray, like: Likeness, named: int = 0) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links (places of two sets) that connect what all links connect, and the ``named`` most central sets with their degrees.

    side 0 and 1 are two chunks, of which only pairs across count; 2 is compared with everything.
    """
    size = np.array([len(s) for s in sets], np.int64)
    rows = Bitmaps([bitmap(s, like.bits(len(s))).tobytes() for s in sets])
    may = Closeness(size, side, rows.alike(np.arange(len(sets))), like)

    def linked(f: int, others: np.ndarray) -> np.ndarray:
        hit = may.partners(f, others)
        own = sets[f]
        for k in np.flatnonzero(hit).tolist():
            other = sets[others[k]]
            same = int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum())
            hit[k] = like.den * same >= like.num * (len(own) + len(other) - same)
        return hit

    links = [(f, k) for f, found in reach(len(sets), linked) for k in found.tolist()]
    return links, *central(may, named)


def links_of(df: DataFrame, id_col: str, text_col: str, found: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): links between items that connect what all links connect.

    ``found`` has item, row, node, block and n_shingles of a first row of each
    distinct set that may be linked.
    """
    sizes = found.groupBy("block").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    big = sizes.filter((F.col("docs") > CHUNK_DOCS) | (F.col("shingles") > CHUNK_SHINGLES))
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    big = cut(big.select("block", chunks.alias("chunks")))
    placed = found.join(F.broadcast(big) if big.count() <= BROADCAST_ROWS else big, "block", "left").select("item", "row", "node", F.col("block").alias("group"), "chunks", "n_shingles")
    total = found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bundle = F.pmod(F.xxhash64("group"), F.lit(max(1, -(-total // BUNDLE_SHINGLES))))
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    texts = df.select(row_of(ident, text).alias("row"), text.alias("text"))

    def compare(rows: DataFrame, hubs: bool) -> DataFrame:
        rows = cut(rows.select("task", "i", "j", "side", "group", "item", "row", "node"))
        few = rows.count() <= BROADCAST_ROWS
        joined = texts.join(F.broadcast(rows) if few else rows, "row").select("task", "i", "j", "group", "item", "node", "side", "text")

        def run(part: pa.Table) -> pa.Table:
            part = part.combine_chunks()
            sets, starts = shingle_sets(one_array(part.column("text")), like.words)
            node = set_names(sets, starts)[0].view(np.int64)
            group, item, named, side_ = (np.asarray(part.column(c)) for c in ("group", "item", "node", "side"))
            use = np.flatnonzero(node == named)
            _, once = np.unique(np.stack([group[use], item[use], side_[use]]), axis=1, return_index=True)
            use = use[once]
            bounds = np.flatnonzero(np.concatenate(([True], group[use][1:] != group[use][:-1], [True]))).tolist() if len(use) else []
            tables = []
            for s, e in zip(bounds, bounds[1:], strict=False):
                own = use[s:e]
                links, top, degree = spanning_links([sets[starts[k] : starts[k + 1]] for k in own], side_[own], like, NAMED if hubs else 0)
                a, b = np.array(links, np.int64).reshape(-1, 2).T
                tables.append(edge_table(np.full(len(a) + len(top), group[own[0]]), item[own[a]], item[own[b]], item[own[top]], degree))
            return pa.concat_tables(tables) if tables else edge_table(*[np.zeros(0, np.int64)] * 5)

        return joined.groupBy("task", "i", "j").applyInArrow(run, EDGES)

    small = placed.filter("chunks is null").withColumn("task", bundle).withColumn("i", F.lit(-1)).withColumn("j", F.lit(-1)).withColumn("side", F.lit(2))
    links = compare(small, False).select("a", "b")
    if big.isEmpty():
        return links
    links = cut(links)
    return links.unionByName(connecting_edges(placed.filter("chunks is not null"), links, compare))


def _joined(df: DataFrame, like: Likeness, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, n_shingles and component_id of every row."""
    docs = cut(rows_of(df, id_col, text_col, like))
    blocks = cut(components(edges_of(docs, like)))
    key = ["node", "n_shingles", "check"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    groups = docs.filter("node is not null").groupBy(*key).agg(least, F.count("*").alias("rows"))
    groups = cut(groups.join(blocks.withColumnRenamed("root", "block"), "node", "left").filter("rows > 1 or block is not null").select(*key, "rows", "least.doc_id", "least.row", "block", F.monotonically_increasing_id().alias("item")))
    links = links_of(df, id_col, text_col, groups.filter("block is not null"), like)
    linked = cut(components(links).join(groups.select(F.col("item").alias("node"), "doc_id"), "node"))
    names = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = linked.select(F.col("node").alias("item"), "root").join(names, "root").select("item", "component_id", F.lit(True).alias("linked"))
    groups = groups.join(linked, "item", "left").filter("rows > 1 or linked")
    groups = groups.select(*key, F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.lit(True).alias("grouped"))
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return docs.select("doc_id", "row", *key).join(groups, key, "left").select("doc_id", "row", "n_shingles", component.alias("component_id"))


def jaccard_join(df: DataFrame, like: Likeness | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; component_id is the least identifier that links reach.

    Null or wordless text has an empty set and is linked with nothing, itself
    included: its component is its own identifier. Texts with fewer words than a
    shingle are linked with equal sequences only. Repeated rows get the same
    answer each, and different texts under one identifier are documents of their
    own; a null identifier is linked like any other but never names a component (a
    component without any identifier has null). Texts of any length are compared
    whole; an empty table gives an empty result. Other columns are ignored.
    Identifiers are integers.
    """
    return _joined(df, like or Likeness(), id_col, text_col).drop("row")


def drop_near_copies(df: DataFrame, like: Likeness | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns: of each component the rows of its least identifier.

    A component without any identifier stays whole, as nothing tells its rows apart.
    """
    found = _joined(df, like or Likeness(), id_col, text_col)
    gone = cut(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias("__gone")).distinct())
    small = F.broadcast(gone) if gone.count() <= 5 * BROADCAST_ROWS else gone
    return df.join(small, row_of(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")) == F.col("__gone"), "left_anti")
