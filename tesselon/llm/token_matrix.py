"""Packed token matrices: best-fit-decreasing with a segment tree over capacities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .packing import CAPACITY, ENCODED, WINDOW, Piece, streamed


class Rooms:
    """Open sequences by the room they have; finds the least room that is enough.

    A segment tree over room sizes: a node is set while a sequence with a room in
    its range exists.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        k = self.leaves + room
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A sequence with the smallest room >= least, which is taken out; None if there is none."""
        some, k = self.some, self.leaves + least
        while not some[k]:
            while k & 1:  # a right child: what lies to its right begins above
                k >>= 1
                if not k:
                    return None
            k += 1
            if k & (k - 1) == 0:  # past the last node of its level
                return None
        while k < self.leaves:
            k = 2 * k if some[2 * k] else 2 * k + 1
        room = k - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            some[k] = 0
            k >>= 1
            while k and not (some[2 * k] or some[2 * k + 1]):
                some[k] = 0
                k >>= 1
        return sequence, room


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Piece], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences; only overlong documents are cut."""
    parts = [(min(capacity, n - s), d, s) for d, n in enumerate(lengths.tolist()) for s in range(0, n, capacity)]
    parts.sort(key=lambda p: (-p[0], p[1], p[2]))
    rooms, pieces, used = Rooms(capacity), [], 0
    for n, d, start in parts:
        found = rooms.take(n)
        if found is None:
            found = (used, capacity)
            used += 1
        sequence, room = found
        pieces.append((d, start, n, sequence, capacity - room))
        if room > n:
            rooms.add(sequence, room - n)
    return pieces, used


def token_matrix(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    window: int = WINDOW,
    together: int = ENCODED,
) -> DataFrame:
    """One row per sequence, a row of the packed id matrix.

    sequence_id; ids: ``capacity`` little-endian uint32, padded with ``pad_id``;
    n_tokens without padding; cu_seqlens: cumulative segment lengths from 0;
    positions: ``capacity`` little-endian uint16 that restart at each segment and
    are 0 in padding; doc_ids and doc_starts of the segments. Edge cases are as
    in ``packing.pack``; capacity is at most 65536.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("positions", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(df.schema[id_col].dataType)),
            T.StructField("doc_starts", longs),
        ]
    )

    def make(names: pa.Array, ids: np.ndarray, starts: np.ndarray, free: int) -> tuple[pa.RecordBatch, int]:
        pieces, used = best_fit(np.diff(starts), capacity)
        d, start, n, at, offset = np.array(sorted(pieces, key=lambda p: (p[3], p[4])), np.int64).reshape(-1, 5).T
        size = np.bincount(at, n, used).astype(np.int64)
        source = np.repeat(starts[d] + start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        target = np.repeat(at * capacity + offset - (np.cumsum(n) - n), n) + np.arange(n.sum())
        matrix = np.full(used * capacity, pad_id, "<u4")
        matrix[target] = ids[source]
        place = np.zeros(used * capacity, "<u2")
        place[target] = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        count = np.bincount(at, minlength=used)
        first = np.concatenate(([0], np.cumsum(count)))
        bounds = np.insert((offset + n).astype(np.int32), first[:-1], 0)
        segments = pa.array(first.astype(np.int32))
        columns = [
            pa.array(np.arange(used) + free),
            pa.array([row.tobytes() for row in matrix.reshape(used, capacity)], pa.binary()),
            pa.array(size),
            pa.ListArray.from_arrays(pa.array((first + np.arange(used + 1)).astype(np.int32)), pa.array(bounds)),
            pa.array([row.tobytes() for row in place.reshape(used, capacity)], pa.binary()),
            pa.ListArray.from_arrays(segments, names.take(pa.array(d))),
            pa.ListArray.from_arrays(segments, pa.array(start)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names), used

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(streamed(tokenizer, end_id, window, together, make), schema)


def write_token_matrix(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet files of fixed-width binary rows."""
    packed.write.mode("error").parquet(path)
