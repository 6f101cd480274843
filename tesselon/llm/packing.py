"""Cost-balanced packing of documents into sequences for training.

The cost of a piece is estimated as linear plus quadratic in its tokens
(projections and attention). Documents are taken in descending order and go to
the sequence of lowest cost that has room; one that fits nowhere is cut to fill
the room that is left. What is over after the full sequences makes sequences
whose lengths are powers of two, which need no padding.

Tokens are packed as they stream through a task, in windows of bounded size, so
nothing is shuffled and a lost task is redone by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import codec, with_end
from .words import slices, tidy

CAPACITY = 4096
#: Tokens that are packed together.
WINDOW = 1_000_000
#: Texts that are encoded together; more share more words and take more memory.
ENCODED = 3000
#: Room for the sequence numbers of one task.
TASK_BITS = 40

Piece = tuple[int, int, int, int, int]


def spread(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = 1 / CAPACITY) -> tuple[list[Piece], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences.

    ``quadratic`` is the attention cost of a token pair when a token's linear cost is 1.
    """
    pieces: list[Piece] = []
    used = 0
    rest: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(lengths.tolist()):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, used, 0))
            used += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    full = sum(r[0] for r in rest) // capacity
    room, cost = np.full(full, capacity, np.int64), np.zeros(full)
    over: list[tuple[int, int, int]] = []

    def put(n: int, d: int, start: int, at: int) -> None:
        pieces.append((d, start, n, used + at, capacity - int(room[at])))
        room[at] -= n
        cost[at] += n + quadratic * n * n

    for n, d, start in rest:
        while n:
            fits = room >= n
            if fits.any():
                put(n, d, start, int(np.where(fits, cost, np.inf).argmin()))
                break
            at = int(room.argmax()) if full else 0
            part = int(room[at]) if full else 0
            if not part:
                over.append((n, d, start))
                break
            put(part, d, start, at)
            n, start = n - part, start + part
    used += full
    left, offset = 0, 0  # room and place in the open sequence
    todo = sum(n for n, _, _ in over)
    for n, d, start in over:
        while n:
            if not left:
                left, offset, used = 1 << (todo.bit_length() - 1), 0, used + 1
            part = min(n, left)
            pieces.append((d, start, part, used - 1, offset))
            n, start, left, offset, todo = n - part, start + part, left - part, offset + part, todo - part
    return pieces, used


def windows(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int, together: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(identifiers, ids, starts) of at most ``window`` tokens, or of one longer document."""
    encode = codec(tokenizer).encode
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        names = pa.concat_arrays([h[0] for h in held])
        lengths = np.concatenate([h[2] for h in held])
        return names, np.concatenate([h[1] for h in held]), np.concatenate(([0], np.cumsum(lengths)))

    encoded = ((batch.column(0).slice(k * together, together), with_end(*encode(texts), end_id)) for batch in batches for k, texts in enumerate(slices(batch.column(1), together)))
    for own, (ids, starts) in encoded:
        at, n = 0, len(own)
        while at < n:
            upto = max(at + (not held), int(np.searchsorted(starts, starts[at] + window - size, side="right")) - 1)
            if upto > at:
                held.append((own.slice(at, upto - at), ids[starts[at] : starts[upto]], np.diff(starts[at : upto + 1])))
                size += int(starts[upto] - starts[at])
            at = upto
            if at < n:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def streamed(tokenizer: str, end_id: int, window: int, together: int, make: Callable[[pa.Array, np.ndarray, np.ndarray, int], tuple[pa.RecordBatch, int]]):
    """A function for mapInArrow that packs window after window; ``make`` also gets the first free sequence number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = TaskContext.get().partitionId() << TASK_BITS
        for names, ids, starts in windows(batches, tokenizer, end_id, window, together):
            out, used = make(names, ids, starts, free)
            free += used
            step = 4000
            for k in range(0, out.num_rows, step):
                yield out.slice(k, step)
        tidy()

    return run


def binary(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Little-endian bytes of several stretches of ids."""
    return pa.array([ids[s : s + n].tobytes() for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)], pa.binary())


def pack(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    quadratic: float = 1 / CAPACITY,
    window: int = WINDOW,
    together: int = ENCODED,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    ``tokenizer`` is a path or the name of an installed public tokenizer file;
    every document ends with ``end_id``. Null text counts as empty and gives the
    end alone; repeated rows are packed each; a null identifier stays null; an
    empty table gives no pieces; a document of any length is cut into pieces that
    hold each id once. Other columns are ignored. Sequence numbers are unique and
    depend on how the input is split into tasks. ``window`` (tokens packed together)
    and ``together`` (texts encoded together) bound a worker's memory.
    """
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
    )

    def make(names: pa.Array, ids: np.ndarray, starts: np.ndarray, free: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.diff(starts)
        pieces, used = spread(lengths, capacity, quadratic)
        d, start, n, at, offset = np.array(pieces, np.int64).reshape(-1, 5).T
        columns = [names.take(pa.array(d)), pa.array(start), pa.array(n), binary(ids, starts[d] + start, n), pa.array(lengths[d]), pa.array(at + free), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, schema.names), used

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(streamed(tokenizer, end_id, window, together, make), schema)
