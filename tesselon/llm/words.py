"""Words of a batch of texts as codes into the batch's distinct words."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


@dataclass
class Words:
    """codes: one per word; starts: where each text's words begin, and the end; distinct: the words."""

    codes: np.ndarray
    starts: np.ndarray
    distinct: pa.Array

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.lengths())


#: Texts that a worker handles at once; an Arrow batch may hold many more.
SLICE = 1000


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """A batch in parts that bound a worker's memory; one empty part for an empty batch.

    What a part has taken is given back before the next one comes.
    """
    for k in range(0, max(len(texts), 1), size):
        yield one_array(texts.slice(k, size))
        tidy()


def tidy() -> None:
    """Give back what this worker would otherwise keep."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Strings without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def words(texts: pa.Array) -> Words:
    """Split at space and the characters 9 to 13; a text without words has none."""
    split = pc.ascii_split_whitespace(texts)
    flat, starts = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
    starts = starts - starts[0] if len(starts) else np.zeros(1, np.int64)
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not real.all():
        kept = np.concatenate(([0], np.cumsum(real)))
        flat, starts = flat.filter(pa.array(real)), kept[starts]
    coded = flat.dictionary_encode()
    return Words(np.asarray(coded.indices, dtype=np.int64), starts, coded.dictionary)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the values of each text; 0 for one without any."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[starts[1:]] - total[starts[:-1]]


def unique_per_text(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs, sorted, and how often each occurs; codes >= 0."""
    width = int(codes.max()) + 1 if len(codes) else 1
    pairs, times = np.unique(owner * width + codes, return_counts=True)
    return pairs // width, pairs % width, times


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
