"""Quality rules: plain counts, then a hashed n-gram logistic regression.

A text that the counts reject fails. Of the others, a logistic regression over
hashed words, word pairs and character 4-grams, learned from labelled rows and
calibrated on a part of them that the weights were not learned from, gives the
probability of good quality, which is held against a fixed threshold. Texts are
scored in Arrow batches; features are relative frequencies, so length cancels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from .common import HELD_OUT, fold
from .toxicity import labelled
from .words import Words, mix64, one_array, slices, sums, tidy, unique_per_text, words

#: Labelled rows to learn from, at most, of each class.
FIT_GOOD, FIT_BAD = 3000, 3000
#: Bytes of their features at most, of each class; very long texts make the sample smaller, never shorter.
FIT_BYTES = 100_000_000
BITS = 17
#: Feature spaces, one after another: words, word pairs, character 4-grams.
SPACES = 3
SCALE = 20.0
GOOD_FROM = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Bytes whose character n-grams are formed at once.
STRIDE = 1 << 22

SPACE_BYTES = (0x20, *range(0x09, 0x0E))
SYMBOL_BYTES = tuple(b"#*$%&|<>")


def _class(values: tuple[int, ...]) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(values)] = True
    return found


BLANK, SYMBOL = _class(SPACE_BYTES), _class(SYMBOL_BYTES)
LETTER_START = ~BLANK & ((np.arange(256) & 0xC0) != 0x80)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (and the end)."""
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[starts[0] : starts[-1]], starts - starts[0]


def counted(texts: pa.Array, kind: np.ndarray) -> np.ndarray:
    """How many bytes of a class each text has."""
    data, starts = raw(texts)
    total = np.zeros(len(texts), np.int64)
    for p in range(0, len(data), STRIDE):
        part = kind[data[p : p + STRIDE]].astype(np.int64)
        a, b = np.searchsorted(starts, p, side="right") - 1, np.searchsorted(starts, p + len(part))
        total[a:b] += sums(part, np.clip(starts[a : b + 1] - p, 0, len(part)))
    return total


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """How many lines with a word equal an earlier line of their text."""
    lines = pc.split_pattern(texts, "\n")
    coded = lines.flatten().dictionary_encode()
    codes, starts = np.asarray(coded.indices, np.int64), np.asarray(lines.offsets, np.int64)
    real = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0)) if len(coded.dictionary) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    worded = real[codes]
    text, _, times = unique_per_text(owner[worded], codes[worded])
    return np.bincount(text, times - 1, len(texts)).astype(np.int64)


def repeated_words(split: Words) -> np.ndarray:
    """How many words lie in a three-word window that their text has twice or more."""
    n = len(split.starts) - 1
    owner, codes = split.owner(), split.codes
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    width = len(split.distinct)
    _, pair = np.unique(codes[inside] * width + codes[inside + 1], return_inverse=True)
    _, triple = np.unique(pair * width + codes[inside + 2], return_inverse=True)
    _, which, times = np.unique(owner[inside] * (triple.max() + 1 if len(triple) else 1) + triple, return_inverse=True, return_counts=True)
    often = inside[times[which] > 1]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[often + k] = True
    return np.bincount(owner[covered], minlength=n)


def base_counts(texts: pa.Array, split: Words) -> dict[str, np.ndarray]:
    return {
        "n_words": split.lengths(),
        "word_chars": counted(texts, LETTER_START),
        "n_symbols": counted(texts, SYMBOL),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeated_words(split),
    }


def word_buckets(split: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of each pair of neighbours."""
    hashed = np.fromiter((zlib.crc32(w.encode()) for w in split.distinct.to_pylist()), np.uint64, len(split.distinct))
    own, owner = hashed[split.codes], split.owner()
    low = np.uint64((1 << BITS) - 1)
    single = mix64(own) & low
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    second = own[inside + 1].copy()
    second[own[inside] == own[inside + 1]] = 0  # a word said twice is one feature, whatever the word
    first = np.where(second == 0, np.uint64(1), own[inside])
    double = mix64((first << np.uint64(32)) | second) & low
    return owner, single.astype(np.int64), owner[inside], double.astype(np.int64) + (1 << BITS)


def char_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each run of four bytes, part by part."""
    data, starts = raw(texts)
    for p in range(0, max(0, len(data) - 3), STRIDE):
        part = data[p : p + STRIDE + 3].astype(np.uint32)
        code = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        place = np.arange(p, p + len(code))
        a, b = np.searchsorted(starts, p, side="right") - 1, np.searchsorted(starts, p + len(code))
        inside = np.clip(np.diff(np.clip(starts[a : b + 1], p, p + len(code))), 0, None)
        owner = np.repeat(np.arange(a, b), inside)
        whole = place + 4 <= starts[owner + 1]
        yield owner[whole], bucket[whole].astype(np.int64) + (2 << BITS)


@dataclass
class QualityModel:
    """weights: a row of buckets for each feature space; scale and shift: the calibration of the margin."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, texts: pa.Array, split: Words) -> np.ndarray:
        n = len(texts)
        z = np.full(n, self.bias)
        w = self.weights
        one, single, two, double = word_buckets(split)
        for owner, bucket in ((one, single), (two, double)):
            z += SCALE * np.bincount(owner, w[bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1)
        total, size = np.zeros(n), np.zeros(n)
        for owner, bucket in char_buckets(texts):
            total += np.bincount(owner, w[bucket], n)
            size += np.bincount(owner, minlength=n)
        return z + SCALE * total / np.maximum(size, 1)

    def score(self, texts: pa.Array, split: Words) -> np.ndarray:
        """The calibrated probability that each text is good."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(texts, split) + self.shift, -30, 30)))

    @staticmethod
    def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, epochs: int = 12, rate: float = 0.02, decay: float = 1e-6, seed: int = 3) -> QualityModel:
        """From (bucket, value) arrays of each text; ``prior`` is the share of good texts to calibrate for."""
        rng = np.random.default_rng(seed)
        y = np.asarray(labels, np.float64)
        w = np.zeros(SPACES << BITS)
        if len(set(y.tolist())) < 2:
            return QualityModel(w, 4.0 if not len(y) or y[0] == 1 else -4.0)
        order = rng.permutation(len(y))
        held, learn = order[: len(y) // 5], order[len(y) // 5 :]
        m, s = np.zeros_like(w), np.zeros_like(w)
        bias = bm = bs = 0.0
        at = 0

        def margins(rows: np.ndarray) -> np.ndarray:
            return np.array([bias + float(w[features[k][0]] @ features[k][1]) for k in rows])

        for _ in range(epochs):
            for k in range(0, len(learn), 128):
                rows, at = rng.choice(learn, min(128, len(learn)), replace=False), at + 1
                z = margins(rows)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                grad = np.bincount(np.concatenate([features[r][0] for r in rows]), np.concatenate([features[r][1] * e for r, e in zip(rows, g, strict=True)]), len(w)) + decay * w
                m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
                w -= rate * (m / (1 - 0.9**at)) / (np.sqrt(s / (1 - 0.999**at)) + 1e-8)
                bm, bs = 0.9 * bm + 0.1 * g.sum(), 0.999 * bs + 0.001 * g.sum() ** 2
                bias -= rate * (bm / (1 - 0.9**at)) / (np.sqrt(bs / (1 - 0.999**at)) + 1e-8)
        z, t = margins(held), y[held]
        share = np.clip(t.mean(), 0.05, 0.95)
        weight = np.where(t == 1, prior / share, (1 - prior) / (1 - share))
        a, b = 1.0, 0.0
        for _ in range(500):  # Platt's two numbers, with targets away from 0 and 1
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            e = weight * (p - np.where(t == 1, 0.98, 0.02))
            a, b = a - 0.05 * float((e * z).mean()), b - 0.05 * float(e.mean())
        return QualityModel(w.astype(np.float32), bias, max(a, 0.05), b)


def features_of(texts: pa.Array, split: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their scaled relative frequencies."""
    one, single, two, double = word_buckets(split)
    chars = [*char_buckets(texts)]
    parts = []
    groups = [(one, single), (two, double), (np.concatenate([c[0] for c in chars] or [np.zeros(0, np.int64)]), np.concatenate([c[1] for c in chars] or [np.zeros(0, np.int64)]))]
    for owner, bucket in groups:
        text, found, times = unique_per_text(owner, bucket)
        size = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        parts.append((text, found, SCALE * times / size[text]))
    text, bucket, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(text, kind="stable")
    bounds = np.searchsorted(text[order], np.arange(len(texts) + 1))
    return [(bucket[order][a:b].astype(np.int32), value[order][a:b].astype(np.float32)) for a, b in zip(bounds, bounds[1:], strict=False)]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from at most FIT_GOOD and FIT_BAD labelled rows outside the held-out fold.

    Rows are taken by hashed id while their features are FIT_BYTES together. The
    share of good texts to calibrate for is that of all labels outside the
    held-out fold.
    """
    sample = labelled(df, labels, label_col, {1: FIT_GOOD, 0: FIT_BAD}, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = one_array(part.column(2))
                found = features_of(texts, words(texts))
                columns = [part.column(0), part.column(1), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["place", "label", "buckets", "values"])

    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("buckets", T.BinaryType()), T.StructField("values", T.BinaryType())])
    made = cut(sample.select(F.xxhash64("__id"), "__label", "__text").mapInArrow(run, schema))
    along = Window.partitionBy("label").orderBy("place", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    sizes = made.select("label", "place", F.octet_length("buckets").alias("size"), F.xxhash64("buckets", "values").alias("mark"))
    sizes = sizes.withColumn("upto", F.sum(F.col("size") * 2).over(along)).filter(F.col("upto") <= FIT_BYTES)  # a row for each learned text
    rows = made.withColumn("mark", F.xxhash64("buckets", "values")).join(F.broadcast(sizes.select("place", "mark").distinct()), ["place", "mark"], "left_semi")
    rows = rows.select("label", "buckets", "values").toArrow().to_pydict()
    order = sorted(range(len(rows["label"])), key=lambda k: (rows["label"][k], zlib.crc32(rows["buckets"][k]), rows["buckets"][k]))
    features = [(np.frombuffer(rows["buckets"][k], np.int32), np.frombuffer(rows["values"][k], np.float32)) for k in order]
    learned = labels.filter(fold(F.col(f"`{id_col}`")) != HELD_OUT)
    share = learned.agg(F.avg((F.col(f"`{label_col}`").cast("int") == 1).cast("double"))).first()[0]
    return QualityModel.fit(features, np.array([rows["label"][k] for k in order]), float(np.clip(share if share is not None else 0.5, 0.05, 0.95)))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(model: QualityModel, text: Column) -> Column:
    """A struct of the counts, base_failed, probability and kept as a column."""
    schema = T.StructType([*(T.StructField(f, T.LongType()) for f in FIELDS), T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for texts in slices(batch):
                split = words(texts)
                found = base_counts(texts, split)
                failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
                good = model.score(texts, split)
                columns = [pa.array(found[f], pa.int64()) for f in FIELDS] + [pa.array(failed), pa.array(good), pa.array(~failed & (good >= GOOD_FROM))]
                parts.append(pa.StructArray.from_arrays(columns, schema.names))
            yield pa.concat_arrays(parts)
            tidy()

    return run.asNondeterministic()(text)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """All rows and columns of ``df`` plus a struct ``quality`` (counts, base_failed, probability, kept).

    Null text has no words and so fails, as does an empty one; repeated rows are
    each judged; very long texts count whole; with labels of one class only every
    probability is the same, and without labels nothing but the counts rejects; an
    empty table gives an empty result. Other columns pass
    through, but one named ``quality`` is replaced.
    """
    model = fit(df, labels, id_col, text_col, label_col)
    return df.withColumn("quality", judged(model, F.col(f"`{text_col}`")))
