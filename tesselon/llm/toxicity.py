"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased letter and digit runs of a text and their beginnings of
four to seven characters, hashed to 32 bits, and such terms again when they are
frequent in the text. The machine has a weight and a
factor vector for each term that tells toxic from clean labelled texts apart, so
besides what a term says alone it learns what pairs of terms say together (an
insult beside a group's name). A text is the set of its active terms, so its
length doesn't dilute them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from .common import fold
from .words import Words, slices, tidy, unique_per_text, words

#: Labelled rows to learn from, at most, of each class.
FIT_TOXIC, FIT_CLEAN = 4000, 8000
FACTORS = 4
#: Labelled texts whose terms are handed over at once.
FIT_SLICE = 200
THRESHOLD = 0.7
#: The least statistic of an active term; 18 is passed by chance once in 45,000 terms.
LEAST_GAIN = 18.0
#: The least number of texts that an active term is in.
LEAST_TEXTS = 3
#: Minima of a text's terms, how many make a band, and how many near copies share.
MINIMA, BAND, ALIKE = 16, 4, 10
PREFIXES = (4, 5, 6, 7)
#: Shares of a text's words from which a repeated term also counts as a frequent one, and the marks of those terms.
LEVELS = ((0.005, 0x5BD1E995), (0.01, 0x27D4EB2F), (0.02, 0x165667B1))
RUN = re.compile(r"[^\W_]+")


def terms(word: str) -> list[int]:
    """The hashed terms of a word."""
    found = []
    for run in RUN.findall(word.lower()):
        found.append(zlib.crc32(run.encode()))
        for n in PREFIXES:
            if len(run) > n:
                found.append(zlib.crc32(f"{run[:n]}~".encode()))
    return found


def leveled(owner: np.ndarray, hashed: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs of terms as they occur, and of those that repeat often for their text's words."""
    text, term, times = unique_per_text(owner, hashed.astype(np.int64))
    texts, terms_ = [text], [term]
    for rate, mark in LEVELS:
        often = (times >= 2) & (times >= rate * sizes[text])
        texts.append(text[often])
        terms_.append(term[often] ^ mark)
    return np.concatenate(texts), np.concatenate(terms_)


def occurring(split: Words, each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for each occurrence, given the terms of each distinct word."""
    count = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.array([t for own in each for t in own], np.int64)
    first = np.cumsum(count) - count
    hit = count[split.codes] > 0
    codes, owner = split.codes[hit], split.owner()[hit]
    size = count[codes]
    at = np.repeat(first[codes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(owner, size), flat[at]


def term_sets(split: Words) -> list[np.ndarray]:
    """The distinct hashed terms of each text."""
    text, term = leveled(*occurring(split, [terms(w) for w in split.distinct.to_pylist()]), split.lengths())
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    bounds = np.searchsorted(text, np.arange(len(split.starts)))
    return [np.unique(term[a:b]).astype(np.uint32) for a, b in zip(bounds, bounds[1:], strict=False)]


def minima(own: np.ndarray) -> list[int]:
    """The least of a set of terms under each of MINIMA scrambles."""
    odd = np.arange(1, 2 * MINIMA, 2, dtype=np.uint32) * np.uint32(0x9E3779B1) | np.uint32(1)
    return [int(((own ^ (own >> np.uint32(15))) * m).min()) if len(own) else 0 for m in odd]


def without_copies(signatures: list[list[int]]) -> list[int]:
    """The first of each group of near copies: texts that agree in enough minima.

    Copies would make their chance words look like telling ones.
    """
    table = np.array(signatures, np.int64).reshape(-1, MINIMA)
    bands: dict[tuple, list[int]] = {}
    kept: list[int] = []
    for k, own in enumerate(signatures):
        keys = [(b, *own[b : b + BAND]) for b in range(0, MINIMA, BAND)]
        near = [j for key in keys for j in bands.get(key, ())]
        if near and ((table[near] == table[k]).sum(axis=1) >= ALIKE).any():
            continue
        kept.append(k)
        for key in keys:
            bands.setdefault(key, []).append(k)
    return kept


def divergence(a: Column, n: Column, toxic: int, clean: int) -> Column:
    """The likelihood-ratio statistic of a term's presence by class; a of n texts with the term are toxic."""
    total = toxic + clean

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(F.lit(0.0))

    cells = ((a, n * toxic / total), (n - a, n * clean / total), (toxic - a, (total - n) * toxic / total), (clean - (n - a), (total - n) * clean / total))
    return sum((part(seen, expected) for seen, expected in cells), F.lit(0.0)) * 2


@dataclass
class FactorizationMachine:
    """active: hashed terms, sorted; bias, weights and factors by position there."""

    active: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @staticmethod
    def fit(active: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, epochs: int = 60, rate: float = 0.05, decay: float = 2e-5, seed: int = 5) -> FactorizationMachine:
        """Adam on the log loss; ``active`` terms in ascending order, of which each text has a set."""
        rng = np.random.default_rng(seed)
        y = labels.astype(np.float64)
        toxic, clean = int(y.sum()), int(len(y) - y.sum())
        if not toxic or not clean:
            return FactorizationMachine(active[:0], 4.0 if toxic else -4.0, np.zeros(0), np.zeros((0, FACTORS)))
        m = len(active)
        flat = np.searchsorted(active, np.concatenate(sets))
        size = np.array([len(own) for own in sets], np.int64)
        first = np.cumsum(size) - size
        w0, w = np.log(toxic / clean), np.zeros(m)
        v = rng.normal(0, 0.01, (m, FACTORS))
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
        bias_m = bias_s = 0.0
        at = 0
        for _ in range(epochs):
            order = rng.permutation(len(sets))
            for k in range(0, len(order), 512):
                rows, at = order[k : k + 512], at + 1
                n = len(rows)
                owner = np.repeat(np.arange(n), size[rows])
                term = flat[np.repeat(first[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(len(owner))]
                vt = v[term]
                xv = np.stack([np.bincount(owner, vt[:, f], n) for f in range(FACTORS)], axis=1)
                z = w0 + np.bincount(owner, w[term], n) + 0.5 * ((xv**2).sum(1) - np.bincount(owner, (vt**2).sum(1), n))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / n
                gw = np.bincount(term, g[owner], m)
                gv = np.stack([np.bincount(term, g[owner] * xv[owner, f], m) for f in range(FACTORS)], axis=1) - gw[:, None] * v
                grads = (gw + decay * w, gv + decay * v)
                for p, grad, s in zip((w, v), grads, state, strict=True):
                    s[0] = 0.9 * s[0] + 0.1 * grad
                    s[1] = 0.999 * s[1] + 0.001 * grad**2
                    p -= rate * (s[0] / (1 - 0.9**at)) / (np.sqrt(s[1] / (1 - 0.999**at)) + 1e-8)
                bias_m, bias_s = 0.9 * bias_m + 0.1 * g.sum(), 0.999 * bias_s + 0.001 * g.sum() ** 2
                w0 -= rate * (bias_m / (1 - 0.9**at)) / (np.sqrt(bias_s / (1 - 0.999**at)) + 1e-8)
        return FactorizationMachine(active, float(w0), w, v)

    def score(self, split: Words) -> np.ndarray:
        """The probability of each text, 0 to 1."""
        n = len(split.starts) - 1
        z = np.full(n, self.bias)
        if len(self.active) and len(split.codes):
            active = self.active.astype(np.int64)
            watched = set(active.tolist()).union(*((active ^ mark).tolist() for _, mark in LEVELS))
            each = [[t for t in terms(w) if t in watched] for w in split.distinct.to_pylist()]
            text, found = leveled(*occurring(split, each), split.lengths())
            term = np.minimum(np.searchsorted(active, found), len(active) - 1)
            text, term = text[active[term] == found], term[active[term] == found]
            z += np.bincount(text, self.weights[term], n)
            for f in range(self.factors.shape[1]):
                v = self.factors[term, f]
                z += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(df: DataFrame, labels: DataFrame, label_col: str, limits: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """Bounded sample of learnable labelled rows: id, label, text.

    For each label, the rows whose hashed id is least; rows of the held-out fold
    and null labels never.
    """
    ident = F.col(f"`{id_col}`")
    own = labels.select(ident.alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__label"))
    own = own.filter(F.col("__id").isNotNull() & F.col("__label").isNotNull() & (fold(F.col("__id")) != 1))
    own = own.groupBy("__id").agg(F.max("__label").alias("__label"))
    parts = [own.filter(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(n) for k, n in limits.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionAll(p)
    texts = df.select(ident.alias("__key"), F.col(f"`{text_col}`").alias("__text"))
    return texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("__id", "__label", "__text")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Learn from at most FIT_TOXIC toxic and FIT_CLEAN clean labelled rows.

    Terms are counted where they are; only signatures, the active terms and each
    text's share of them come to the driver. Nothing depends on how the rows are
    split: they are named by their content and identifier.
    """
    sample = labelled(df, labels, label_col, {1: FIT_TOXIC, 0: FIT_CLEAN}, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts in enumerate(slices(batch.column(2), FIT_SLICE)):
                sets = term_sets(words(texts))
                lists = pa.array([s.view(np.int32) for s in sets], pa.list_(pa.int32()))
                lows = pa.array([minima(s) for s in sets], pa.list_(pa.int64()))
                own = batch.slice(k * FIT_SLICE, FIT_SLICE)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists, lows], ["id", "label", "terms", "minima"])
            tidy()

    fields = [T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("minima", T.ArrayType(T.LongType()))]
    rows = sample.select(F.xxhash64("__id").alias("id"), "__label", "__text").mapInArrow(run, T.StructType(fields))
    rows = cut(rows.withColumn("row", F.xxhash64("id", "label", "minima")).dropDuplicates(["row"]))
    seen = rows.select("row", "label", "minima").orderBy("label", "minima", "row").collect()
    kept = [seen[k] for k in without_copies([r.minima for r in seen])]
    toxic = sum(r.label for r in kept)
    if not toxic or toxic == len(kept):
        return FactorizationMachine.fit(np.zeros(0, np.uint32), [], np.array([r.label for r in kept], np.int64))
    chosen = rows.join(F.broadcast(df.sparkSession.createDataFrame([(r.row,) for r in kept], "row long")), "row").select("row", "label", F.explode("terms").alias("term"))
    counts = chosen.groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    telling = divergence(F.col("a"), F.col("n"), toxic, len(kept) - toxic) > LEAST_GAIN
    active = cut(counts.filter(F.col("n") >= LEAST_TEXTS).filter(telling).select("term"))
    own = chosen.join(F.broadcast(active), "term").groupBy("row").agg(F.collect_list("term").alias("own"))
    share = {r.row: r.own for r in own.collect()}
    unsigned = lambda terms: np.sort(np.array(terms, np.int32).view(np.uint32))
    found = unsigned([r.term for r in active.collect()])
    return FactorizationMachine.fit(found, [unsigned(share.get(r.row, [])) for r in kept], np.array([r.label for r in kept], np.int64))


def scored(model: FactorizationMachine, text: Column) -> Column:
    """The toxicity of a text as a column."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.concatenate([model.score(words(texts)) for texts in slices(batch)]))
            tidy()

    return run.asNondeterministic()(text)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``df`` plus a struct ``toxicity`` (score, predicted).

    Null and empty texts have the score of a text without any known term; every
    repeated row is scored; very long texts are scored whole; without labels of
    both classes every score is the same (low without toxic labels); an empty
    table gives an empty result. Other columns pass
    through, but one named ``toxicity`` is replaced.
    """
    model = fit(df, labels, id_col, text_col, label_col)
    found = df.withColumn("__score", scored(model, F.col(f"`{text_col}`")))
    struct = F.struct(F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
    return found.withColumn("toxicity", struct).drop("__score")
