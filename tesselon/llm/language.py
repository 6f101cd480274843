"""Language identification by words first, then shorter and shorter n-grams.

A word that was seen in learning counts with its log frequency in each language.
An unseen word backs off to its character n-grams (with marks for its beginning
and end): the longest length of which any n-gram is known is averaged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from .common import fold
from .words import Words, one_array, slices, sums, tidy, words

#: Rows of each language to learn from, about.
FIT_ROWS = 2500
#: How often a word or n-gram must have been seen to be known.
LEAST_SEEN = 3
LENGTHS = (5, 4, 3, 2, 1)
#: Words after which more words don't make the answer surer.
SURE_AFTER = 30
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class LanguageModel:
    """rows: log frequencies, a row for each known word or n-gram; words and grams give the row."""

    languages: list[str]
    rows: np.ndarray
    words: dict[str, int]
    grams: dict[int, dict[str, int]] = field(default_factory=dict)

    @staticmethod
    def of(languages: list[str], totals: dict[int, tuple[int, np.ndarray]], known: list[tuple[int, str, np.ndarray]]) -> LanguageModel:
        """From the sizes and language totals of each length's table, 0 being words, and known (length, key, counts)."""
        if not languages:
            return LanguageModel([], np.zeros((0, 0), np.float32), {})
        tables: dict[int, dict[str, int]] = {n: {} for n in (0, *LENGTHS)}
        rows = np.zeros((len(known), len(languages)), np.float32)
        for k, (length, key, counts) in enumerate(known):
            size, total = totals[length]
            tables[length][key] = k
            rows[k] = np.log((counts + 0.1) / (total + 1 + 0.1 * size))
        return LanguageModel(languages, rows, tables.pop(0), tables)

    def evidence(self, run: str) -> list[int]:
        """The rows that speak for a lower-cased word; none if even its characters are unknown."""
        at = self.words.get(run)
        if at is not None:
            return [at]
        marked = f"^{run}$"
        for n in LENGTHS:
            table = self.grams[n]
            hits = [table[g] for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) in table]
            if hits:
                return hits
        return []

    def predict(self, split: Words) -> tuple[list[str], np.ndarray]:
        """The language of each text and how sure it is."""
        n, m = len(split.starts) - 1, len(self.languages)
        runs: list[int] = []  # letter runs of each distinct word
        counts: list[int] = []  # rows of each run
        flat: list[int] = []
        for word in split.distinct.to_pylist():
            own = LETTERS.findall(word.lower())
            runs.append(len(own))
            for run in own:
                hits = self.evidence(run) if m else []
                counts.append(len(hits))
                flat.extend(hits)
        run_of = np.array(runs, np.int64)
        total = sums(run_of[split.codes], split.starts)
        if not m:
            return [UNKNOWN] * n, np.zeros(n)
        size = np.array(counts, np.int64)
        by_run = sums(self.rows[np.array(flat, np.int64)].astype(np.float64), np.concatenate(([0], np.cumsum(size)))) / np.maximum(size, 1)[:, None]
        by_word = sums(by_run, np.concatenate(([0], np.cumsum(run_of))))
        z = sums(by_word[split.codes], split.starts) / np.maximum(total, 1)[:, None]
        z = (z - z.max(axis=1, keepdims=True)) * np.minimum(total, SURE_AFTER)[:, None]
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        named = [self.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        return named, np.where(total > 0, p[np.arange(n), best], 0.0)


def grams_of(word: Column, length: int) -> Column:
    """array<struct<length, key>>: the n-grams of a word with marks for its beginning and end."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    cuts = F.transform(F.sequence(F.lit(1), F.length(marked) - length + 1), lambda k: F.struct(F.lit(length).alias("length"), F.substring(marked, k, F.lit(length)).alias("key")))
    return F.when(F.length(marked) >= length, cuts).otherwise(F.array().cast("array<struct<length:int,key:string>>"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from about FIT_ROWS rows of each language outside the held-out fold, chosen by hashed id.

    Words and n-grams are counted as tables; all that were seen LEAST_SEEN times are known.
    """
    ident, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")
    usable = df.filter(lang.isNotNull() & (fold(ident) != 1)).select(ident.alias("__id"), lang.cast("string").alias("__lang"), F.col(f"`{text_col}`").alias("__text"))
    sizes = usable.groupBy("__lang").agg(F.count("*").alias("__rows"))
    share = F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) * F.col("__rows") < F.lit(FIT_ROWS << 20)
    sample = usable.join(F.broadcast(sizes), "__lang").filter(share).select("__lang", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), one_array(batch.column(1)).to_pylist(), strict=True):
                found.update((lang, w) for w in LETTERS.findall(text.lower()))
            keys = list(found)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    return model_of(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))


def model_of(by_word: DataFrame) -> LanguageModel:
    """From (lang, word, n), each pair once. What reaches the driver is the vocabulary of the bounded sample."""
    by_word = cut(by_word)
    languages = [r[0] for r in by_word.select("lang").distinct().orderBy("lang").collect()]
    keys = F.concat(F.array(F.struct(F.lit(0).alias("length"), F.col("word").alias("key"))), *[grams_of(F.col("word"), n) for n in LENGTHS])
    keys = by_word.select("lang", "n", F.explode(keys).alias("k")).groupBy("k.length", "k.key", "lang").agg(F.sum("n").alias("n"))
    keys = cut(keys.groupBy("length", "key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n")))
    totals = {}
    for r in keys.groupBy("length").agg(F.count("*").alias("size"), *[F.sum(F.col("by")[name]).alias(f"l{k}") for k, name in enumerate(languages)]).collect():
        totals[r["length"]] = (r["size"], np.array([r[f"l{k}"] or 0 for k in range(len(languages))], float))
    known = keys.filter(F.col("n") >= LEAST_SEEN).select("length", "key", F.array(*[F.coalesce(F.col("by")[name], F.lit(0)) for name in languages]).alias("counts"))
    found = known.orderBy("length", "key").toArrow() if languages else None
    if found is None:
        return LanguageModel.of([], {}, [])
    counts = np.asarray(found.column("counts").combine_chunks().flatten(), float).reshape(-1, len(languages))
    return LanguageModel.of(languages, totals, list(zip(found.column("length").to_pylist(), found.column("key").to_pylist(), counts, strict=True)))


def predicted(model: LanguageModel, text: Column) -> Column:
    """A struct (lang, score) as a column."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for texts in slices(batch):
                named, score = model.predict(words(texts))
                parts.append(pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(score)], ["lang", "score"]))
            yield pa.concat_arrays(parts)
            tidy()

    return run.asNondeterministic()(text)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows and columns of ``df`` plus a struct ``language`` (lang, score).

    A text that is null or has no letter is ``und`` with score 0, and so is every
    text when no row has a language to learn from; text in unknown letters gets
    the first language with an even score; ties go to the first language by name.
    Repeated rows are each answered; very long texts count whole; an empty table
    gives an empty result. Other columns pass
    through, but one named ``language`` is replaced.
    """
    model = fit(df, id_col, text_col, lang_col)
    return df.withColumn("language", predicted(model, F.col(f"`{text_col}`")))
