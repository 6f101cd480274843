"""The corpus pipeline: from all documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of documents, whatever further columns ``docs`` has (names beginning with
``__`` are reserved). An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.common import table
from tesselon.llm.exact_dedup import drop_exact_copies
from tesselon.llm.jaccard import Likeness, drop_near_copies
from tesselon.llm.mixing import mix
from tesselon.llm.packing import pack
from tesselon.llm.toxicity import THRESHOLD, fit, scored
from tesselon.plans.lineage import checkpoint_dir

#: The mixture that training asks for, as shares of the words that are left.
MIX_WEIGHTS = {"domain": {"src0": 2, "src1": 3}, "language": {"en": 4, "de": 2}}
MIX_SHARE, MIX_SEED = 0.8, 7
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Texts that a worker encodes together; by this stage executors hold what earlier ones left.
TOGETHER = 1000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the factorization machine rejects go.

    Null and empty texts have no term and stay; repeated rows are judged alike;
    very long texts are judged whole; at exactly the threshold a document goes.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(scored(model, F.col("text")) < THRESHOLD)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of equal texts the document with the smallest identifier stays.

    Null counts as an empty text, so of all null and empty ones a single row
    stays; a null identifier loses to any other; of repeated rows one stays; very
    long texts are compared whole.
    """
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of documents linked by five-word shingles at 0.8 or more, the one with the smallest identifier stays.

    Texts without words are linked with nothing and stay; shorter ones than five
    words are linked with equal ones; repeated rows of the identifier that stays
    all stay, and so does a group without any identifier; very long texts are
    compared whole.
    """
    return drop_near_copies(docs, Likeness(words=5, num=80, den=100))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: the mixture, without repeating a document.

    Null names are the empty name; texts without characters cost nothing; a long
    text that exceeds what its source has left ends the source's prefix; rows with
    equal identifiers are taken or left together.
    """
    return mix(docs, F.substring("source", 1, 4), F.col("lang"), F.col("source"), MIX_WEIGHTS, MIX_SHARE, 1, MIX_SEED, out="__mix").drop("__mix")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: pieces of cost-balanced sequences with their token ids.

    Null and empty texts are their end id alone; repeated rows are packed each;
    long texts are cut into pieces that hold each id once.
    """
    return pack(docs, TOKENIZER, END_ID, together=TOGETHER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL: the first stage is a trained model and the last a packing by tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
