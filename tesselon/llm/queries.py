"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .chat import digest, format_chat
from .common import held_out, table
from .exact_dedup import exact_dedup
from .jaccard import Likeness, jaccard_join
from .language import identify
from .mixing import mix
from .packing import pack
from .quality import quality
from .secrets import find_secrets
from .token_matrix import token_matrix
from .toxicity import toxicity

MIX_WEIGHTS = {"domain": {"src0": 2, "src1": 3}, "language": {"en": 4, "de": 2}, "source": {"src10": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 7


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return found.select("doc_id", "dedup.keep_id", "dedup.group_size", "dedup.kept", "dedup.text_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, F.substring("source", 1, 4), F.col("lang"), F.col("source"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "mix.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "quality.*")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


#: A conversation whose texts hold control strings of chat templates.
TRAP = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame(TRAP, rows.schema)
    return digest(format_chat(rows.unionByName(trap)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op3_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


def op5_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), Likeness(words=3, num=90, den=100))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # lies at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_token_matrix": op3_token_matrix,
        "op4_language": op4_language,
        "op5_balanced_packing": op5_balanced_packing,
        "op6_mixing": op6_mixing,
        "op7_quality": op7_quality,
        "op8_secrets": op8_secrets,
        "op9_chat_format": op9_chat_format,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
