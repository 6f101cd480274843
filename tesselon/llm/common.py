"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of this remainder are never learned from.
HELD_OUT = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(id_col: Column) -> Column:
    return fold(id_col) == HELD_OUT


def buckets(spark: SparkSession) -> int:
    """How many parts a shuffle of this session has."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
