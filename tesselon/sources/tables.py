"""Triplets and vectors from tables and files, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def coo(df: DataFrame, gi: Column, gj: Column, v: Column, part: Column | None = None) -> DataFrame:
    """(part, gi, gj, v) from columns of a table; ids must start at 1."""
    return df.select((F.lit(1) if part is None else part).cast("int").alias("part"), gi.cast("long").alias("gi"), gj.cast("long").alias("gj"), v.alias("v"))


def gvec(df: DataFrame, gid: Column, v: Column) -> DataFrame:
    return df.select(gid.cast("long").alias("gid"), v.alias("v"))


def read_coo(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(gi, gj, v[, part]) as it was written."""
    return spark.read.format(format).load(path)


def write_coo(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.format(format).save(path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(gi, gj, v) of a coordinate file; a pattern has ones, symmetric entries are mirrored."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("%%MatrixMarket")).first()
    kind = (head[0].lower().split() if head else []) + [""] * 5
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    if kind[3] == "pattern":
        rows = body.filter(F.size("f") == 2).select(F.col("f")[0].cast("long").alias("gi"), F.col("f")[1].cast("long").alias("gj"), F.lit(1.0).alias("v"))
    else:
        size = next((line for line in lines.filter(~F.col("value").startswith("%")).limit(1).collect()), None)
        shape = size[0].split() if size else []
        rows = body.select(F.col("f")[0].cast("long").alias("gi"), F.col("f")[1].cast("long").alias("gj"), F.col("f")[2].cast("double").alias("v"))
        if len(shape) == 3:
            rows = rows.withColumn("k", F.monotonically_increasing_id())
            first = rows.agg(F.min("k")).first()[0]
            rows = rows.filter(F.col("k") != first).drop("k")
    if kind[4] == "symmetric":
        rows = rows.unionAll(rows.filter("gi <> gj").select(F.col("gj").alias("gi"), F.col("gi").alias("gj"), "v"))
    return rows
