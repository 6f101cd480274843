"""Exact deduplication by sorting contents.

A sample of the rows gives splitters; they deal the rows out by leading bytes,
content digest and a hash of the identifier, each bucket is sorted externally,
and every row is compared in full with its neighbour. A group that is larger
than a bucket is cut by the splitters themselves, so only texts that supplied a
splitter can lie in several buckets: their totals are counted beforehand with
partial aggregation, one row for each splitter at most.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets as session_buckets

LEAD, DIGEST, TAIL = 24, 32, 8
WIDTH = LEAD + DIGEST + TAIL
SAMPLE_PER_BUCKET, SAMPLE_AT_MOST = 64, 200_000


def plain(text: Column) -> Column:
    """No change; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def _splitters(keyed: DataFrame, n: int) -> list[bytes]:
    """At most n - 1 keys that cut the sampled bytes into even shares."""
    rows = keyed.count()
    wanted = min(SAMPLE_PER_BUCKET * n, SAMPLE_AT_MOST)
    if n < 2 or not rows:
        return []
    sample = keyed if rows <= wanted else keyed.sample(wanted / rows, seed=17)
    seen = sorted((bytes(r[0]), 64 + r[1]) for r in sample.select("__key", F.length("__text")).collect())
    reached, at = [], 0
    for _, weight in seen:
        at += weight
        reached.append(at)
    cuts = {seen[min(bisect_right(reached, at * k / n), len(seen) - 1)][0] for k in range(1, n)} if seen else set()
    return sorted(cuts)


def _bucket(key: Column, splitters: list[bytes]) -> Column:
    """How many splitters are <= key, by binary search in one literal."""
    if not splitters:
        return F.lit(0)
    m, blob = len(splitters), F.lit(bytearray(b"".join(splitters)))
    steps = [1 << k for k in reversed(range(int(math.log2(m)) + 1))]

    def step(low: Column, by: Column) -> Column:
        at = F.substring(blob, (low + by - 1) * WIDTH + 1, F.lit(WIDTH))
        return F.when((low + by <= m) & (at <= key), low + by).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = plain,
    keep: str = "smallest",
    n_buckets: int | None = None,
    out: str = "dedup",
) -> DataFrame:
    """All rows and columns of ``df`` plus one struct column ``out``.

    It holds keep_id (the identifier that stays), group_size, kept and
    text_sha256 (of the normalised text). Of equal texts the row with the
    ``keep`` ("smallest" or "largest") identifier stays. Null text counts as
    empty; a null identifier loses to any other; of repeated rows (same text and
    identifier) exactly one is kept; an empty table gives an empty result. Very
    long texts are compared in full. Other columns pass through, whatever their
    names, but one named as ``out`` is replaced; names beginning with ``__`` are
    reserved.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    n = n_buckets or session_buckets(df.sparkSession)
    ident = F.col(f"`{id_col}`")
    keyed = df.withColumn("__text", normalise(F.col(f"`{text_col}`"))).withColumn("__sha", F.sha2("__text", 256))
    lead = F.rpad(F.substring(F.col("__text").cast("binary"), 1, LEAD), LEAD, F.lit(bytearray(1)))
    tail = F.unhex(F.lpad(F.hex(F.xxhash64(ident)), 2 * TAIL, F.lit("0")))
    keyed = keyed.withColumn("__key", F.concat(lead, F.unhex("__sha"), tail))
    splitters = _splitters(keyed, n)

    best = F.max if keep == "largest" else F.min
    order = ident.desc_nulls_last() if keep == "largest" else ident.asc_nulls_last()
    cut = sorted({s[LEAD : LEAD + DIGEST].hex() for s in splitters})
    totals = (  # one row for each splitter at most
        keyed.filter(F.col("__sha").isin(cut) if cut else F.lit(False))
        .groupBy(F.col("__sha").alias("__cut"))
        .agg(best(ident).alias("__cut_id"), F.count("*").alias("__cut_size"))
    )

    dealt = keyed.withColumn("__bucket", _bucket(F.col("__key"), splitters)).drop("__key").repartitionById(len(splitters) + 1, F.col("__bucket"))
    near = Window.partitionBy("__bucket").orderBy("__sha", "__text", order)
    before = F.lag("__text").over(near)
    head = before.isNull() | (before != F.col("__text"))
    dealt = dealt.withColumn("__head", head).withColumn("__run", F.sum(F.col("__head").cast("long")).over(near))
    run = Window.partitionBy("__bucket", "__run")
    own_id, own_size = best(ident).over(run), F.count("*").over(run)
    joined = dealt.withColumn("__own_id", own_id).withColumn("__own_size", own_size)
    joined = joined.join(F.broadcast(totals), F.col("__sha") == F.col("__cut"), "left")
    shared = F.col("__cut_size").isNotNull()
    keep_id = F.when(shared, F.col("__cut_id")).otherwise(F.col("__own_id"))
    struct = F.struct(
        keep_id.alias("keep_id"),
        F.coalesce("__cut_size", "__own_size").alias("group_size"),
        (F.col("__head") & ident.eqNullSafe(keep_id)).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], struct.alias(out))


def drop_exact_copies(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    return exact_dedup(df, **options, out="__dedup").filter("__dedup.kept").drop("__dedup")
