"""How many tasks a large join or aggregation is dealt out to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task of a large join or aggregation gets on average.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` by its keys over as many tasks as ``rows`` of them need, whatever the session's number is.

    Up to ROWS_PER_TASK rows, or where nothing is known of their number, Catalyst deals them out.
    """
    if rows is None or rows <= ROWS_PER_TASK:
        return df
    return df.repartition(max(-(-rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)


def total(*rows: int | None) -> int | None:
    return None if None in rows else sum(rows)


def per_key(a: int | None, b: int | None, keys: int) -> int | None:
    """Rows that a join of a and b rows over so many keys makes where they are dealt evenly."""
    return None if a is None or b is None else -(-a * b // max(keys, 1))
