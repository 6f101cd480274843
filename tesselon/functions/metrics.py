"""Distances between two columns of values, each one aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where both are 0."""
    return F.when((top == 0) & (bottom == 0), F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def _plogp(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0))


def _jensen(a: Column, b: Column) -> Column:
    m = (a + b) / 2
    return F.sum(_plogp(a, m) / 2 + _plogp(b, m) / 2)


def _correlation(a: Column, b: Column) -> Column:
    top = F.avg(a * b) - F.avg(a) * F.avg(b)
    return F.lit(1.0) - top / F.sqrt((F.avg(a * a) - F.avg(a) * F.avg(a)) * (F.avg(b * b) - F.avg(b) * F.avg(b)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": lambda a, b: F.sqrt(F.sum((a - b) * (a - b))),
    "sqeuclidean": lambda a, b: F.sum((a - b) * (a - b)),
    "cityblock": lambda a, b: F.sum(F.abs(a - b)),
    "totalvariation": lambda a, b: F.sum(F.abs(a - b)) / 2,
    "chebyshev": lambda a, b: F.max(F.abs(a - b)),
    "hamming": lambda a, b: F.sum((a != b).cast("long")),
    "jaccard": lambda a, b: F.lit(1.0) - _ratio(F.sum(F.least(a, b)), F.sum(F.greatest(a, b))),
    "braycurtis": lambda a, b: _ratio(F.sum(F.abs(a - b)), F.sum(F.abs(a + b))),
    "cosine": lambda a, b: F.lit(1.0) - F.sum(a * b) / (F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))),
    "correlation": _correlation,
    "chisq": lambda a, b: F.sum(_ratio((a - b) * (a - b), a + b)),
    "kldivergence": lambda a, b: F.sum(_plogp(a, b)),
    "genkldivergence": lambda a, b: F.sum(_plogp(a, b) - a + b),
    "jsdivergence": _jensen,
    "spannorm": lambda a, b: F.max(a - b) - F.min(a - b),
    "meanabsdev": lambda a, b: F.avg(F.abs(a - b)),
    "meansqdev": lambda a, b: F.avg((a - b) * (a - b)),
    "rmsdev": lambda a, b: F.sqrt(F.avg((a - b) * (a - b))),
}
