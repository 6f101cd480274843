"""Section timings of the driver's steps, kept by part for parity of reports."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PTimer:
    """``tic`` starts, ``toc`` adds the seconds since to a section (of a part)."""

    def __init__(self) -> None:
        self.data: dict[str, dict[int, float]] = {}
        self.began = time.perf_counter()

    def tic(self) -> None:
        self.began = time.perf_counter()

    def toc(self, section: str, part: int = 1) -> float:
        now = time.perf_counter()
        own = self.data.setdefault(section, {})
        own[part] = own.get(part, 0.0) + now - self.began
        self.began = now
        return own[part]

    def statistics(self) -> dict[str, dict[str, float]]:
        """min, max and avg over parts."""
        return {s: {"min": min(v.values()), "max": max(v.values()), "avg": sum(v.values()) / len(v)} for s, v in self.data.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(section, min, max, avg), the longest first."""
        rows = [(s, p, t) for s, v in self.data.items() for p, t in v.items()]
        df = spark.createDataFrame(rows, "section string, part int, s double")
        return df.groupBy("section").agg(F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("avg")).orderBy(F.desc("max"))

    def lines(self) -> Iterator[str]:
        """A printed report."""
        found = sorted(self.statistics().items(), key=lambda x: -x[1]["max"])
        width = max([7, *(len(s) for s, _ in found)])
        yield f"{'section':<{width}} {'max':>10} {'min':>10} {'avg':>10}"
        for s, v in found:
            yield f"{s:<{width}} {v['max']:>10.3e} {v['min']:>10.3e} {v['avg']:>10.3e}"

    def __repr__(self) -> str:
        return "\n".join(self.lines())
