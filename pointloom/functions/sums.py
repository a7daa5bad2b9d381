"""Sums that keep the rounding errors of doubles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CompensatedSum:
    """A running sum with the part that rounding lost beside it (Neumaier)."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.total, self.lost = 0.0, 0.0

    def add(self, x: float) -> None:
        total = self.total + x
        self.lost += (self.total - total) + x if abs(self.total) >= abs(x) else (x - total) + self.total
        self.total = total

    def value(self) -> float:
        return self.total + self.lost


def neumaier_sum(values: Iterable[float]) -> float:
    s = CompensatedSum()
    for v in values:
        s.add(v)
    return s.value()


def compensated_sum(df: DataFrame, column: str) -> float:
    """The sum of a column, each partition compensated by itself, its two parts added on the driver; nulls count as 0. One row a partition comes in."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = CompensatedSum()
        for b in batches:
            for x in b.column(0).drop_null().to_pylist():
                s.add(x)
        yield pa.RecordBatch.from_arrays([pa.array([s.total]), pa.array([s.lost])], ["total", "lost"])

    rows = df.select(F.col(column).cast("double").alias("x")).mapInArrow(partial, "total double, lost double").collect()
    return neumaier_sum(x for r in rows for x in (r["total"], r["lost"]))
