"""Streaming counterparts of mergeable cell statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.operators.cells import AXES, _keys


def cell_counts(points: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9)) -> DataFrame:
    """(level, k.., n, sw): counts and weights of cells; in update mode the changed cells. Batch or stream."""
    spread = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    at = [F.expr(f"shiftright(cast({a} as long), {bits} - level)").alias(k) for a, k in zip(axes, _keys(axes), strict=True)]
    return spread.select("level", *at, "w").groupBy("level", *_keys(axes)).agg(F.count("*").alias("n"), F.sum("w").alias("sw"))


def windowed_counts(events: DataFrame, width: str, lateness: str, time: str = "ts", key: str = "event_type") -> DataFrame:
    """(since, key, n, value): counts and sums by event-time window, rows later than ``lateness`` dropped by the watermark."""
    w = events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("since"), key, "n", "value")


def _pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = state.get[0] if state.exists else 0
    new = sum(len(f) for f in frames)
    state.update((old + new,))
    yield pd.DataFrame({"level": [key[0]], "new_pairs": [old * new + new * (new - 1) // 2]})


def pair_increments(points: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9)) -> DataFrame:
    """(level, new_pairs): pairs within a cell that each batch adds, the state of a cell being its count."""
    spread = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    at = [F.expr(f"shiftright(cast({a} as long), {bits} - level)").alias(k) for a, k in zip(axes, _keys(axes), strict=True)]
    grouped = spread.select("level", *at).groupBy("level", *_keys(axes))
    return grouped.applyInPandasWithState(_pairs, "level int, new_pairs long", "n long", "update", GroupStateTimeout.NoTimeout)
