"""Range joins as equi-joins on grid cells of the join radius.

Points are filed under their cell; one side is also filed under the neighbours of its
cell, so that all pairs within the radius meet in one cell exactly once and only the
distance is left to test. A dense cell would be one join key: cells are counted, and those
with many points dealt over parts, as nothing above the join needs the rows of a cell
together. Neither side is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("c0", "c1", "c2")
#: Points of one side in a cell from which on the cell is dealt over several tasks.
HOT = 10_000
#: Most cells that are dealt out (36 bytes each in the broadcast list).
DENSE = 100_000


def _cell(axis: str, size: float) -> Column:
    return F.floor(F.col(axis) / F.lit(size)).cast("long")


def pairs(a: DataFrame, b: DataFrame, radius: float, axes: Sequence[str] = AXES, keep: Sequence[str] = ("id",), box: float | None = None, closed: bool = False, once: bool = False, hot: int | None = HOT) -> DataFrame:
    """All (a, b) pairs with d2 < radius^2 (<= if ``closed``): columns a_*, b_* of ``keep`` and the axes, and d2.

    With ``box`` axes lie in [0, box) and the shortest image counts; 2 * radius may not exceed
    it. Points without coordinates meet nothing. With ``once`` a and b are one catalog and each
    pair of ids comes once, either way round: one of each two opposite neighbour cells is asked.

    Adaptive execution splits a join key by its bytes, but the pairs of a cell grow with the
    square of its points. So the points of ``a`` are counted by cell, and the a side of cells
    with more than ``hot`` of them is dealt over as many parts as they hold that number, and the b
    side goes to each part. Only cells with more than 1 / DENSE of all points count as dense, so
    they are DENSE at most and the list of them is broadcast. Without ``hot`` nothing is counted.
    """
    if box is not None and 2 * radius > box:
        raise ValueError("the radius is larger than half the box")
    n = None if box is None else max(1, int(box // radius))
    size = radius if box is None else box / n
    columns = [*dict.fromkeys([*keep, *axes])]
    cells = [_cell(x, size) for x in axes]
    if n is not None:
        cells = [F.least(c, F.lit(n - 1)) for c in cells]
    halved = once and (n is None or n > 2)  # in one or two cells a side opposite neighbours are one cell
    offsets = [o for o in product((-1, 0, 1), repeat=len(axes)) if not halved or o >= (0,) * len(axes)]
    shifts = sorted({tuple(s if n is None else s % n for s in o) for o in offsets})
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in columns], *[c.alias(f"_g{i}") for i, c in enumerate(cells)])
    around = F.inline(F.array(*[F.struct(*[F.lit(s).alias(f"_s{i}") for i, s in enumerate(o)], F.lit(not any(o)).alias("_own")) for o in shifts]))
    spread = b.select(*[F.col(c).alias(f"b_{c}") for c in columns], *[c.alias(f"_c{i}") for i, c in enumerate(cells)], around)
    moved = [F.col(f"_c{i}") + F.col(f"_s{i}") for i in range(len(axes))]
    right = spread.select(*[f"b_{c}" for c in columns], *([F.col("_own")] if once else []), *[(m if n is None else F.pmod(m, F.lit(n))).alias(f"_g{i}") for i, m in enumerate(moved)])
    on = [f"_g{i}" for i in range(len(axes))]
    if hot:
        counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
        most = counts.agg(F.greatest(F.lit(hot), F.sum("_n") / DENSE).alias("_most"))  # one row
        dense = counts.crossJoin(F.broadcast(most)).select(*on, F.ceil(F.col("_n") / F.col("_most")).cast("int").alias("_parts")).where("_parts > 1")
        parts = F.coalesce("_parts", F.lit(1))
        left = left.join(F.broadcast(dense), on, "left").withColumn("_part", F.pmod(F.xxhash64(*[f"a_{c}" for c in columns]), parts).cast("int")).drop("_parts")
        right = right.join(F.broadcast(dense), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        on.append("_part")
    # the plan takes the b side for as small as its table, not for the copies under all neighbours, and would send it to the driver
    met = left.hint("shuffle_hash").join(right, on)
    if once:
        met = met.where((F.col("a_id") < F.col("b_id")) | ~F.col("_own") if halved else F.col("a_id") < F.col("b_id"))
    gaps = [F.col(f"b_{x}") - F.col(f"a_{x}") for x in axes]
    if box is not None:
        gaps = [F.least(F.abs(g), F.lit(box) - F.abs(g)) for g in gaps]
    d2 = sum(g * g for g in gaps)
    found = met.select(*[f"{s}_{c}" for s in "ab" for c in columns], d2.alias("d2"))
    limit = F.lit(radius * radius)
    return found.where(F.col("d2") <= limit if closed else F.col("d2") < limit)


def self_pairs(points: DataFrame, radius: float, axes: Sequence[str] = AXES, keep: Sequence[str] = ("id",), box: float | None = None, closed: bool = False) -> DataFrame:
    """Unordered pairs of different ids of one catalog, either end as a; see pairs()."""
    return pairs(points, points, radius, axes, keep, box, closed, once=True)
