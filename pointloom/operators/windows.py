"""Sliding cubes on a small dense grid: counts of every shift, their distributions, cell-cell correlation.

Empty cells matter here, so the grid is laid out in full (side^D rows, a parameter) and
one axis after the other is summed. A cube of width k is a sum over k shifted copies of
each cell, done by adding each cell to the k origins whose cube holds it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.cells import moments, ratio

AXES = ("c0", "c1", "c2")


def binned(points: DataFrame, side_bits: int, axes: Sequence[str] = AXES, bits: int = 16, weight: str | None = None) -> DataFrame:
    """(k.., n): occupied cells of the grid with 2^side_bits cells a side; n is a count, or the sum of weights."""
    at = [F.shiftright(F.col(a).cast("long"), bits - side_bits).alias(f"k{i}") for i, a in enumerate(axes)]
    value = F.sum(weight) if weight else F.count("*")
    return points.groupBy(*at).agg(value.alias("n"))


def window_sums(grid: DataFrame, side: int, width: int, d: int, periodic: bool = True, values: Sequence[str] = ("n",)) -> DataFrame:
    """(k.., values): sums over the cube of ``width`` cells that starts at each origin, origins without a point left out.

    Without wrapping only cubes inside the box are made. One axis at a time: width rows a
    cell and a partial sum, so width * d rows in place of width^d.
    """
    df = grid
    for i in range(d):
        back = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
        moved = df.withColumn("_b", back).withColumn(f"k{i}", F.col(f"k{i}") - F.col("_b"))
        moved = moved.withColumn(f"k{i}", F.pmod(F.col(f"k{i}"), F.lit(side))) if periodic else moved.where((F.col(f"k{i}") >= 0) & (F.col(f"k{i}") <= side - width))
        df = moved.groupBy(*[f"k{j}" for j in range(d)]).agg(*[F.sum(v).alias(v) for v in values])
    return df


def paired_windows(data: DataFrame, randoms: DataFrame, side_bits: int, widths: Sequence[int], axes: Sequence[str] = AXES, bits: int = 16, periodic: bool = True, weight: str = "w", footprint: float = 0.0) -> DataFrame:
    """(width, t, s1..s4 and moments): density contrast of all shifted cubes whose random weight exceeds the footprint cut; alpha is that of all points."""
    side, d = 1 << side_bits, len(axes)
    keys = [f"k{i}" for i in range(d)]
    both = binned(data, side_bits, axes, bits, weight).select(*keys, F.col("n").alias("sw_d"), F.lit(0.0).alias("sw_r")).unionByName(binned(randoms, side_bits, axes, bits, weight).select(*keys, F.lit(0.0).alias("sw_d"), F.col("n").alias("sw_r")))
    grid = both.groupBy(*keys).agg(F.sum("sw_d").alias("sw_d"), F.sum("sw_r").alias("sw_r"))
    alpha = grid.agg(ratio(F.sum("sw_d"), F.sum("sw_r")).alias("alpha"))
    out = None
    for w in widths:
        c = window_sums(grid, side, w, d, periodic, ("sw_d", "sw_r")).crossJoin(F.broadcast(alpha)).where(F.col("sw_r") > F.lit(footprint))
        delta = ratio(F.col("sw_d"), F.col("alpha") * F.col("sw_r")) - 1
        part = c.withColumn("delta", delta).agg(F.sum("sw_r").alias("t"), *[F.sum(F.col("sw_r") * F.pow("delta", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)]).withColumn("width", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return moments(out)


def window_pmf(points: DataFrame, side_bits: int, widths: Sequence[int], axes: Sequence[str] = AXES, bits: int = 16, periodic: bool = True) -> DataFrame:
    """(width, n, windows): how many of all shifted cubes hold n points; n = 0 is counted from the number of cubes."""
    side, d = 1 << side_bits, len(axes)
    grid = binned(points, side_bits, axes, bits)
    out = None
    for w in widths:
        if not 0 < w <= side:
            raise ValueError(f"width {w} does not fit the grid")
        seen = window_sums(grid, side, w, d, periodic).groupBy("n").agg(F.count("*").alias("windows"))
        total = side**d if periodic else (side - w + 1) ** d
        zero = seen.agg((F.lit(total) - F.coalesce(F.sum("windows"), F.lit(0))).alias("windows")).select(F.lit(0).cast("long").alias("n"), "windows").where("windows > 0")
        part = seen.unionByName(zero).select(F.lit(w).alias("width"), "n", "windows")
        out = part if out is None else out.unionByName(part)
    return out


def pmf_moments(pmf: DataFrame) -> DataFrame:
    """(width, windows, mean, var, skew, kurt): moments over all cubes; skew and kurt standardised, null if var is 0."""
    w, n = F.col("windows").cast("double"), F.col("n").cast("double")
    s = pmf.groupBy("width").agg(F.sum("windows").alias("windows"), *[F.sum(w * F.pow(n, k)).alias(f"p{k}") for k in (1, 2, 3, 4)])
    m1, m2, m3, m4 = (F.col(f"p{k}") / F.col("windows") for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    third, fourth = m3 - 3 * m1 * m2 + 2 * F.pow(m1, 3), m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, 4)
    return s.select("width", "windows", m1.alias("mean"), var.alias("var"), F.when(var > 0, third / F.pow(var, 1.5)).alias("skew"), F.when(var > 0, fourth / (var * var) - 3).alias("kurt"))


def shift_levels(points: DataFrame, side_bits: int, axes: Sequence[str] = AXES, bits: int = 16, periodic: bool = True) -> DataFrame:
    """(level, mean, var, dvar): moments of the cubes of side 2^(side_bits - level) averaged over all shifts.

    dvar is var less the mean variance of the children within a parent, which over all
    shifts is var(level) - (var(level + 1) - dispersion of halves); at the finest level it is var.
    """
    from pyspark.sql import Window

    widths = [1 << (side_bits - level) for level in range(side_bits + 1)]
    m = pmf_moments(window_pmf(points, side_bits, widths, axes, bits, periodic))
    level = F.lit(side_bits) - F.round(F.log2(F.col("width").cast("double"))).cast("int")
    rows = m.select(level.alias("level"), "mean", "var")
    d = len(axes)
    finer = F.lead("var").over(Window.orderBy("level"))  # one row a level
    # the parent's mean child has variance var / 4^d, so the spread of children within a parent is the rest
    return rows.select("level", "mean", "var", F.when(finer.isNull(), F.col("var")).otherwise(F.col("var") - (finer - F.col("var") / float(4**d))).alias("dvar"))


def cell_correlation(points: DataFrame, side_bits: int, lags: Sequence[int], axes: Sequence[str] = AXES, bits: int = 16) -> DataFrame:
    """(lag, xi): mean product of counts of cells ``lag`` apart along an axis (wrapped), over the squared mean, less 1; axes averaged."""
    side, d = 1 << side_bits, len(axes)
    grid = binned(points, side_bits, axes, bits)
    keys = [f"k{i}" for i in range(d)]
    moves = F.inline(F.array(*[F.struct(F.lit(lag).alias("lag"), F.lit(i).alias("axis")) for lag in lags for i in range(d)]))
    spread = grid.select(*keys, "n", moves)
    moved = spread.select("lag", "axis", *[F.when(F.col("axis") == i, F.pmod(F.col(k) + F.col("lag"), F.lit(side))).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)], F.col("n").alias("m"))
    products = moved.join(grid, keys).groupBy("lag").agg(F.sum(F.col("n") * F.col("m")).alias("s"))
    total = grid.agg(F.sum("n").alias("t"))
    cells = float(side**d)
    every = points.sparkSession.createDataFrame([(int(x),) for x in lags], "lag int")
    return every.join(products, "lag", "left").crossJoin(F.broadcast(total)).select("lag", (F.coalesce("s", F.lit(0)) / (d * cells) / F.pow(F.col("t") / cells, 2) - 1).alias("xi"))


def log_sides(low: int, high: int, d: int, per_decade: float) -> list[int]:
    """Whole window sides from low to high, ``per_decade`` a decade of volume, each once."""
    step = 1 / (d * per_decade)
    n = math.ceil((math.log10(high) - math.log10(low)) / step) + 1
    return sorted({min(high, max(low, math.floor(low * 10 ** (k * step) + 0.5))) for k in range(n + 1)})
