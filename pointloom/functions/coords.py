"""Coordinate and binning expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantize(x: Column, box: float, bits: int = 16) -> Column:
    """Wrap into [0, box) and floor to a lattice of 2^bits cells."""
    cell = F.floor(F.pmod(x, F.lit(float(box))) / F.lit(float(box)) * F.lit(float(1 << bits)))
    return F.when(x.isNotNull(), F.least(cell, F.lit((1 << bits) - 1)).cast("long"))


def periodic_diff(dx: Column, box: float) -> Column:
    """Minimum image; halves go to the even multiple."""
    return dx - F.lit(float(box)) * F.rint(dx / F.lit(float(box)))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin [e_k, e_{k+1}), null outside."""
    k = sum(F.when(value >= F.lit(e), 1).otherwise(0) for e in edges) - 1
    return F.when((value >= F.lit(edges[0])) & (value < F.lit(edges[-1])), k)


def cap_of(value: Column, tops: Sequence[float]) -> Column:
    """Number of the first closed cap that holds the value (value <= top), null beyond the last."""
    k = sum(F.when(value > F.lit(t), 1).otherwise(0) for t in tops)
    return F.when(value <= F.lit(tops[-1]), k)


def soft_bin(value: Column, edges: Sequence[float]) -> Column:
    """Linear split between neighbouring logarithmic bin centres: array of struct(bin, part), empty outside [e_0, e_n)."""
    centres = [0.5 * (math.log(a) + math.log(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    n = len(centres)
    x = F.ln(value)
    low = F.greatest(F.least(sum(F.when(x >= F.lit(c), 1).otherwise(0) for c in centres) - 1, F.lit(n - 2)), F.lit(0))
    array = F.array(*[F.lit(c) for c in centres])
    a, b = F.element_at(array, low + 1), F.element_at(array, low + 2)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    split = F.array(F.struct(low.alias("bin"), (1 - part).alias("part")), F.struct((low + 1).alias("bin"), part.alias("part")))
    return F.when((value >= F.lit(edges[0])) & (value < F.lit(edges[-1])), split).otherwise(F.filter(split, lambda s: F.lit(False)))


def unit_vector(ra: Column, sin_dec: Column) -> tuple[Column, Column, Column]:
    """Direction of (right ascension in degrees, sine of declination)."""
    across = F.sqrt(F.greatest(F.lit(0.0), 1 - sin_dec * sin_dec))
    return F.cos(F.radians(ra)) * across, F.sin(F.radians(ra)) * across, sin_dec


def chord(theta_deg: float) -> float:
    """Chord of an angle on the unit sphere."""
    return 2 * math.sin(math.radians(theta_deg) / 2)


def bisector(p1: Sequence[Column], p2: Sequence[Column]) -> tuple[Column, Column]:
    """(rp, pi) of a pair about the line of sight to its midpoint; pi is 0 if the midpoint is the origin."""
    s = [b - a for a, b in zip(p1, p2, strict=True)]
    m = [(a + b) / 2 for a, b in zip(p1, p2, strict=True)]
    norm = F.sqrt(sum(x * x for x in m))
    pi = F.when(norm > 0, F.abs(sum(x * y for x, y in zip(s, m, strict=True)) / norm)).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), sum(x * x for x in s) - pi * pi)), pi


def root_reaches(edge: float) -> float:
    """The least x whose rounded square root reaches the edge: comparing x with it decides as comparing the root does."""
    if edge <= 0:
        return -math.inf
    x = edge * edge
    while math.sqrt(x) < edge:
        x = math.nextafter(x, math.inf)
    while math.sqrt(below := math.nextafter(x, 0.0)) >= edge:
        x = below
    return x


class Sights:
    """bisector() of all pairs of two sets (d, n) of points, as the square of rp and pi, in memory that is written over.

    With A and B the squared distances of the ends from the origin pi is |B - A| / sqrt(2 A + 2 B - d2).
    """

    def __init__(self, here: np.ndarray, there: np.ndarray, size: int):
        self.here, self.there = here, there
        self.a, self.b = ((x * x).sum(0) for x in (here, there))
        self.opposed = not all((x > 0).all() for x in (here, there))  # a middle could be the origin
        self.room = np.empty((2, size))

    def __call__(self, block: np.ndarray, chunk: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where d2 is infinite they are out of every bin: infinite or no number."""
        a, b = self.a[block][:, None], self.b[chunk][None]
        sight, pi = (x[: d2.size].reshape(d2.shape) for x in self.room)
        np.subtract(b, a, out=pi)
        np.abs(pi, out=pi)
        np.add(2 * a, 2 * b, out=sight)
        np.subtract(sight, d2, out=sight)
        with np.errstate(invalid="ignore", over="ignore"):
            if self.opposed:
                np.maximum(sight, 1e-300, out=sight)
            np.divide(pi, np.sqrt(sight, out=sight), out=pi)
            np.multiply(pi, pi, out=sight)
            return np.subtract(d2, sight, out=sight), pi

    def narrow(self, rp: float, pi: float):
        """narrow(block, others): those of the others that can be within ``rp`` and ``pi`` of a point of the block."""

        def of(block: np.ndarray, others: np.ndarray) -> np.ndarray:
            a, b = self.a[block], self.b[others]
            low, high = a.min(), a.max()
            others = others[np.maximum(b - high, low - b) <= pi * (np.sqrt(b) + math.sqrt(high)) * (1 + 1e-9)]
            b, near, middle = self.b[others], 0.0, 0.0
            for x, y in zip(self.here, self.there, strict=True):
                least, most, v = x[block].min(), x[block].max(), y[others]
                near = near + np.maximum(np.maximum(least - v, v - most), 0.0) ** 2
                middle = middle + np.maximum(np.maximum(least + v, -most - v), 0.0) ** 2
            along = np.minimum(np.maximum(high - b, b - low) / np.sqrt(np.maximum(middle, 1e-300)), pi)  # pi is no larger, or the pair is none
            return others[near - along * along <= rp * rp * (1 + 1e-9)]

        return of


def ap_rescale(d: Column, mu: Column, alpha_par: float, alpha_perp: float) -> tuple[Column, Column]:
    """Separation and direction cosine after stretching along and across the line of sight."""
    along, across2 = F.lit(alpha_par) * d * mu, F.lit(alpha_perp**2) * d * d * (1 - mu * mu)
    new = F.sqrt(along * along + across2)
    return new, F.when(new > 0, F.abs(along) / new).otherwise(0.0)


def legendre_array(order: int, mu: np.ndarray) -> np.ndarray:
    """legendre() of an array."""
    if order == 0:
        return np.ones_like(mu)
    if order == 2:
        return 1.5 * mu * mu - 0.5
    if order == 4:
        return (35.0 * mu**4 - 30.0 * mu * mu + 3.0) / 8.0
    raise ValueError("order must be 0, 2 or 4")


def legendre(order: int, mu: Column) -> Column:
    """P_0, P_2 or P_4."""
    if order == 0:
        return F.lit(1.0)
    if order == 2:
        return 1.5 * mu * mu - 0.5
    if order == 4:
        return (35.0 * F.pow(mu, 4) - 30.0 * mu * mu + 3.0) / 8.0
    raise ValueError("order must be 0, 2 or 4")


#: Quantiles are off by one part in so many of the rows at most; tables of fewer rows give exact order statistics. Sketches of that size meet in the last step, not values.
ACCURACY = 100_000


def quantile_edges(df: DataFrame, column: str, n: int, low: float = 0.0, high: float = 1.0) -> list[float]:
    """n + 1 edges at uniform quantiles."""
    return df.agg(F.percentile_approx(F.col(column).cast("double"), [low + (high - low) * k / n for k in range(n + 1)], ACCURACY)).first()[0]


def decile_edges(df: DataFrame, column: str, n: int = 10, low: float = 0.05, high: float = 0.95) -> list[float]:
    """Edges midway between the quantiles of n values from low to high, and half way out on either side."""
    qs = [low + (high - low) * k / (n - 1) for k in range(n)]
    return df.agg(F.percentile_approx(F.col(column).cast("double"), [low / 2, *((a + b) / 2 for a, b in zip(qs[:-1], qs[1:], strict=True)), (1 + high) / 2], ACCURACY)).first()[0]


def log1pz_grid(z_min: float, z_max: float, n: int) -> list[float]:
    """Edges of n shells of equal width in ln(1 + z)."""
    a, b = math.log1p(z_min), math.log1p(z_max)
    return [math.expm1(a + (b - a) * k / n) for k in range(n + 1)]


def coordinate_range(points: DataFrame, axes: Sequence[str], *others: DataFrame) -> DataFrame:
    """axis, bit_min, bit_max: lowest and highest bit in use on each axis of one or more catalogs (-1 if none)."""
    whole = points.select(*axes)
    for o in others:
        whole = whole.unionByName(o.select(*axes))
    ored = whole.agg(*[F.coalesce(F.bit_or(a), F.lit(0)).alias(a) for a in axes])
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("long").alias("bits")) for a in axes]))
    low = F.when(F.col("bits") == 0, -1).otherwise(F.bit_count(F.col("bits").bitwiseAND(-F.col("bits")) - 1))
    high = F.when(F.col("bits") == 0, -1).otherwise(F.length(F.bin("bits")) - 1)
    return ored.select(rows).select("axis", low.cast("int").alias("bit_min"), high.cast("int").alias("bit_max"))
