"""Density weights by a Wiener filter whose covariance is a correlation function.

The covariance matrix is kept as a table of the pairs that the curve reaches, made once. The
system is solved by conjugate residuals, which also takes matrices that a noisy curve leaves
indefinite: each round is one join of the pairs with a vector and one row of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.continuous import tents
from pointloom.operators.neighbours import cut
from pointloom.operators.pairs import neighbour_density
from pointloom.operators.rangejoin import AXES, self_pairs


def kernel_radius(density: float, neighbours: float = 30.0) -> float:
    """Radius of the ball that holds so many points at a mean density."""
    return (3 * neighbours / (4 * math.pi * density)) ** (1 / 3)


def overdensity(points: DataFrame, radius: float, axes: Sequence[str] = AXES, box: float | None = None) -> DataFrame:
    """(id, nbar, d): other points within a radius, over volume and the point's ``nbar``, less 1."""
    return points.select("id", "nbar").join(neighbour_density(points, points, radius, axes, box), "id").select("id", "nbar", (F.col("density") / F.col("nbar") - 1).alias("d"))


def wiener_weights(points: DataFrame, centres: Sequence[float], xi: Sequence[float], radius: float, axes: Sequence[str] = AXES, box: float | None = None, centred: bool = True, rounds: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """(id, weight): 1 + C (C + N)^-1 d for the overdensities d in balls of a radius, less their mean if ``centred``.

    C is straight between ``xi`` at ``centres``, xi_0 below and 0 beyond, with max(xi_0, 1) on
    the diagonal; N is the shot noise 1 / (nbar volume). Ids are unique. An empty catalog gives none.
    """
    c = sum(t * F.lit(float(x)) for t, x in zip(tents(F.sqrt("d2"), centres), xi, strict=True))
    return _filtered(points, c, centres[-1], max(xi[0], 1.0), radius, axes, box, centred, rounds, tolerance)


def basis_weights(points: DataFrame, coefficients: Sequence[float], basis: Callable[[Column], list[Column]], low: float, high: float, radius: float, axes: Sequence[str] = AXES, box: float | None = None, centred: bool = True, rounds: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """wiener_weights() with the covariance sum_k coefficients_k basis_k(r) for r < ``high``, and that at ``low``, 1 at least, on the diagonal.

    The matrix may be indefinite; the rounds take that.
    """
    curve = lambda r: sum((F.lit(float(c)) * f for c, f in zip(coefficients, basis(r), strict=True)), F.lit(0.0))
    variance = max(points.sparkSession.range(1).select(curve(F.lit(float(low))).alias("v")).first().v, 1.0)
    return _filtered(points, curve(F.sqrt("d2")), high, variance, radius, axes, box, centred, rounds, tolerance)


def _filtered(points: DataFrame, c: Column, reach: float, variance: float, radius: float, axes: Sequence[str], box: float | None, centred: bool, rounds: int, tolerance: float) -> DataFrame:
    volume = 4 / 3 * math.pi * radius**3
    one = self_pairs(points, reach, axes, ("id",), box).select("a_id", "b_id", c.alias("c"))
    pairs = cut(one.union(one.select("b_id", "a_id", "c")))
    start = overdensity(points, radius, axes, box)
    if centred:
        start = start.crossJoin(F.broadcast(start.agg(F.avg("d").alias("mean")))).withColumn("d", F.col("d") - F.col("mean"))  # one row
    noise = 1 / (F.col("nbar") * F.lit(volume)) + F.lit(1e-6 * variance)

    def covariance(state: DataFrame, name: str, to: str, full: bool) -> DataFrame:
        """``state`` with C times a column, or (C + N) times it."""
        sums = pairs.join(state.select(F.col("id").alias("b_id"), F.col(name).alias("v")), "b_id").groupBy(F.col("a_id").alias("id")).agg(F.sum(F.col("c") * F.col("v")).alias("s"))
        diagonal = F.lit(variance) + (noise if full else F.lit(0.0))
        return state.join(sums, "id", "left").withColumn(to, F.coalesce("s", F.lit(0.0)) + diagonal * F.col(name)).drop("s")

    state = start.select("id", "nbar", F.lit(0.0).alias("x"), F.col("d").alias("r"), F.col("d").alias("p"))
    state = cut(covariance(state, "r", "ar", True).withColumn("ap", F.col("ar")))
    dots = lambda s: s.agg(F.sum(F.col("r") * F.col("ar")), F.sum(F.col("ap") * F.col("ap")), F.sum(F.col("r") * F.col("r"))).first()
    rar, apap, rr = dots(state)
    first = rr
    for _ in range(rounds):
        if not rr or rr <= tolerance**2 * first or not apap:
            break
        step = rar / apap
        moved = state.withColumn("x", F.col("x") + F.lit(step) * F.col("p")).withColumn("r", F.col("r") - F.lit(step) * F.col("ap")).drop("ar")
        moved = cut(covariance(moved, "r", "ar", True))
        new = moved.agg(F.sum(F.col("r") * F.col("ar"))).first()[0]
        turn = new / rar if rar else 0.0
        state = moved.withColumn("p", F.col("r") + F.lit(turn) * F.col("p")).withColumn("ap", F.col("ar") + F.lit(turn) * F.col("ap"))
        rar, apap, rr = dots(state)
    return covariance(state.select("id", "nbar", "x"), "x", "mu", False).select("id", (1 + F.col("mu")).alias("weight"))
