"""A continuous correlation function through shell estimates of many runs, and cell variances from it.

Shells come in as one row each; the fit itself is a small linear system on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.cells import ratio

#: Points of the quadrature in a shell.
POINTS = 8


def basis_at(r, knots: int, low: float, high: float) -> np.ndarray:
    """Tents on knots evenly spaced in ln r, one row a distance; 0 outside the knots."""
    r = np.atleast_1d(np.asarray(r, float))
    x = (np.log(np.where(r > 0, r, 1.0)) - math.log(low)) / (math.log(high / low) / (knots - 1))
    tents = np.maximum(0.0, 1 - np.abs(x[:, None] - np.arange(knots)))
    return np.where(((r > 0) & (x >= -1e-12) & (x <= knots - 1 + 1e-12))[:, None], tents, 0.0)


def design_row(inner: float, outer: float, knots: int, low: float, high: float, d: int = 3, rr: float | None = None) -> np.ndarray:
    """Mean of the tents over a shell, pairs spread as r^(d - 1), or evenly over the shell where ``rr`` is a positive count."""
    x, w = np.polynomial.legendre.leggauss(POINTS)
    r = (outer + inner) / 2 + (outer - inner) / 2 * x
    density = np.ones_like(r) if rr else r ** (d - 1.0)
    return (basis_at(r, knots, low, high) * (w * density)[:, None]).sum(axis=0) / (w * density).sum()


@dataclass(frozen=True)
class ContinuousXi:
    knots: int
    low: float
    high: float
    coefficients: np.ndarray
    covariance: np.ndarray
    used: int
    reduced_chi2: float

    def at(self, r) -> np.ndarray:
        return basis_at(r, self.knots, self.low, self.high) @ self.coefficients

    def sigma(self, r) -> np.ndarray:
        b = basis_at(r, self.knots, self.low, self.high)
        return np.sqrt(np.maximum(0.0, ((b @ self.covariance) * b).sum(axis=1)))


def fit_xi(shells: DataFrame, knots: int, low: float, high: float, weighting: str = "bootstrap", empirical: bool = False, d: int = 3) -> ContinuousXi:
    """Weighted least squares through (inner, outer, xi, var, dd, rr) rows, one a shell.

    ``weighting``: 'bootstrap' by 1 / var, shells without one left out; 'poisson' by 1 over the
    larger of var and 1 / (dd + 1); 'uniform'. ``empirical`` spreads pairs evenly within a shell
    that has randoms. Shells without a finite xi or that reach 0 are left out; fewer of them
    than knots raise a ValueError.
    """
    rows = []
    for s in shells.select("inner", "outer", "xi", "var", "dd", "rr").collect():
        var = {"bootstrap": s["var"], "poisson": max(s["var"] or 0.0, 1 / ((s["dd"] or 0.0) + 1)), "uniform": 1.0}[weighting]
        if s["xi"] is not None and math.isfinite(s["xi"]) and 0 < s["inner"] < s["outer"] and var is not None and math.isfinite(var) and var > 0:
            rows.append((design_row(s["inner"], s["outer"], knots, low, high, d, s["rr"] if empirical else None), s["xi"], var))
    if len(rows) < knots:
        raise ValueError(f"{len(rows)} shells for {knots} knots")
    a, y, var = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    normal = a.T @ (a / var[:, None])
    normal += np.eye(knots) * 1e-12 * np.trace(normal) / knots
    covariance = np.linalg.inv(normal)
    c = covariance @ (a.T @ (y / var))
    return ContinuousXi(knots, low, high, c, covariance, len(rows), float(((y - a @ c) ** 2 / var).sum() / max(1, len(rows) - knots)))


def shift_shells(xi: DataFrame, sides: float = 1.0, d: int = 3) -> DataFrame:
    """(scale, level, inner, outer, xi, var, dd, rr) from the shells of single runs (run, scale, level, dd, rr, xi): their mean, and its variance over shifts.

    The shell of a level reaches from half the finer cell's side to half the own cell's.
    """
    side = F.lit(sides) * F.col("scale") / F.pow(F.lit(2.0), F.col("level"))
    mean = xi.groupBy("scale", "level").agg(F.avg("xi").alias("xi"), (F.var_samp("xi") / F.count("xi")).alias("var"), F.sum("dd").alias("dd"), F.sum("rr").alias("rr"))
    return mean.select("scale", "level", (side / 4).alias("inner"), (side / 2).alias("outer"), "xi", "var", "dd", "rr")


@dataclass(frozen=True)
class CubeKernel:
    """Density of the distance of two random points of a cube of side 1, in equal bins up to its diagonal; straight between their middles."""

    d: int
    density: np.ndarray
    pairs: int

    @staticmethod
    def sampled(d: int, pairs: int = 200_000, bins: int = 64, seed: int = 0) -> CubeKernel:
        r = np.random.default_rng(seed)
        apart = np.sqrt(((r.random((pairs, d)) - r.random((pairs, d))) ** 2).sum(axis=1))
        counts, _ = np.histogram(apart, bins, (0, math.sqrt(d)))
        return CubeKernel(d, counts * bins / math.sqrt(d) / pairs, pairs)

    def support(self, side: float) -> float:
        return side * math.sqrt(self.d)

    def at(self, r, side: float) -> np.ndarray:
        mids = (np.arange(len(self.density)) + 0.5) * math.sqrt(self.d) / len(self.density)
        x = np.asarray(r, float) / side
        return np.where((x >= 0) & (x <= math.sqrt(self.d)), np.interp(x, mids, self.density), 0.0) / side


def kernel_betas(shells: Sequence[tuple[float, float]], kernel: CubeKernel, side: float) -> list[float]:
    """The weight of each shell's xi in the variance of a cell: kernel at the middle times width, 0 beyond the kernel."""
    return [float(kernel.at((a + b) / 2, side)) * (b - max(a, 0.0)) if max(a, 0.0) < kernel.support(side) else 0.0 for a, b in shells]


def cell_variances(shells: DataFrame, kernel: CubeKernel, sides: dict[float, float]) -> DataFrame:
    """(scale, variance): the sum of xi times kernel_betas() over the shells of each scale, for a cell side each; shells without a finite xi left out."""
    rows = [(float(s["scale"]), int(s["level"]), kernel_betas([(s["inner"], s["outer"])], kernel, sides[s["scale"]])[0]) for s in shells.where(F.col("scale").isin(list(sides))).select("scale", "level", "inner", "outer").distinct().collect()]
    betas = shells.sparkSession.createDataFrame(rows, "scale double, level int, beta double")  # one row a shell
    return shells.where("xi is not null and not isnan(xi)").join(F.broadcast(betas), ["scale", "level"]).groupBy("scale").agg(F.sum(F.col("xi") * F.col("beta")).alias("variance"))


def run_xi(cells: DataFrame) -> DataFrame:
    """(run, scale, level, dd, rr, xi): the Landy-Szalay shells of every run by itself, from run_cells()."""
    from pyspark.sql import Window

    half = lambda k: F.sum((F.col(f"sw_{k}") * F.col(f"sw_{k}") - F.col(f"sw2_{k}")) / 2)
    s = cells.groupBy("run", "scale", "level").agg(half("d").alias("dd"), half("r").alias("rr"), F.sum(F.col("sw_d") * F.col("sw_r")).alias("dr"))
    order = Window.partitionBy("run").orderBy("level")  # one row a level
    shells = s.select("run", "scale", "level", *[(F.col(x) - F.lead(x, 1, 0.0).over(order)).alias(x) for x in ("dd", "dr", "rr")])
    coarsest = cells.groupBy("run").agg(F.min("level").alias("level"))
    t = cells.join(F.broadcast(coarsest), ["run", "level"]).groupBy("run").agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in "dr" for x in ("sw", "sw2")])  # one row a run
    j = shells.join(F.broadcast(t), "run")
    fdd = ratio(F.col("dd"), (F.col("sw_d") * F.col("sw_d") - F.col("sw2_d")) / 2)
    frr = ratio(F.col("rr"), (F.col("sw_r") * F.col("sw_r") - F.col("sw2_r")) / 2)
    fdr = ratio(F.col("dr"), F.col("sw_d") * F.col("sw_r"))
    return j.select("run", "scale", "level", "dd", "rr", ratio(fdd - 2 * fdr + frr, frr).alias("xi"))
