"""Smoothing kernels, shell volumes and halo occupation as expressions and plain numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def shell_volume(inner: float, outer: float) -> float:
    return 4 / 3 * math.pi * (outer**3 - inner**3)


def shell_volumes(edges: Sequence[float]) -> list[float]:
    return [shell_volume(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def top_hat(r: Column, radius: float) -> Column:
    """Density of pair separations in a ball, over shell volume."""
    x = r / F.lit(radius)
    return F.when(x <= 2, (1 - 0.75 * x + x * x * x / 16) * F.lit(3 / (4 * math.pi * radius**3))).otherwise(0.0)


def top_hat_slope(r: Column, radius: float) -> Column:
    """Derivative of top_hat in the radius."""
    x = r / F.lit(radius)
    return F.when(x <= 2, (1 - x + x * x * x / 8) * F.lit(-9 / (4 * math.pi * radius**4))).otherwise(0.0)


def gauss(r: Column, radius: float) -> Column:
    return F.exp(-r * r / F.lit(4 * radius * radius)) * F.lit((4 * math.pi) ** -1.5 * radius**-3)


def lens(r: Column, a: float, b: float) -> Column:
    """Volume that two balls of radii a and b share at a distance r of their centres."""
    small = 4 / 3 * math.pi * min(a, b) ** 3
    part = math.pi * F.pow(F.lit(a + b) - r, 2) * (r * r + 2 * r * F.lit(a + b) - F.lit(3 * (a - b) ** 2)) / (12 * F.when(r > 0, r).otherwise(1.0))
    return F.when(r >= F.lit(a + b), 0.0).when(r <= F.lit(abs(a - b)), F.lit(small)).otherwise(part)


def shell(r: Column, inner: float, outer: float) -> Column:
    """Kernel of a thick shell."""
    if outer <= inner:
        raise ValueError("the outer radius must be larger")
    return (lens(r, outer, outer) - 2 * lens(r, inner, outer) + lens(r, inner, inner)) / F.lit(shell_volume(inner, outer) ** 2)


def box_1d(r: Column, side: float) -> Column:
    """Density of the distance of two points in an interval."""
    return F.when(r <= F.lit(side), 2 * (F.lit(side) - r) / F.lit(side * side)).otherwise(0.0)


KERNELS = {"top_hat": top_hat, "gauss": gauss}


def _top_hat_array(r: np.ndarray, radius: float) -> np.ndarray:
    x = r / radius
    k = x * x
    k /= 16
    k -= 0.75
    k *= x
    k += 1
    k *= 3 / (4 * math.pi * radius**3)
    k *= x <= 2
    return k


def _gauss_array(r: np.ndarray, radius: float) -> np.ndarray:
    return np.exp(-r * r / (4 * radius * radius)) * ((4 * math.pi) ** -1.5 * radius**-3)


#: The same of arrays.
ARRAY_KERNELS = {"top_hat": _top_hat_array, "gauss": _gauss_array}
#: Beyond so many radii a kernel is taken as zero.
SUPPORT = {"top_hat": 2.0, "gauss": 6.0}


def erf(x: Column) -> Column:
    """The error function, which Spark lacks, in Arrow batches."""
    return pandas_udf(_erf, "double")(x)


def _erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore")


def occupation(mass: Column, log_m_min: float, sigma: float, m0: float, m1: float, alpha: float) -> Column:
    """Mean number of galaxies of a halo: centrals by an error function, satellites by a power law times centrals."""
    centrals = 0.5 * (1 + erf((F.log10(mass) - F.lit(log_m_min)) / F.lit(sigma)))
    satellites = F.pow(F.greatest(F.lit(0.0), (mass - F.lit(m0)) / F.lit(m1)), F.lit(alpha))
    return centrals * (1 + satellites)
