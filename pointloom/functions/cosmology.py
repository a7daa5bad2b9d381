"""Distances from redshifts: a table of the comoving distance, joined by grid cell and interpolated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speed of light over 100 km/s/Mpc.
C_OVER_H100 = 2997.92458
Z_MAX, N_GRID = 4.0, 4000


@dataclass(frozen=True)
class Cosmology:
    om: float = 0.31
    w0: float = -1.0
    wa: float = 0.0

    def e(self, z):
        a = 1 / (1 + z)
        dark = (1 - self.om) * a ** (-3 * (1 + self.w0 + self.wa)) * np.exp(-3 * self.wa * (1 - a))
        return np.sqrt(self.om * (1 + z) ** 3 + dark)

    def table(self, z_max: float = Z_MAX, n: int = N_GRID) -> tuple[np.ndarray, np.ndarray]:
        z = np.linspace(0, z_max, n)
        f = 1 / self.e(z)
        return z, C_OVER_H100 * np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(z))])


def e_of_z(z: Column, cosmology: Cosmology) -> Column:
    a = 1 / (1 + z)
    dark = F.lit(1 - cosmology.om) * F.pow(a, F.lit(-3 * (1 + cosmology.w0 + cosmology.wa))) * F.exp(F.lit(-3 * cosmology.wa) * (1 - a))
    return F.sqrt(F.lit(cosmology.om) * F.pow(1 + z, 3) + dark)


def with_distance(points: DataFrame, cosmology: Cosmology = Cosmology(), z: str = "z", name: str = "chi") -> DataFrame:  # noqa: B008
    """Add the comoving distance. Redshifts beyond the table's end are clamped; a null redshift has none."""
    zs, ds = cosmology.table()
    step = float(zs[1])
    rows = [(i, float(ds[i]), float(ds[i + 1] - ds[i])) for i in range(len(zs) - 1)]
    table = points.sparkSession.createDataFrame(rows, "_cell long, _d0 double, _dd double")
    held = F.when(F.col(z).isNotNull(), F.least(F.greatest(F.col(z), F.lit(0.0)), F.lit(float(zs[-1]))))
    celled = points.withColumn("_at", held / F.lit(step)).withColumn("_cell", F.when(F.col("_at").isNotNull(), F.least(F.floor("_at"), F.lit(len(rows) - 1))))
    joined = celled.join(F.broadcast(table), "_cell", "left")  # N_GRID rows
    return joined.withColumn(name, F.col("_d0") + (F.col("_at") - F.col("_cell")) * F.col("_dd")).drop("_cell", "_at", "_d0", "_dd")


def cartesian(ra: Column, dec: Column, chi: Column) -> tuple[Column, Column, Column]:
    return (chi * F.cos(F.radians(dec)) * F.cos(F.radians(ra)), chi * F.cos(F.radians(dec)) * F.sin(F.radians(ra)), chi * F.sin(F.radians(dec)))


def with_redshift(points: DataFrame, cosmology: Cosmology = Cosmology(), chi: str = "chi", name: str = "z") -> DataFrame:  # noqa: B008
    """Add the redshift of a comoving distance: the inverse of the distance table, joined by cells of equal distance. Distances beyond its end are clamped; null has none."""
    zs, ds = cosmology.table()
    grid = np.linspace(0, float(ds[-1]), N_GRID)
    at = np.interp(grid, ds, zs)
    step = float(grid[1])
    rows = [(i, float(at[i]), float(at[i + 1] - at[i])) for i in range(N_GRID - 1)]
    table = points.sparkSession.createDataFrame(rows, "_cell long, _z0 double, _dz double")
    held = F.when(F.col(chi).isNotNull(), F.least(F.greatest(F.col(chi), F.lit(0.0)), F.lit(float(ds[-1]))))
    celled = points.withColumn("_at", held / F.lit(step)).withColumn("_cell", F.when(F.col("_at").isNotNull(), F.least(F.floor("_at"), F.lit(len(rows) - 1))))
    joined = celled.join(F.broadcast(table), "_cell", "left")  # N_GRID rows
    return joined.withColumn(name, F.col("_z0") + (F.col("_at") - F.col("_cell")) * F.col("_dz")).drop("_cell", "_at", "_z0", "_dz")


def to_sky(points: DataFrame, cosmology: Cosmology = Cosmology(), axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:  # noqa: B008
    """``points`` with ra, dec in degrees and red, the redshift, from Cartesian positions; the origin has redshift 0 and direction 0."""
    x, y, z = (F.col(a) for a in axes)
    r = F.sqrt(x * x + y * y + z * z)
    placed = points.withColumn("_r", r).withColumn("ra", F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))).withColumn("dec", F.when(r > 0, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))))).otherwise(0.0))
    return with_redshift(placed, cosmology, "_r", "red").drop("_r")


def shifted_to_positive(data: DataFrame, randoms: DataFrame, axes: tuple[str, ...], margin: float = 100.0) -> tuple[DataFrame, DataFrame, float]:
    """Both catalogs moved so that the least coordinate of each axis is ``margin``, and the side of a box that holds them with a margin."""
    both = data.select(*axes).unionByName(randoms.select(*axes))
    ends = both.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    move = lambda df: df.withColumns({a: F.col(a) - F.lit(float(ends[f"low_{a}"])) + F.lit(margin) for a in axes})
    return move(data), move(randoms), max(ends[f"high_{a}"] - ends[f"low_{a}"] for a in axes) + 2 * margin
