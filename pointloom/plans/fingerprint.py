"""The fingerprint of a catalog in a periodic square: statistics by level, count distributions, cell correlation and a map, as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.windows import cell_correlation, shift_levels, window_pmf
from pointloom.sources.catalogs import halton, write_csv

PLANE = ("c0", "c1")


def fingerprint(points: DataFrame, depth: int = 6, map_level: int = 5, axes: Sequence[str] = PLANE, bits: int = 16) -> dict[str, DataFrame]:
    """Tables 'levels', 'pmf', 'correlation' (by cell lag) and 'map' (k1, k0, count) of a catalog of whole numbers in [0, 2^bits)."""
    sides = [1 << k for k in range(depth + 1)]
    at = [F.shiftright(F.col(a).cast("long"), bits - map_level).alias(k) for a, k in zip(axes, ("k0", "k1"), strict=True)]
    seen = points.select(*at).groupBy("k0", "k1").agg(F.count("*").alias("n"))
    n = 1 << map_level
    grid = points.sparkSession.range(n * n).select((F.col("id") % n).alias("k0"), F.floor(F.col("id") / n).alias("k1"))
    full = grid.join(seen, ["k0", "k1"], "left").select("k1", "k0", F.coalesce("n", F.lit(0)).alias("count"))
    return {"levels": shift_levels(points, depth, list(axes)), "pmf": window_pmf(points, depth, sides, list(axes)), "correlation": cell_correlation(points, depth, sides[:-1], list(axes)), "map": full}


def even_points(spark: SparkSession, n: int, bits: int = 16) -> DataFrame:
    """``n`` points spread evenly by low-discrepancy numbers, as a reference without clustering."""
    index, size = F.col("id") + 1, F.lit(float(1 << bits))
    place = lambda base: F.least(F.floor(halton(index, base) * size), F.lit((1 << bits) - 1)).cast("long")
    return spark.range(n).select(place(2).alias("c0"), place(3).alias("c1"))


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV in a folder of its name."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
