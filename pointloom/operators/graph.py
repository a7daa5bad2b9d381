"""Nearest-neighbour graphs, conditional means on them, and three-point counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.cells import ratio
from pointloom.operators.neighbours import k_nearest_lists
from pointloom.operators.pairs import triangles
from pointloom.operators.rangejoin import AXES, pairs


def nearest(a: DataFrame, b: DataFrame, k: int, radius: float, axes: Sequence[str] = AXES, keep: Sequence[str] = ("id",), same: bool = False, preceding: bool = False) -> DataFrame:
    """The ``k`` nearest points of ``b`` within ``radius`` of each point of ``a``: pairs() columns and rank; ties by id.

    ``same`` leaves out a point itself, ``preceding`` all but those with smaller ids. Points with
    fewer neighbours within the radius have fewer rows; neighbours.k_nearest() needs no radius.
    """
    p = pairs(a, b, radius, axes, keep)
    if same:
        p = p.where("a_id <> b_id")
    if preceding:
        p = p.where("b_id < a_id")
    order = Window.partitionBy("a_id").orderBy("d2", "b_id")
    return p.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def conditional_mean(new: DataFrame, known: DataFrame, covariance: Callable[[np.ndarray], np.ndarray], k: int, noise: float = 1e-6, axes: Sequence[str] = AXES) -> DataFrame:
    """(id, mean): Gaussian conditional mean at new points given ``value`` of their k nearest known points.

    A covariance of distances is solved for batches of points with as many
    neighbours (k, or all known points if they are fewer). Each id of ``new`` has a row: where no known
    point has a distance, as with none or without coordinates, the mean is that of the prior, 0.
    """
    n = k_nearest_lists(new.withColumn("value", F.lit(0.0)), known, k, axes, ("id", "value"))
    mine = F.array(*[F.col(f"a_{x}").cast("double") for x in axes]).alias("at")
    near = n.select("a_id", mine, F.transform("near", lambda p: F.struct(F.array(*[p[f"b_{x}"].cast("double") for x in axes]).alias("x"), p["b_value"].cast("double").alias("v"))).alias("near"))
    d = len(axes)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes, rows = lists.value_lengths().to_numpy(), lists.flatten()
            x, v = rows.field(0).flatten().to_numpy().reshape(-1, d), rows.field(1).to_numpy()
            at, starts = batch.column(1).flatten().to_numpy().reshape(-1, d), np.cumsum(sizes) - sizes
            mean = np.empty(len(sizes))
            for m in np.unique(sizes):  # points with as many neighbours are solved together
                of = np.flatnonzero(sizes == m)
                rows_of = starts[of][:, None] + np.arange(m)
                xs = x[rows_of]
                c = covariance(np.sqrt(((xs[:, :, None] - xs[:, None]) ** 2).sum(-1))) + noise * np.eye(m)
                own = covariance(np.sqrt(((xs - at[of][:, None]) ** 2).sum(-1)))
                mean[of] = (own * np.linalg.solve(c, v[rows_of][..., None])[..., 0]).sum(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean)], ["id", "mean"])

    solved = near.select(F.col("a_id").cast("long").alias("id"), "at", "near").mapInArrow(solve, "id long, mean double")
    return new.select(F.col("id").cast("long").alias("id")).distinct().join(solved, "id", "left").select("id", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def three_point(data: DataFrame, randoms: DataFrame, sides: Sequence[float], width: float, axes: Sequence[str] = AXES) -> DataFrame:
    """(side, ddd, rrr, zeta): near-equilateral triangles of data over those of randoms, brought to one catalog size, less 1; all triangles are counted."""
    spark = data.sparkSession
    sizes = data.agg(F.count("*").cast("double").alias("nd")).crossJoin(randoms.agg(F.count("*").cast("double").alias("nr")))
    out = None
    for s in sides:
        both = [triangles(df, s, width, axes).agg((F.coalesce(F.sum("n"), F.lit(0)) / 3).cast("long").alias(name)) for df, name in ((data, "ddd"), (randoms, "rrr"))]
        row = spark.createDataFrame([(float(s),)], "side double").crossJoin(both[0]).crossJoin(both[1]).crossJoin(sizes)  # one row each
        out = row if out is None else out.unionByName(row)
    choose = lambda n: n * (n - 1) * (n - 2)
    return out.select("side", "ddd", "rrr", (ratio(F.col("ddd") * choose(F.col("nr")), F.col("rrr") * choose(F.col("nd"))) - 1).alias("zeta"))
