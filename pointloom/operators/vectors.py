"""Neighbour counts of long vectors, over all pairs, without a row for a pair.

Where most pairs lie near the radius no cells and no pivots rule any out. Both tables are dealt
into parts by id, each part of one meets each part of the other in one group, and a group's
squared distances are matrix products of small blocks. What lies too near the radius for
their rounding is summed again component by component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most vectors of a part, on average.
PART = 8_192
#: Vectors of a block (2 MB for the distances of two).
BLOCK = 512


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Components, 0 where there is none, and which there are."""
    lists = column.combine_chunks()
    inside = np.arange(width) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]
    flat = lists.flatten()
    values, present = np.zeros(inside.shape), inside.copy()
    values[inside] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    present[inside] = flat.is_valid().to_numpy(zero_copy_only=False)
    return values, present


def _exact(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in the order of the components; infinite without a common one."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        g = x[:, k] - y[:, k]
        s += np.where(both[:, k], g * g, 0.0)
    return np.where(both.any(1), s, np.inf)


def _count(x: np.ndarray, has_x: np.ndarray, y: np.ndarray, has_y: np.ndarray, ids: np.ndarray, others: np.ndarray, top: float, same: bool) -> np.ndarray:
    """For each row of ``x`` the rows of ``y`` of other ids (all, unless ``same``) at a squared distance below ``top``."""
    norms = [(v * v).sum(1) for v in (x, y)]
    if has_x.all() and has_y.all() and x.shape[1]:
        left, right = np.column_stack([-2 * x, norms[0], np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), norms[1]])
        shared = None
    else:  # a component that one of both lacks counts for neither
        left, right = np.concatenate([-2 * x, x * x, has_x], 1), np.concatenate([y, has_y, y * y], 1)
        shared = has_x.astype(float), has_y.astype(float)
    error = 8 * (left.shape[1] + 2) * np.finfo(float).eps
    n = np.zeros(len(x), np.int64)
    blocks = [[o[s : s + BLOCK] for s in range(0, len(o), BLOCK)] for o in map(np.argsort, norms)]  # a huge vector makes doubtful those of its block alone
    for i in blocks[0]:
        for j in blocks[1]:
            d2 = left[i] @ right[j].T
            doubt = error * (norms[0][i].max() + norms[1][j].max())
            near = d2 < top - doubt
            open_ = ~(near | (d2 > top + doubt))
            if shared:
                open_ |= near & (shared[0][i] @ shared[1][j].T == 0)
            if open_.any():
                p, q = np.nonzero(open_)
                for s in range(0, len(p), BLOCK * BLOCK // 8):
                    a, b = p[s : s + BLOCK * BLOCK // 8], q[s : s + BLOCK * BLOCK // 8]
                    near[a, b] = _exact(x[i[a]], y[j[b]], has_x[i[a]] & has_y[j[b]]) < top
            if same:
                near &= ids[i][:, None] != others[j][None]
            n[i] += near.sum(1)
    return n


def near_counts(a: DataFrame, b: DataFrame, top: float, vector: str, same: bool = False) -> DataFrame:
    """(id, n): for each id of ``a`` the pairs of its vectors with those of ``b`` at a squared distance below ``top``; none has no row.

    Components that one of both lacks, by null or by length, are left out of the distance, and
    vectors without a common one are not near. ``same`` leaves out pairs of one id. Rows without
    id or vector meet nothing. All pairs are worked out: time grows with their number, memory of a task does not.
    """
    named = lambda df: df.select("id", F.col(vector).alias("v")).where("id is not null and v is not null")
    left, right = named(a), named(b)
    sizes = [left.count(), right.count()]
    least = math.ceil(math.sqrt(2 * a.sparkSession.sparkContext.defaultParallelism))
    na, nb = (max(math.ceil(n / PART), least) for n in sizes) if not same else [max(math.ceil(max(sizes) / PART), least)] * 2
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # ids repeat seldom, so parts are even; by ids, pairs of one id meet in groups of equal parts alone
    left = left.select("id", "v", own(na).alias("_pa"), every(nb).alias("_pb"))
    right = right.select("id", "v", every(na).alias("_pa"), own(nb).alias("_pb"))

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        ids = one.column("id")
        n = np.zeros(len(ids), np.int64)
        if one.num_rows and other.num_rows:
            width = max(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max() for t in (one, other))
            met = same and one.column("_pa")[0] == one.column("_pb")[0]
            with np.errstate(invalid="ignore", over="ignore"):
                n = _count(*_matrix(one.column("v"), width), *_matrix(other.column("v"), width), ids.to_numpy(), other.column("id").to_numpy(), top, met)
        return pa.table({"id": ids, "n": n})

    met = left.groupBy("_pa", "_pb").cogroup(right.groupBy("_pa", "_pb")).applyInArrow(run, f"id {dict(left.dtypes)['id']}, n long")
    return met.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
