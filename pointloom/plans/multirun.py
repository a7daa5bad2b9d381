"""Plans of shifted and resized runs, their application to catalogs, and pooling across runs.

A plan is a small table (run, scale, off0..off{D-1}), offsets and scale as parts of the box.
The run becomes a column of the points, so one query serves all runs of a plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.operators.cells import AXES, _keys, moments, ratio


def shifted_grid(n: int, d: int) -> list[tuple]:
    """n^D runs on a lattice of offsets, at scale 1."""
    return [(f"shift_{'_'.join(map(str, o))}", 1.0, *[x / n for x in o]) for o in product(range(n), repeat=d)]


def random_offsets(n: int, magnitude: float, d: int, seed: int = 0) -> list[tuple]:
    """n runs offset in random directions by ``magnitude``, wrapped into the box."""
    v = np.random.default_rng(seed).standard_normal((n, d))
    v = np.mod(v / np.linalg.norm(v, axis=1, keepdims=True) * magnitude, 1.0)
    return [(f"random_{i}", 1.0, *map(float, row)) for i, row in enumerate(v)]


def log_resizings(low: float, high: float, per_decade: float, d: int) -> list[tuple]:
    """Runs at scales from low to high, ``per_decade`` a decade of volume; both ends, and 1 where it lies between, are among them. Scales within 1e-6 come once."""
    step = 1 / (d * per_decade)
    n = max(0, math.ceil((math.log10(high) - math.log10(low)) / step - 1e-9))
    scales = sorted([min(high, low * 10 ** (k * step)) for k in range(n + 1)] + [s for s in (1.0,) if low <= s <= high])
    kept = [s for i, s in enumerate(scales) if i == 0 or s - scales[i - 1] >= 1e-6]
    return [(f"scale_{s:.6g}", s, *[0.0] * d) for s in kept]


def compose(a: Sequence[tuple], b: Sequence[tuple]) -> list[tuple]:
    """Every run of ``b`` within every run of ``a``: offset a + b * scale_a, scale the product."""
    return [(f"{x[0]}/{y[0]}", x[1] * y[1], *[p + q * x[1] for p, q in zip(x[2:], y[2:], strict=True)]) for x in a for y in b]


def plan(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    d = len(rows[0]) - 2
    return spark.createDataFrame(list(rows), f"run string, scale double, {', '.join(f'off{i} double' for i in range(d))}")


def apply(points: DataFrame, runs: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, periodic: bool = True) -> DataFrame:
    """Points of each run with axes stretched to the full range: those in the run's sub-box, wrapped or clipped.

    The plan is a parameter of a few rows, so each point is copied once a run.
    """
    size = float(1 << bits)
    j = points.crossJoin(F.broadcast(runs))
    for i, a in enumerate(axes):
        moved = F.col(a) - F.col(f"off{i}") * size
        if periodic:
            moved = F.pmod(moved, F.lit(size))
        j = j.withColumn(f"_m{i}", moved)
    inside = None
    for i in range(len(axes)):
        c = (F.col(f"_m{i}") >= 0) & (F.col(f"_m{i}") < F.col("scale") * size)
        inside = c if inside is None else inside & c
    out = j.where(inside)
    for i, a in enumerate(axes):
        out = out.withColumn(a, F.least(F.floor(F.col(f"_m{i}") / F.col("scale")), F.lit((1 << bits) - 1)).cast("long"))
    return out.drop(*[f"_m{i}" for i in range(len(axes))], *[f"off{i}" for i in range(len(axes))])


def coverage(randoms: DataFrame, runs: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, periodic: bool = True, weight: str = "w") -> DataFrame:
    """(run, coverage): share of the random weight that a run keeps."""
    kept = apply(randoms, runs, axes, bits, periodic).groupBy("run").agg(F.sum(weight).alias("kept"))
    return runs.select("run").join(kept, "run", "left").crossJoin(F.broadcast(randoms.agg(F.sum(weight).alias("whole")))).select("run", F.coalesce(ratio(F.col("kept"), F.col("whole")), F.lit(0.0)).alias("coverage"))


def diagnostics(randoms: DataFrame, runs: DataFrame, n_levels: int, axes: Sequence[str] = AXES, bits: int = 16, periodic: bool = True) -> DataFrame:
    """(run, scale, offset, coverage, n_levels): one row a run, the offset as text, for a CSV sink."""
    offset = F.concat_ws(";", *[F.format_string("%.6f", f"off{i}") for i in range(len(axes))])
    return runs.select("run", "scale", offset.alias("offset")).join(coverage(randoms, runs, axes, bits, periodic), "run").withColumn("n_levels", F.lit(n_levels))


def run_cells(data: DataFrame, randoms: DataFrame, runs: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 5), periodic: bool = True) -> DataFrame:
    """(run, scale, level, k.., n_d, sw_d, sw2_d, n_r, sw_r, sw2_r): the cells of every run."""
    keys = _keys(axes)
    finest = max(levels)
    rows = [apply(df, runs, axes, bits, periodic).select("run", "scale", *[F.shiftright(a, bits - finest).alias(k) for a, k in zip(axes, keys, strict=True)], F.col("w").cast("double").alias("w"), F.lit(c).alias("c")) for df, c in ((data, "d"), (randoms, "r"))]
    sums = []
    for c in "dr":
        of = F.col("c") == c
        sums += [F.count(F.when(of, 1)).alias(f"n_{c}"), F.coalesce(F.sum(F.when(of, F.col("w"))), F.lit(0.0)).alias(f"sw_{c}"), F.coalesce(F.sum(F.when(of, F.col("w") * F.col("w"))), F.lit(0.0)).alias(f"sw2_{c}")]
    names = [f"{x}_{c}" for c in "dr" for x in ("n", "sw", "sw2")]
    fine = rows[0].unionByName(rows[1]).groupBy("run", "scale", *keys).agg(*sums)
    spread = fine.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return spread.select("run", "scale", "level", *[F.expr(f"shiftright({k}, {finest} - level)").alias(k) for k in keys], *names).groupBy("run", "scale", "level", *keys).agg(*[F.sum(n).alias(n) for n in names])


def _side() -> Column:
    return (F.col("scale") / F.pow(F.lit(2.0), F.col("level"))).alias("side")


def _contrast(cells: DataFrame, footprint: float) -> DataFrame:
    totals = cells.groupBy("run", "level").agg(ratio(F.sum("sw_d"), F.sum("sw_r")).alias("alpha"))
    return cells.join(totals, ["run", "level"]).where(F.col("sw_r") > footprint).withColumn("delta", ratio(F.col("sw_d"), F.col("alpha") * F.col("sw_r")) - 1).where("delta is not null")  # none in a run without data


def run_raw_sums(data: DataFrame, randoms: DataFrame, runs: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 5), periodic: bool = True, footprint: float = 0.0) -> DataFrame:
    """(run, level, side, t, s1..s4): raw sums of delta of every run; side is the cell's in parts of the box."""
    c = _contrast(run_cells(data, randoms, runs, axes, bits, levels, periodic), footprint)
    w, d = F.col("sw_r"), F.col("delta")
    return c.groupBy("run", "level", _side()).agg(F.sum(w).alias("t"), *[F.sum(w * F.pow(d, k)).alias(f"s{k}") for k in (1, 2, 3, 4)])


def run_haar_sums(data: DataFrame, randoms: DataFrame, runs: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 4), periodic: bool = True, footprint: float = 0.0) -> DataFrame:
    """(run, level, side, pattern, t, q): parents' random weight and its sum times w_e^2, parents and all children in the footprint."""
    keys, d = _keys(axes), len(axes)
    c = _contrast(run_cells(data, randoms, runs, axes, bits, sorted({*levels, *(x + 1 for x in levels)}), periodic), footprint)
    corner = sum(F.col(k).bitwiseAND(F.lit(1)).cast("int") * (1 << i) for i, k in enumerate(keys))
    children = c.where(F.col("level").isin([x + 1 for x in levels])).select("run", (F.col("level") - 1).alias("level"), *[F.shiftright(k, 1).alias(k) for k in keys], corner.alias("corner"), "delta")
    signed = [F.sum(F.when(F.bit_count(F.col("corner").bitwiseAND(F.lit(e))) % 2 == 0, F.col("delta")).otherwise(-F.col("delta"))).alias(f"e{e}") for e in range(1, 1 << d)]
    whole = children.groupBy("run", "level", *keys).agg(F.count("*").alias("n"), *signed).where(F.col("n") == (1 << d))
    j = whole.join(c.select("run", "scale", "level", *keys, "sw_r"), ["run", "level", *keys])
    rows = F.inline(F.array(*[F.struct(F.lit(e).alias("pattern"), (F.col(f"e{e}") / (1 << d)).alias("we")) for e in range(1, 1 << d)]))
    return j.select("run", "level", "scale", "sw_r", rows).groupBy("run", "level", _side(), "pattern").agg(F.sum("sw_r").alias("t"), F.sum(F.col("sw_r") * F.col("we") * F.col("we")).alias("q"))


def run_counts(data: DataFrame, randoms: DataFrame, runs: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 4), periodic: bool = True) -> DataFrame:
    """(run, level, side, n, cells): counts in the visited cells of every run."""
    c = run_cells(data, randoms, runs, axes, bits, levels, periodic)
    return c.groupBy("run", "level", _side(), F.col("n_d").alias("n")).agg(F.count("*").alias("cells"))


def pools(rows: DataFrame, tolerance: float) -> DataFrame:
    """(run, level, pool): runs' levels whose side is within a relative ``tolerance`` of the one before, in order of side. One row a run and level."""
    order = Window.orderBy("side", "run", "level")
    before = F.lag("side").over(order)
    marked = rows.select("run", "level", "side").distinct().withColumn("gap", F.when(before.isNull() | (F.col("side") > before * (1 + tolerance)), 1).otherwise(0))
    return marked.select("run", "level", (F.sum("gap").over(order) - 1).alias("pool"))


def pooled_haar(rows: DataFrame, tolerance: float) -> DataFrame:
    """(pool, pattern, side, mean_we2): mean square coefficients over all runs of a pool."""
    return rows.join(pools(rows, tolerance), ["run", "level"]).groupBy("pool", "pattern").agg((F.sum(F.col("side") * F.col("t")) / F.sum("t")).alias("side"), ratio(F.sum("q"), F.sum("t")).alias("mean_we2"))


def pooled_counts(rows: DataFrame, tolerance: float) -> DataFrame:
    """(pool, n, cells, p): counts summed over runs, and the mean of the runs' own shares, all runs alike."""
    at = rows.join(pools(rows, tolerance), ["run", "level"])
    sizes = at.groupBy("pool", "run", "level").agg(F.sum("cells").alias("all"))
    runs = sizes.groupBy("pool").agg(F.count("*").alias("runs"))
    return at.join(sizes, ["pool", "run", "level"]).join(runs, "pool").groupBy("pool", "n").agg(F.sum("cells").alias("cells"), F.sum(F.col("cells") / F.col("all") / F.col("runs")).alias("p"))


def pooled_xi(data: DataFrame, randoms: DataFrame, runs: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(5), periodic: bool = True) -> DataFrame:
    """(scale, level, dd, dr, rr, xi): shells of all shifts of one scale added, counts and norms alike; xi is null where RR is 0."""
    c = run_cells(data, randoms, runs, axes, bits, levels, periodic)
    half = lambda k: F.sum((F.col(f"sw_{k}") * F.col(f"sw_{k}") - F.col(f"sw2_{k}")) / 2)
    s = c.groupBy("run", "scale", "level").agg(half("d").alias("dd"), half("r").alias("rr"), F.sum(F.col("sw_d") * F.col("sw_r")).alias("dr"))
    order = Window.partitionBy("run").orderBy("level")  # one row a level
    shells = s.select("run", "scale", "level", *[(F.col(x) - F.lead(x, 1, 0.0).over(order)).alias(x) for x in ("dd", "dr", "rr")])
    t = c.where(F.col("level") == min(levels)).groupBy("run").agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in "dr" for x in ("sw", "sw2")])
    j = shells.join(t, "run").groupBy("scale", "level").agg(
        *[F.sum(x).alias(x) for x in ("dd", "dr", "rr")], F.sum((F.col("sw_d") * F.col("sw_d") - F.col("sw2_d")) / 2).alias("nd"), F.sum((F.col("sw_r") * F.col("sw_r") - F.col("sw2_r")) / 2).alias("nr"), F.sum(F.col("sw_d") * F.col("sw_r")).alias("nx")
    )
    fdd, fdr, frr = ratio(F.col("dd"), F.col("nd")), ratio(F.col("dr"), F.col("nx")), ratio(F.col("rr"), F.col("nr"))
    return j.select("scale", "level", "dd", "dr", "rr", ratio(fdd - 2 * fdr + frr, frr).alias("xi"))


def pooled(rows: DataFrame, tolerance: float) -> DataFrame:
    """Rows whose side is within a relative ``tolerance`` of the row before them, in order of side, share a pool.

    Raw sums are added and moments derived anew. side is the mean weighted by t;
    across_runs is the sample variance of the runs' own variances, all runs alike (0 for one run).
    One row for each run and level comes in, so the ordered step is small.
    """
    binned = rows.join(pools(rows, tolerance), ["run", "level"])
    own = (F.col("s2") / F.col("t")) - F.pow(F.col("s1") / F.col("t"), 2)
    sums = binned.groupBy("pool").agg(
        F.count("*").alias("n_rows"), (F.sum(F.col("side") * F.col("t")) / F.sum("t")).alias("side"), F.coalesce(F.var_samp(own), F.lit(0.0)).alias("across_runs"), F.sum("t").alias("t"), *[F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2, 3, 4)]
    )
    return moments(sums)


def fit_xi_continuous(shells: DataFrame, knots: Sequence[float], ridge: float = 1e-12) -> tuple[list[float], float]:
    """Coefficients and chi^2 of a tent basis in ln r through (r, xi, var) rows, by weighted least squares on the driver.

    The input is one row a shell. Rows without a finite xi or a positive variance are left out.
    """
    rows = [r for r in shells.select("r", "xi", "var").collect() if r["xi"] is not None and r["var"] and r["var"] > 0]
    x = np.log([r["r"] for r in rows])
    k = np.log(np.asarray(knots, float))
    basis = np.stack([np.interp(x, k, np.eye(len(k))[i]) for i in range(len(k))], axis=1)
    y, w = np.array([r["xi"] for r in rows]), 1 / np.array([r["var"] for r in rows])
    normal = basis.T @ (basis * w[:, None])
    normal += np.eye(len(k)) * ridge * np.trace(normal) / len(k)
    c = np.linalg.solve(normal, basis.T @ (w * y))
    return [float(v) for v in c], float((w * (y - basis @ c) ** 2).sum())
