"""Dyadic cells: counts, pair shells, density moments, count distributions, Haar anisotropy.

A catalog has whole-number axes in [0, 2^bits). Level l has cells of side 2^(bits - l).
Points are first summed to the finest level that is asked for; coarser levels are summed
from those cells, not from the points, so two shuffles of partial sums serve all levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("c0", "c1", "c2")


def _keys(axes: Sequence[str]) -> list[str]:
    return [f"k{i}" for i in range(len(axes))]


def ratio(top: Column, below: Column) -> Column:
    """Division that is null where the divisor is null or 0."""
    return F.when(below != 0, top / below)


def cells(data: DataFrame, randoms: DataFrame | None = None, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9), weight: str | None = "w") -> DataFrame:
    """(level, k.., n_d, sw_d, sw2_d, n_r, sw_r, sw2_r) for each occupied cell of each level.

    Without a weight column every point weighs 1. Without randoms the random sums are 0.
    """
    finest = max(levels)
    catalogs = [(data, "d")] + ([(randoms, "r")] if randoms is not None else [])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    keys = _keys(axes)
    rows = [df.select(*[F.shiftright(F.col(a).cast("long"), bits - finest).alias(k) for a, k in zip(axes, keys, strict=True)], w.alias("w"), F.lit(c).alias("c")) for df, c in catalogs]
    whole = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    sums = []
    for c in "dr":
        of = F.col("c") == c
        sums += [F.count(F.when(of, 1)).alias(f"n_{c}"), F.coalesce(F.sum(F.when(of, F.col("w"))), F.lit(0.0)).alias(f"sw_{c}"), F.coalesce(F.sum(F.when(of, F.col("w") * F.col("w"))), F.lit(0.0)).alias(f"sw2_{c}")]
    fine = whole.groupBy(*keys).agg(*sums)
    spread = fine.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    at = [F.expr(f"shiftright({k}, {finest} - level)").alias(k) for k in keys]
    names = [f"{x}_{c}" for c in "dr" for x in ("n", "sw", "sw2")]
    return spread.select("level", *at, *names).groupBy("level", *keys).agg(*[F.sum(x).alias(x) for x in names])


def level_counts(data: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9)) -> DataFrame:
    """Per level: occupied cells, mean and variance of counts over them and over all cells, largest count."""
    d = len(axes)
    c = cells(data, None, axes, bits, levels, None)
    all_cells = F.pow(F.lit(2.0), F.col("level") * d)
    s = c.groupBy("level").agg(F.count("*").alias("n_nonempty"), F.sum("n_d").alias("s1"), F.sum(F.col("n_d") * F.col("n_d")).alias("s2"), F.max("n_d").alias("n_max"))
    mean, mean_all = F.col("s1") / F.col("n_nonempty"), F.col("s1") / all_cells
    return s.select(
        "level", "n_nonempty", "n_max", mean.alias("mean_nonempty"), (F.col("s2") / F.col("n_nonempty") - mean * mean).alias("var_nonempty"), mean_all.alias("mean_all"), (F.col("s2") / all_cells - mean_all * mean_all).alias("var_all")
    )


def count_histogram(data: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9)) -> DataFrame:
    """(level, n, cells): how many occupied cells hold n points."""
    return cells(data, None, axes, bits, levels, None).groupBy("level", F.col("n_d").alias("n")).agg(F.count("*").alias("cells"))


def pair_shells(data: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9)) -> DataFrame:
    """(level, n_nonempty, cumulative_pairs, n_pairs): pairs that share a cell, and those that no finer cell holds."""
    c = cells(data, None, axes, bits, levels, None)
    s = c.groupBy("level").agg(F.count("*").alias("n_nonempty"), F.sum((F.col("n_d") * (F.col("n_d") - 1) / 2).cast("long")).alias("cumulative_pairs"))
    finer = F.lead("cumulative_pairs", 1, 0).over(Window.orderBy("level"))  # one row a level
    return s.select("level", "n_nonempty", "cumulative_pairs", (F.col("cumulative_pairs") - finer).alias("n_pairs"))


def pair_level_stats(cell_rows: DataFrame) -> DataFrame:
    """Per level the cumulative weighted pairs DD, RR (unordered, no self pairs) and DR, and occupied cells."""
    half = lambda c: F.sum((F.col(f"sw_{c}") * F.col(f"sw_{c}") - F.col(f"sw2_{c}")) / 2)
    return cell_rows.groupBy("level").agg(
        F.count(F.when(F.col("n_d") > 0, 1)).alias("nonempty_d"), F.count(F.when(F.col("n_r") > 0, 1)).alias("nonempty_r"), half("d").alias("dd"), half("r").alias("rr"), F.sum(F.col("sw_d") * F.col("sw_r")).alias("dr")
    )


def xi_shells(data: DataFrame, randoms: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9), weight: str | None = "w") -> DataFrame:
    """Per level the pairs of the shell between it and the next finer level, and the Landy-Szalay estimate.

    Pair norms are (W^2 - sum w^2) / 2 for DD and RR and W_d W_r for DR; xi is null where RR is 0.
    """
    return xi_of_cells(cells(data, randoms, axes, bits, levels, weight), levels)


def xi_of_cells(c: DataFrame, levels: Sequence[int]) -> DataFrame:
    """xi_shells() of rows of cells()."""
    stats = pair_level_stats(c)
    order = Window.orderBy("level")
    shells = stats.select("level", *[(F.col(x) - F.lead(x, 1, 0.0).over(order)).alias(x) for x in ("dd", "dr", "rr")])
    coarsest = min(levels)
    totals = c.where(F.col("level") == coarsest).agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in "dr" for x in ("sw", "sw2")])
    joined = shells.crossJoin(F.broadcast(totals))  # one row
    fdd = ratio(F.col("dd"), (F.col("sw_d") * F.col("sw_d") - F.col("sw2_d")) / 2)
    frr = ratio(F.col("rr"), (F.col("sw_r") * F.col("sw_r") - F.col("sw2_r")) / 2)
    fdr = ratio(F.col("dr"), F.col("sw_d") * F.col("sw_r"))
    return joined.select("level", "dd", "dr", "rr", ratio(fdd - 2 * fdr + frr, frr).alias("xi"))


def with_delta(cell_rows: DataFrame, footprint: float = 0.0) -> DataFrame:
    """Cells with alpha = W_d / W_r of all points and delta = w_d / (alpha w_r) - 1, null outside the footprint (w_r <= ``footprint``)."""
    totals = cell_rows.groupBy("level").agg(F.sum("sw_d").alias("all_d"), F.sum("sw_r").alias("all_r")).withColumn("alpha", ratio(F.col("all_d"), F.col("all_r")))
    joined = cell_rows.join(F.broadcast(totals), "level")  # one row a level
    return joined.withColumn("delta", F.when(F.col("sw_r") > F.lit(footprint), ratio(F.col("sw_d"), F.col("alpha") * F.col("sw_r")) - 1))


def raw_sums(cells_delta: DataFrame) -> DataFrame:
    """Per level T = sum w_r and S_k = sum w_r delta^k over the footprint, extremes, and what lies outside."""
    d, w, inside = F.col("delta"), F.col("sw_r"), F.col("delta").isNotNull()
    return cells_delta.groupBy("level").agg(
        F.coalesce(F.sum(F.when(inside, w)), F.lit(0.0)).alias("t"),
        *[F.coalesce(F.sum(F.when(inside, w * F.pow(d, k))), F.lit(0.0)).alias(f"s{k}") for k in (1, 2, 3, 4)],
        F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), F.count(F.when(inside, 1)).alias("n_cells"),
        F.count(F.when(~inside & (F.col("n_d") > 0), 1)).alias("cells_outside"), F.coalesce(F.sum(F.when(~inside, F.col("sw_d"))), F.lit(0.0)).alias("weight_outside"),
    )


def moments(sums: DataFrame) -> DataFrame:
    """Central moments from raw sums: mean_delta, var_delta, m3_delta, m4_delta and s3_delta = m3 / var^2 (0 if var is 0); null if t is 0."""
    m1, m2, m3, m4 = (ratio(F.col(f"s{k}"), F.col("t")) for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    third = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return sums.select("*", m1.alias("mean_delta"), var.alias("var_delta"), third.alias("m3_delta"), fourth.alias("m4_delta")).withColumn("s3_delta", F.when(F.col("var_delta") == 0, 0.0).otherwise(F.col("m3_delta") / (F.col("var_delta") * F.col("var_delta"))))


def field_stats(data: DataFrame, randoms: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9), weight: str | None = "w", footprint: float = 0.0) -> DataFrame:
    """Moments of the density contrast per level, weighted by the random weight of the cells in the footprint."""
    return moments(raw_sums(with_delta(cells(data, randoms, axes, bits, levels, weight), footprint)))


def field_pdf(data: DataFrame, randoms: DataFrame, low: float, high: float, bins: int, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9), weight: str | None = "w", footprint: float = 0.0) -> DataFrame:
    """(level, bin, cells, weight): cells by log10(1 + delta); -1 is underflow (with empty cells), ``bins`` overflow."""
    c = with_delta(cells(data, randoms, axes, bits, levels, weight), footprint).where("delta is not null")
    x = F.floor((F.log10(1 + F.col("delta")) - low) / (high - low) * bins)
    at = F.when(F.col("delta") <= -1, -1).otherwise(F.least(F.greatest(x, F.lit(-1)), F.lit(bins))).cast("int")
    return c.groupBy("level", at.alias("bin")).agg(F.count("*").alias("cells"), F.sum("sw_r").alias("weight"))


def cic_pmf(data: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(5), randoms: DataFrame | None = None) -> DataFrame:
    """(level, n, cells, p): distribution of counts in cells.

    Without randoms the box is full: cells without a point count as n = 0. With randoms
    only cells that hold a random or a data point are counted.
    """
    c = cells(data, randoms, axes, bits, levels, None)
    seen = c.groupBy("level", F.col("n_d").alias("n")).agg(F.count("*").alias("cells"))
    if randoms is None:
        occupied = seen.groupBy("level").agg(F.sum("cells").alias("o"))
        zero = occupied.select("level", F.lit(0).cast("long").alias("n"), (F.pow(F.lit(2.0), F.col("level") * len(axes)).cast("long") - F.col("o")).alias("cells")).where("cells > 0")
        seen = seen.unionByName(zero)
    return seen.select("*", (F.col("cells") / F.sum("cells").over(Window.partitionBy("level"))).alias("p"))  # as many rows as distinct counts


def haar(data: DataFrame, randoms: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 6), weight: str | None = "w", footprint: float = 0.0) -> DataFrame:
    """(level, k.., pattern, we, w_p): Haar coefficients of delta over the 2^D children of each parent cell.

    ``level`` is the parent's. A parent counts if it and all its children are in the
    footprint. pattern e > 0 marks the axes along which the sign alternates.
    """
    d = len(axes)
    keys = _keys(axes)
    wanted = sorted({*levels, *(x + 1 for x in levels)})
    c = with_delta(cells(data, randoms, axes, bits, wanted, weight), footprint).where("delta is not null")
    corner = sum(F.col(k).bitwiseAND(F.lit(1)).cast("int") * (1 << i) for i, k in enumerate(keys))
    children = c.where(F.col("level").isin([x + 1 for x in levels])).select((F.col("level") - 1).alias("level"), *[F.shiftright(k, 1).alias(k) for k in keys], corner.alias("corner"), "delta")
    signed = [F.sum(F.when(F.bit_count(F.col("corner").bitwiseAND(F.lit(e))) % 2 == 0, F.col("delta")).otherwise(-F.col("delta"))).alias(f"e{e}") for e in range(1, 1 << d)]
    whole = children.groupBy("level", *keys).agg(F.count("*").alias("n"), *signed).where(F.col("n") == (1 << d))
    parents = c.where(F.col("level").isin(list(levels))).select("level", *keys, F.col("sw_r").alias("w_p"))
    rows = F.inline(F.array(*[F.struct(F.lit(e).alias("pattern"), (F.col(f"e{e}") / (1 << d)).alias("we")) for e in range(1, 1 << d)]))
    return whole.join(parents, ["level", *keys]).select("level", *keys, "w_p", rows)


def haar_anisotropy(data: DataFrame, randoms: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 6), weight: str | None = "w", footprint: float = 0.0) -> DataFrame:
    """(level, pattern, n_cells, w_total, mean_we2): mean square Haar coefficient, weighted by the parents' randoms."""
    h = haar(data, randoms, axes, bits, levels, weight, footprint)
    return h.groupBy("level", "pattern").agg(F.count("*").alias("n_cells"), F.sum("w_p").alias("w_total"), (F.sum(F.col("w_p") * F.col("we") * F.col("we")) / F.sum("w_p")).alias("mean_we2"))


def quadrupole(anisotropy: DataFrame, d: int = 3) -> DataFrame:
    """(level, q2): mean square coefficient along the last axis less the mean of those across."""
    los = F.sum(F.when(F.col("pattern") == 1 << (d - 1), F.col("mean_we2")).otherwise(0.0))
    across = F.sum(F.when(F.col("pattern").isin([1 << i for i in range(d - 1)]), F.col("mean_we2")).otherwise(0.0))
    return anisotropy.groupBy("level").agg((los - across / (d - 1)).alias("q2"))


def scattering(data: DataFrame, randoms: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, fine: int = 4, coarse: int = 2, weight: str | None = "w", footprint: float = 0.0) -> DataFrame:
    """(axis1, axis2, n_cells, mean_w2): second-order coefficients of axis pairs.

    The absolute first-order coefficients of axis1 at parent level ``fine`` are averaged
    down to the children of level ``coarse`` cells (cells without one count as 0, the
    divisor is the full number), and the Haar transform along axis2 is taken there.
    """
    d = len(axes)
    keys = _keys(axes)
    first = haar(data, randoms, axes, bits, [fine], weight, footprint).where(F.col("pattern").isin([1 << i for i in range(d)]))
    depth = fine - (coarse + 1)
    mean = first.groupBy("pattern", *[F.shiftright(k, depth).alias(k) for k in keys]).agg((F.sum(F.abs(F.col("we"))) / (1 << (depth * d))).alias("m"))
    corner = sum(F.col(k).bitwiseAND(F.lit(1)).cast("int") * (1 << i) for i, k in enumerate(keys))
    signs = [F.sum(F.when(F.bit_count(corner.bitwiseAND(F.lit(1 << i))) % 2 == 0, F.col("m")).otherwise(-F.col("m"))).alias(f"a{i}") for i in range(d)]
    second = mean.groupBy("pattern", *[F.shiftright(k, 1).alias(k) for k in keys]).agg(*signs)
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("axis2"), (F.col(f"a{i}") / (1 << d)).alias("w2")) for i in range(d)]))
    axis1 = F.bit_count(F.col("pattern") - 1)
    return second.select(axis1.alias("axis1"), rows).groupBy("axis1", "axis2").agg(F.count("*").alias("n_cells"), F.avg(F.abs(F.col("w2"))).alias("mean_w2"))


def membership(points: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9)) -> DataFrame:
    """(id, level, k..): the cell of each point at each level."""
    spread = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return spread.select("id", "level", *[F.expr(f"shiftright(cast({a} as long), {bits} - level)").alias(k) for a, k in zip(axes, _keys(axes), strict=True)])


def pair_gradient(points: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, level: int = 4) -> DataFrame:
    """(id, others): for each point the other points in its cell of one level."""
    keys = _keys(axes)
    placed = membership(points, axes, bits, [level]).drop("level")
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    return placed.join(counts, keys).select("id", (F.col("n") - 1).alias("others"))


def grid_counts(points: DataFrame, n_side: int, axes: Sequence[str] = AXES, bits: int = 16) -> DataFrame:
    """(n_cells, mean, variance, s3) of counts on a regular grid of n_side^D cells, empty ones included."""
    at = [F.floor(F.col(a) * F.lit(n_side) / F.lit(1 << bits)).alias(k) for a, k in zip(axes, _keys(axes), strict=True)]
    c = points.select(*at).groupBy(*_keys(axes)).agg(F.count("*").alias("n"))
    total = n_side ** len(axes)
    s = c.agg(*[F.sum(F.pow(F.col("n").cast("double"), k)).alias(f"p{k}") for k in (1, 2, 3)])
    m1, m2, m3 = (F.col(f"p{k}") / total for k in (1, 2, 3))
    var, third = m2 - m1 * m1, m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    v = (var - m1) / (m1 * m1)
    return s.select(F.lit(total).alias("n_cells"), m1.alias("mean"), v.alias("variance"), F.when(v > 0, (third - 3 * var + 2 * m1) / (m1 * m1 * m1) / (v * v)).otherwise(0.0).alias("s3"))


def box_field_stats(data: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(9), weight: str | None = "w") -> DataFrame:
    """field_stats() of a periodic box without randoms: every cell weighs its volume, the box being 1, and cells without a point count with delta = -1."""
    c = cells(data, None, axes, bits, levels, weight)
    volume = F.pow(F.lit(2.0), -F.col("level") * len(axes))
    total = F.broadcast(c.groupBy("level").agg(F.sum("sw_d").alias("all_d")))  # one row a level
    d = c.join(total, "level").select("level", volume.alias("v"), (F.col("sw_d") / (F.col("all_d") * volume) - 1).alias("delta"))
    s = d.groupBy("level").agg(F.sum("v").alias("seen"), *[F.sum(F.col("v") * F.pow("delta", k)).alias(f"p{k}") for k in (1, 2, 3, 4)], F.count("*").alias("n_occupied"), F.max("delta").alias("max_delta"))
    return moments(s.select("level", F.lit(1.0).alias("t"), *[(F.col(f"p{k}") + (-1) ** k * (1 - F.col("seen"))).alias(f"s{k}") for k in (1, 2, 3, 4)], "n_occupied", "max_delta"))
