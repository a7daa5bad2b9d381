"""Closed-form derivatives of cell statistics with respect to point weights.

Every statistic is a function of cell sums, so a point's derivative depends on its own
cell alone: the gradient of a cell is worked out once and joined back to the points in it,
one row for each point and level. Points outside the footprint keep the global term.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.cells import AXES, _keys, cells, haar, membership, moments, pair_level_stats, ratio, raw_sums, with_delta


def _joined(points: DataFrame, cell_rows: DataFrame, axes: Sequence[str], bits: int, levels: Sequence[int]) -> DataFrame:
    keys = ["level", *_keys(axes)]
    return membership(points, axes, bits, levels).join(cell_rows, keys)


def _stats(data: DataFrame, randoms: DataFrame, axes, bits, levels, weight, footprint) -> tuple[DataFrame, DataFrame]:
    """Cells with delta and alpha, joined with the level's moments."""
    c = with_delta(cells(data, randoms, axes, bits, levels, weight), footprint)
    m = moments(raw_sums(c)).select("level", "t", F.col("mean_delta").alias("m1"), F.col("var_delta").alias("mu2"), F.col("m3_delta").alias("mu3"), F.col("m4_delta").alias("mu4"), "s1", "s2", "s3", "s4")
    return c.join(F.broadcast(m), "level"), m  # one row a level


def _power(x: Column, k: int) -> Column:
    return F.lit(1.0) if k == 0 else x if k == 1 else F.pow(x, k)


def _mu(k: int) -> Column:
    return F.lit(1.0) if k == 0 else F.lit(0.0) if k == 1 else F.col(f"mu{k}")


def _moment_terms(k: int, of: str) -> Column:
    """d mu_k / d w of a point in a cell, for data ('d') or random ('r') weights."""
    d, inside = F.col("delta") - F.col("m1"), F.col("delta").isNotNull()
    if of == "d":
        local = F.when(inside, k * (_power(d, k - 1) - _mu(k - 1))).otherwise(0.0)
        return local / (F.col("alpha") * F.col("t")) - k * _mu(k) / (F.col("alpha") * F.col("all_r"))
    up = 1 + F.col("m1")
    local = F.when(inside, (k - 1) * _power(d, k) + k * up * _power(d, k - 1) - k * up * _mu(k - 1) + _mu(k)).otherwise(0.0)
    return k * _mu(k) / F.col("all_r") - local / F.col("t")


def field_gradient(data: DataFrame, randoms: DataFrame, statistic: str = "var", of: str = "d", axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 5), weight: str | None = "w", footprint: float = 0.0) -> DataFrame:
    """(id, level, value): derivative of 'var', 'm3', 'm4' or 's3' of delta with respect to each data ('d') or random ('r') weight."""
    c, _ = _stats(data, randoms, axes, bits, levels, weight, footprint)
    if statistic == "s3":
        mu2, mu3 = F.col("mu2"), F.col("mu3")
        value = F.when(mu2 != 0, _moment_terms(3, of) / (mu2 * mu2) - 2 * mu3 * _moment_terms(2, of) / (mu2 * mu2 * mu2)).otherwise(0.0)
    else:
        value = _moment_terms({"var": 2, "m3": 3, "m4": 4}[statistic], of)
    return _joined(data if of == "d" else randoms, c.withColumn("value", value), axes, bits, levels).select("id", "level", "value")


def raw_sum_gradient(data: DataFrame, randoms: DataFrame, of: str = "d", axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 5), weight: str | None = "w", footprint: float = 0.0) -> DataFrame:
    """(id, level, dt, ds1..ds4): derivatives of T and of the raw sums S_k."""
    c, _ = _stats(data, randoms, axes, bits, levels, weight, footprint)
    d, inside = F.col("delta"), F.col("delta").isNotNull()
    s = lambda k: F.col("t") if k == 0 else F.col(f"s{k}")
    out = []
    for k in (1, 2, 3, 4):
        if of == "d":
            local, common = k * _power(d, k - 1) / F.col("alpha"), -k * (s(k) + s(k - 1)) / (F.col("alpha") * F.col("all_r"))
        else:
            local, common = -(k - 1) * _power(d, k) - k * _power(d, k - 1), k * (s(k) + s(k - 1)) / F.col("all_r")
        out.append((F.when(inside, local).otherwise(0.0) + common).alias(f"ds{k}"))
    dt = F.lit(0.0) if of == "d" else F.when(inside, 1.0).otherwise(0.0)
    names = ["dt", *[f"ds{k}" for k in (1, 2, 3, 4)]]
    return _joined(data if of == "d" else randoms, c.select("level", *_keys(axes), dt.alias("dt"), *out), axes, bits, levels).select("id", "level", *names)


def haar_gradient(data: DataFrame, randoms: DataFrame, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 4), weight: str | None = "w", footprint: float = 0.0, of: str = "d") -> DataFrame:
    """(id, level, pattern, value): derivative of the mean square Haar coefficient with respect to each data ('d') or random ('r') weight."""
    keys, d = _keys(axes), len(axes)
    h = haar(data, randoms, axes, bits, levels, weight, footprint)
    totals = h.groupBy("level", "pattern").agg(F.sum("w_p").alias("t"), (F.sum(F.col("w_p") * F.col("we") * F.col("we")) / F.sum("w_p")).alias("q"))
    c = with_delta(cells(data, randoms, axes, bits, [x + 1 for x in levels], weight), footprint)
    corner = sum(F.col(k).bitwiseAND(F.lit(1)).cast("int") * (1 << i) for i, k in enumerate(keys))
    child = c.select((F.col("level") - 1).alias("level"), *[F.shiftright(k, 1).alias(k) for k in keys], corner.alias("corner"), "sw_r", "delta", "alpha", "all_r")
    own = data if of == "d" else randoms
    fine = membership(own, axes, bits, [x + 1 for x in levels]).select("id", (F.col("level") - 1).alias("level"), *[F.shiftright(k, 1).alias(k) for k in keys], corner.alias("corner"))
    globals_ = c.select("alpha", "all_r").limit(1)
    at = fine.join(child.drop("alpha", "all_r"), ["level", *keys, "corner"]).join(h, ["level", *keys], "inner")
    sign = F.when(F.bit_count(F.col("corner").bitwiseAND(F.col("pattern"))) % 2 == 0, 1.0).otherwise(-1.0)
    moved = 2 * F.col("we") * F.col("w_p") * sign / ((1 << d) * F.col("sw_r"))
    local = at.select("id", "level", "pattern", (moved if of == "d" else F.col("we") * F.col("we") - moved * (1 + F.col("delta"))).alias("g"))
    every = membership(own, axes, bits, levels).select("id", "level").join(F.broadcast(totals), "level")
    j = every.join(local, ["id", "level", "pattern"], "left").crossJoin(F.broadcast(globals_))  # one row
    q = F.col("q")
    if of == "d":
        value = F.coalesce("g", F.lit(0.0)) / (F.col("alpha") * F.col("t")) - 2 * q / (F.col("alpha") * F.col("all_r"))
    else:  # a random also weighs its parent cell
        value = F.coalesce(F.col("g") - q, F.lit(0.0)) / F.col("t") + 2 * q / F.col("all_r")
    return j.select("id", "level", "pattern", value.alias("value"))


def xi_gradient(data: DataFrame, randoms: DataFrame, of: str = "d", axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(5), weight: str | None = "w") -> DataFrame:
    """(id, level, value): derivative of the shell estimate of xi_shells with respect to each weight; 0 where RR is 0."""
    keys = _keys(axes)
    c = cells(data, randoms, axes, bits, levels, weight)
    order = Window.orderBy("level")
    s = pair_level_stats(c).select("level", *[(F.col(x) - F.lead(x, 1, 0.0).over(order)).alias(x) for x in ("dd", "dr", "rr")])  # one row a level
    totals = c.where(F.col("level") == min(levels)).agg(*[F.sum(f"{x}_{k}").alias(f"all_{x}_{k}") for k in "dr" for x in ("sw", "sw2")])
    stats = s.crossJoin(totals)
    own, other = (data, "r") if of == "d" else (randoms, "d")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mine = membership(own.select("id", *axes), axes, bits, levels).join(own.select("id", w.alias("own")), "id").join(c.select("level", *keys, "sw_d", "sw_r"), ["level", *keys])
    by = Window.partitionBy("id").orderBy("level")
    same = F.col(f"sw_{of}") - F.col("own")
    shell = mine.select("id", "level", "own", (same - F.coalesce(F.lead(same).over(by), F.lit(0.0))).alias("g_same"), (F.col(f"sw_{other}") - F.lead(f"sw_{other}", 1, 0.0).over(by)).alias("g_cross"))
    j = shell.join(F.broadcast(stats), "level")
    wd, wr = F.col("all_sw_d"), F.col("all_sw_r")
    nd, nr, nx = (wd * wd - F.col("all_sw2_d")) / 2, (wr * wr - F.col("all_sw2_r")) / 2, wd * wr
    fdd, frr, fdr = F.col("dd") / nd, F.col("rr") / nr, F.col("dr") / nx
    if of == "d":
        dfdd = F.col("g_same") / nd - fdd * (wd - F.col("own")) / nd
        dfdr = F.col("g_cross") / nx - fdr / wd
        value = ratio(dfdd - 2 * dfdr, frr)
    else:
        dfrr = F.col("g_same") / nr - frr * (wr - F.col("own")) / nr
        dfdr = F.col("g_cross") / nx - fdr / wr
        value = ratio((2 * fdr - fdd) * dfrr - 2 * frr * dfdr, frr * frr)
    return j.select("id", "level", F.coalesce(value, F.lit(0.0)).alias("value"))


def aggregate(gradient: DataFrame, betas: dict[int, float]) -> DataFrame:
    """(id, value): the gradient of the sum of beta_l times the statistic of level l."""
    beta = F.coalesce(*[F.when(F.col("level") == k, F.lit(float(b))) for k, b in betas.items()])
    return gradient.where(F.col("level").isin(list(betas))).groupBy("id").agg(F.sum(beta * F.col("value")).alias("value"))


def jvp(gradient: DataFrame, direction: DataFrame, by: Sequence[str] = ("level",)) -> DataFrame:
    """Directional derivative per level: the sum of value * v over (id, v) rows; ids without one count as 0."""
    return gradient.join(direction, "id").groupBy(*by).agg(F.sum(F.col("value") * F.col("v")).alias("jvp"))


def hvp(gradient: Callable[[DataFrame], DataFrame], points: DataFrame, direction: DataFrame, weight: str = "w", eps: float = 1e-6) -> DataFrame:
    """(id, level, value): Hessian times vector by a central difference of two gradients."""
    def moved(sign: float) -> DataFrame:
        v = points.join(direction, "id", "left")
        return v.withColumn(weight, F.col(weight) + F.lit(sign * eps) * F.coalesce("v", F.lit(0.0))).drop("v")

    up, down = gradient(moved(1.0)).withColumnRenamed("value", "up"), gradient(moved(-1.0)).withColumnRenamed("value", "down")
    return up.join(down, ["id", "level"]).select("id", "level", ((F.col("up") - F.col("down")) / (2 * eps)).alias("value"))
