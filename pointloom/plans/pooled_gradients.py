"""Derivatives of statistics pooled over runs with respect to the weights of the catalog's own points.

A point that a run clips does not take part in it and gets nothing from it. In each run a
point's derivative depends on its own cell alone, so derivatives of sums are worked out once
a cell, joined to the points in it, and added over the runs of a pool; the chain rule of the
pooled statistic comes last. Rows are one for each point, run and level; nothing is paired.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.cells import AXES, _keys, ratio
from pointloom.operators.neighbours import ROWS, cut
from pointloom.plans.multirun import _side, apply, pools, run_cells, run_haar_sums, run_raw_sums

SUMS = ("s1", "s2", "s3", "s4")
#: Most cells of runs that are broadcast (100 bytes each).
CELLS = 100_000


def _members(points: DataFrame, runs: DataFrame, axes: Sequence[str], bits: int, levels: Sequence[int], periodic: bool) -> DataFrame:
    """(id, run, scale, w, level, k..): the cell of each point in each run and level that holds it."""
    kept = apply(points, runs, axes, bits, periodic).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return kept.select("id", "run", "scale", F.col("w").cast("double").alias("w"), "level", *[F.expr(f"shiftright({a}, {bits} - level)").alias(k) for a, k in zip(axes, _keys(axes), strict=True)])


def _with_delta(cells: DataFrame, footprint: float) -> DataFrame:
    """Cells with the run's all_d, all_r, alpha and delta, null outside the footprint."""
    totals = cells.groupBy("run", "level").agg(F.sum("sw_d").alias("all_d"), F.sum("sw_r").alias("all_r"))
    joined = cells.join(F.broadcast(totals), ["run", "level"]).withColumn("alpha", ratio(F.col("all_d"), F.col("all_r")))  # one row a run and level
    return joined.withColumn("delta", F.when(F.col("sw_r") > footprint, ratio(F.col("sw_d"), F.col("alpha") * F.col("sw_r")) - 1))


def run_raw_sum_gradient(data: DataFrame, randoms: DataFrame, runs: DataFrame, of: str = "d", axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 5), periodic: bool = True, footprint: float = 0.0) -> DataFrame:
    """(id, run, level, side, dt, ds1..ds4): derivatives of a run's T and S_k with respect to data ('d') or random ('r') weights."""
    keys = _keys(axes)
    c = _with_delta(run_cells(data, randoms, runs, axes, bits, levels, periodic), footprint)
    d, inside = F.col("delta"), F.col("delta").isNotNull()
    power = lambda k: F.lit(1.0) if k == 0 else F.pow(d, k)
    sums = c.groupBy("run", "level").agg(*[F.coalesce(F.sum(F.when(inside, F.col("sw_r") * power(k))), F.lit(0.0)).alias(f"s{k}") for k in range(5)])
    j = c.join(F.broadcast(sums), ["run", "level"])  # one row a run and level
    out = [(F.when(inside, 1.0).otherwise(0.0) if of == "r" else F.lit(0.0)).alias("dt")]
    for k in (1, 2, 3, 4):
        both = k * (F.col(f"s{k}") + F.col(f"s{k - 1}"))
        if of == "d":
            local, common = k * power(k - 1) / F.col("alpha"), -both / (F.col("alpha") * F.col("all_r"))
        else:
            local, common = -(k - 1) * power(k) - k * power(k - 1), both / F.col("all_r")
        out.append((F.when(inside, local).otherwise(0.0) + common).alias(f"ds{k}"))
    own = _members(data if of == "d" else randoms, runs, axes, bits, levels, periodic)
    return own.join(j.select("run", "level", *keys, *out), ["run", "level", *keys]).select("id", "run", "level", _side(), "dt", *[f"d{s}" for s in SUMS])


def _chain(statistic: str) -> Column:
    """The derivative of a central moment, or of m3 / var^2, from t, s1..s4 and dt, ds1..ds4; 0 where it is not defined."""
    a = {k: F.col(f"s{k}") / F.col("t") for k in (1, 2, 3, 4)}
    da = {k: (F.col(f"ds{k}") - a[k] * F.col("dt")) / F.col("t") for k in (1, 2, 3, 4)}
    mu2, mu3 = a[2] - a[1] * a[1], a[3] - 3 * a[1] * a[2] + 2 * a[1] * a[1] * a[1]
    var = da[2] - 2 * a[1] * da[1]
    third = da[3] - 3 * (a[1] * da[2] + a[2] * da[1]) + 6 * a[1] * a[1] * da[1]
    fourth = da[4] - 4 * (a[1] * da[3] + a[3] * da[1]) + 6 * (2 * a[1] * a[2] * da[1] + a[1] * a[1] * da[2]) - 12 * a[1] * a[1] * a[1] * da[1]
    values = {"var": var, "m3": third, "m4": fourth, "s3": F.when(mu2 > 0, third / (mu2 * mu2) - 2 * mu3 * var / (mu2 * mu2 * mu2))}
    return F.coalesce(F.when(F.col("t") > 0, values[statistic]), F.lit(0.0))


def pooled_gradient(data: DataFrame, randoms: DataFrame, runs: DataFrame, statistic: str = "var", of: str = "d", tolerance: float = 0.02, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 5), periodic: bool = True, footprint: float = 0.0) -> DataFrame:
    """(id, pool, value): derivative of 'var', 'm3', 'm4' or 's3' of pooled() for each point that a run of the pool holds."""
    rows = run_raw_sums(data, randoms, runs, axes, bits, levels, periodic, footprint)
    at = F.broadcast(pools(rows, tolerance))  # one row a run and level
    sums = rows.join(at, ["run", "level"]).groupBy("pool").agg(*[F.sum(c).alias(c) for c in ("t", *SUMS)])
    g = run_raw_sum_gradient(data, randoms, runs, of, axes, bits, levels, periodic, footprint).join(at, ["run", "level"])
    added = g.groupBy("id", "pool").agg(F.sum("dt").alias("dt"), *[F.sum(f"d{s}").alias(f"d{s}") for s in SUMS])
    return added.join(F.broadcast(sums), "pool").select("id", "pool", _chain(statistic).alias("value"))


def run_average_gradient(data: DataFrame, randoms: DataFrame, runs: DataFrame, level: int, statistic: str = "var", of: str = "d", axes: Sequence[str] = AXES, bits: int = 16, periodic: bool = True, footprint: float = 0.0) -> DataFrame:
    """(id, value): derivative of the mean, over all runs, of the runs' own statistics at one level."""
    rows = run_raw_sums(data, randoms, runs, axes, bits, [level], periodic, footprint)
    g = run_raw_sum_gradient(data, randoms, runs, of, axes, bits, [level], periodic, footprint).join(F.broadcast(rows.drop("side")), ["run", "level"])
    n = F.broadcast(rows.agg(F.count("*").alias("runs")))
    return g.select("id", _chain(statistic).alias("value")).groupBy("id").agg(F.sum("value").alias("value")).crossJoin(n).select("id", (F.col("value") / F.col("runs")).alias("value"))  # one row


def _haar_parts(data: DataFrame, randoms: DataFrame, runs: DataFrame, rows: DataFrame, of: str, axes: Sequence[str], bits: int, levels: Sequence[int], periodic: bool, footprint: float) -> tuple[DataFrame, DataFrame]:
    """Derivatives of a run's T (dt) and T <we^2> (dq1.. by pattern) for a point: those of its child cell (run, level, k.., corner), and those of all points (run, level)."""
    keys, d = _keys(axes), len(axes)
    wanted = sorted({*levels, *(x + 1 for x in levels)})
    c = cut(_with_delta(run_cells(data, randoms, runs, axes, bits, wanted, periodic), footprint))
    corner = sum(F.col(k).bitwiseAND(F.lit(1)).cast("int") * (1 << i) for i, k in enumerate(keys)).alias("corner")
    up = [F.shiftright(k, 1).alias(k) for k in keys]
    fine = [x + 1 for x in levels]
    children = c.where(F.col("level").isin(fine) & F.col("delta").isNotNull()).select("run", (F.col("level") - 1).alias("level"), *up, corner, "delta", F.col("sw_r").alias("sw_c"), "alpha", "all_r")
    signs = [F.when(F.bit_count(F.col("corner").bitwiseAND(F.lit(e))) % 2 == 0, 1.0).otherwise(-1.0) for e in range(1, 1 << d)]
    whole = children.groupBy("run", "level", *keys).agg(F.count("*").alias("n"), *[F.sum(s * F.col("delta")).alias(f"e{e}") for e, s in enumerate(signs, 1)]).where(F.col("n") == (1 << d)).drop("n")
    parents = whole.join(c.where("delta is not null").select("run", "level", *keys, F.col("sw_r").alias("w_p")), ["run", "level", *keys])
    dqs = []
    for e, sign in enumerate(signs, 1):
        we = F.col(f"e{e}") / (1 << d)
        if of == "d":
            dq = 2 * F.col("w_p") * we * sign / ((1 << d) * F.col("sw_c") * F.col("alpha"))
        else:
            dq = we * we - 2 * F.col("w_p") * we * sign * (1 + F.col("delta")) / ((1 << d) * F.col("sw_c"))
        dqs.append(dq.alias(f"dq{e}"))
    local = children.join(parents, ["run", "level", *keys]).select("run", "level", *keys, "corner", F.lit(0.0 if of == "d" else 1.0).alias("dt"), *dqs)
    # every point of a run moves alpha, and so all coefficients alike
    alphas = c.groupBy("run", "level").agg(F.first("alpha").alias("alpha"), F.first("all_r").alias("all_r"))
    scale = 1 / F.col("all_r") if of == "r" else -1 / (F.col("alpha") * F.col("all_r"))
    q = rows.groupBy("run", "level").agg(*[F.sum(F.when(F.col("pattern") == e, F.col("q"))).alias(f"q{e}") for e in range(1, 1 << d)])
    return local, q.join(alphas, ["run", "level"]).select("run", "level", *[(2 * F.col(f"q{e}") * scale).alias(f"c{e}") for e in range(1, 1 << d)])


def _haar_rows(points: DataFrame, runs: DataFrame, local: DataFrame, common: DataFrame, axes: Sequence[str], bits: int, levels: Sequence[int], periodic: bool) -> DataFrame:
    """One row for each point, run and level: the columns of ``common`` but c1.., and dt, dq1.. of both parts."""
    keys, patterns = _keys(axes), range(1, 1 << len(axes))
    corner = sum(F.col(k).bitwiseAND(F.lit(1)).cast("int") * (1 << i) for i, k in enumerate(keys)).alias("corner")
    own = _members(points, runs, axes, bits, [x + 1 for x in levels], periodic).select("id", "run", (F.col("level") - 1).alias("level"), *[F.shiftright(k, 1).alias(k) for k in keys], corner)
    if runs.count() * sum(1 << (len(axes) * (x + 1)) for x in levels) <= CELLS:
        local = F.broadcast(local)  # CELLS rows at most
    met = own.join(F.broadcast(common), ["run", "level"]).join(local, ["run", "level", *keys, "corner"], "left")  # one row a run and level
    given = [c for c in common.columns if c not in {f"c{e}" for e in patterns}]
    return met.select("id", *given, F.coalesce("dt", F.lit(0.0)).alias("dt"), *[(F.col(f"c{e}") + F.coalesce(f"dq{e}", F.lit(0.0))).alias(f"dq{e}") for e in patterns])


def _by_pattern(d: int, value) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(e).alias("pattern"), *value(e)) for e in range(1, 1 << d)]))


def run_haar_gradient(data: DataFrame, randoms: DataFrame, runs: DataFrame, of: str = "d", axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 4), periodic: bool = True, footprint: float = 0.0) -> DataFrame:
    """(id, run, level, pattern, dt, dq): derivatives of a run's sums T and T <we^2> of run_haar_sums()."""
    rows = run_haar_sums(data, randoms, runs, axes, bits, levels, periodic, footprint)
    local, common = _haar_parts(data, randoms, runs, rows, of, axes, bits, levels, periodic, footprint)
    g = _haar_rows(data if of == "d" else randoms, runs, local, common, axes, bits, levels, periodic)
    added = g.groupBy("id", "run", "level").agg(*[F.sum(c).alias(c) for c in g.columns if c[:2] in ("dt", "dq")])
    return added.select("id", "run", "level", _by_pattern(len(axes), lambda e: [F.col("dt"), F.col(f"dq{e}").alias("dq")]))


def pooled_haar_gradient(data: DataFrame, randoms: DataFrame, runs: DataFrame, of: str = "d", tolerance: float = 0.02, axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(1, 4), periodic: bool = True, footprint: float = 0.0) -> DataFrame:
    """(id, pool, pattern, value): derivative of the mean square coefficients of pooled_haar().

    Points are dealt by id, so what their runs give is added where it arises; patterns become rows at the end.
    """
    patterns = range(1, 1 << len(axes))
    rows = cut(run_haar_sums(data, randoms, runs, axes, bits, levels, periodic, footprint))  # one row a run, level and pattern
    at = cut(pools(rows, tolerance))  # one row a run and level
    sums = rows.join(at, ["run", "level"]).groupBy("pool").agg(*[F.sum(F.when(F.col("pattern") == e, F.col(x))).alias(f"{x}{e}") for e in patterns for x in ("t", "q")])
    local, common = _haar_parts(data, randoms, runs, rows, of, axes, bits, levels, periodic, footprint)
    points = data if of == "d" else randoms
    dealt = points.repartition(max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() / ROWS)), "id")
    g = _haar_rows(dealt, runs, local, common.join(at, ["run", "level"]), axes, bits, levels, periodic)
    added = g.groupBy("id", "pool").agg(*[F.sum(c).alias(c) for c in g.columns if c[:2] in ("dt", "dq")])
    value = lambda e: ratio(F.col(f"dq{e}") - ratio(F.col(f"q{e}"), F.col(f"t{e}")) * F.col("dt"), F.col(f"t{e}"))
    return added.join(F.broadcast(sums), "pool").select("id", "pool", _by_pattern(len(axes), lambda e: [F.coalesce(value(e), F.lit(0.0)).alias("value")]))  # one row a pool


def quadrupole_gradient(gradient: DataFrame, by: str = "pool", d: int = 3) -> DataFrame:
    """(id, by, value): derivative of the coefficient along the last axis less the mean of those across, from rows with a pattern."""
    part = F.when(F.col("pattern") == 1 << (d - 1), F.col("value")).when(F.col("pattern").isin([1 << i for i in range(d - 1)]), -F.col("value") / (d - 1)).otherwise(0.0)
    return gradient.groupBy("id", by).agg(F.sum(part).alias("value"))


def pooled_xi_gradient(data: DataFrame, randoms: DataFrame, runs: DataFrame, of: str = "d", axes: Sequence[str] = AXES, bits: int = 16, levels: Sequence[int] = range(5), periodic: bool = True) -> DataFrame:
    """(id, scale, level, value): derivative of the shells of pooled_xi(), all shifts of one scale added; 0 where RR is 0."""
    keys, other = _keys(axes), "r" if of == "d" else "d"
    c = run_cells(data, randoms, runs, axes, bits, levels, periodic)
    half = lambda k: F.sum((F.col(f"sw_{k}") * F.col(f"sw_{k}") - F.col(f"sw2_{k}")) / 2)
    order = Window.partitionBy("run").orderBy("level")  # one row a level
    shells = c.groupBy("run", "scale", "level").agg(half("d").alias("dd"), half("r").alias("rr"), F.sum(F.col("sw_d") * F.col("sw_r")).alias("dr"))
    shells = shells.select("run", "scale", "level", *[(F.col(x) - F.lead(x, 1, 0.0).over(order)).alias(x) for x in ("dd", "dr", "rr")])
    totals = c.where(F.col("level") == min(levels)).groupBy("run").agg(*[F.sum(f"{x}_{k}").alias(f"all_{x}_{k}") for k in "dr" for x in ("sw", "sw2")])
    wd, wr = F.col("all_sw_d"), F.col("all_sw_r")
    pooled = shells.join(totals, "run").groupBy("scale", "level").agg(
        *[F.sum(x).alias(x) for x in ("dd", "dr", "rr")], F.sum((wd * wd - F.col("all_sw2_d")) / 2).alias("nd"), F.sum((wr * wr - F.col("all_sw2_r")) / 2).alias("nr"), F.sum(wd * wr).alias("nx")
    )
    own = _members(data if of == "d" else randoms, runs, axes, bits, levels, periodic).join(c.select("run", "level", *keys, "sw_d", "sw_r"), ["run", "level", *keys])
    by = Window.partitionBy("id", "run").orderBy("level")
    same = F.col(f"sw_{of}") - F.col("w")
    mine = own.select("id", "run", "scale", "level", "w", (same - F.coalesce(F.lead(same).over(by), F.lit(0.0))).alias("same"), (F.col(f"sw_{other}") - F.lead(f"sw_{other}", 1, 0.0).over(by)).alias("cross"))
    g = mine.join(F.broadcast(totals), "run").groupBy("id", "scale", "level").agg(
        F.sum("same").alias("same"), F.sum("cross").alias("cross"), F.sum(F.col(f"all_sw_{of}") - F.col("w")).alias("dn"), F.sum(f"all_sw_{other}").alias("dnx")
    )
    j = g.join(F.broadcast(pooled), ["scale", "level"])  # one row a scale and level
    fdd, fdr, frr = ratio(F.col("dd"), F.col("nd")), ratio(F.col("dr"), F.col("nx")), ratio(F.col("rr"), F.col("nr"))
    dfdr = (F.col("cross") - fdr * F.col("dnx")) / F.col("nx")
    if of == "d":
        value = ratio((F.col("same") - fdd * F.col("dn")) / F.col("nd") - 2 * dfdr, frr)
    else:
        dfrr = (F.col("same") - frr * F.col("dn")) / F.col("nr")
        value = ratio((2 * fdr - fdd) * dfrr - 2 * frr * dfdr, frr * frr)
    return j.select("id", "scale", "level", F.coalesce(value, F.lit(0.0)).alias("value"))


def pooled_aggregate(gradient: DataFrame, betas: dict[int, float], by: str = "pool") -> DataFrame:
    """(id, value): derivative of the sum of beta times the pooled statistic over pools (or levels, of one scale)."""
    beta = F.coalesce(*[F.when(F.col(by) == k, F.lit(float(b))) for k, b in betas.items()])
    return gradient.where(F.col(by).isin(list(betas))).groupBy("id").agg(F.sum(beta * F.col("value")).alias("value"))
