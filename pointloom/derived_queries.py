"""Queries of operators that build on cells, pairs and caps: runs and their gradients, maps, windows, jackknives, derived moments; with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.functions import cosmology, healpix
from pointloom.functions.coords import chord
from pointloom.operators import fields, gradients, knn, pairs, survey_window
from pointloom.plans import multirun, pooled_gradients
from pointloom.queries import _ALL, _EST, _RP, _TOP, AXES, DELTA_SQL, EDGES, GRAD_LEVELS, PI, RP, THETA, ZN, bins_sql, caps_sql, cells_sql, pairs_sql, query, r6, sql, view
from pointloom.queries import _counts as cap_counts

# -- runs -------------------------------------------------------------------------------


def runs_sql(plan: list[tuple], levels: list[int], data: str, randoms: str) -> str:
    """CTEs rc (cells of every run), rd (with delta) and rs (raw sums), as run_cells() and run_raw_sums() have them."""
    rows = " UNION ALL ".join(f"SELECT '{r[0]}' AS run, {r[1]}::DOUBLE AS scale, " + ", ".join(f"{o}::DOUBLE AS o{i}" for i, o in enumerate(r[2:])) for r in plan)
    move = ", ".join(f"({a} - o{i} * 65536 + 65536) % 65536 AS m{i}" for i, a in enumerate(AXES))
    inside = " AND ".join(f"m{i} < scale * 65536" for i in range(3))
    at = ", ".join(f"least(floor(m{i} / scale), 65535)::BIGINT >> (16 - level) AS k{i}" for i in range(3))

    def members(name: str, table: str, ident: str) -> str:
        return f"{name} AS (SELECT {ident}, w, run, scale, level, {at} FROM (SELECT *, {move} FROM {table}, runs), (SELECT unnest({levels}) AS level) WHERE {inside})"

    sums = ", ".join(f"coalesce(sum(w) FILTER (c = '{c}'), 0) AS sw_{c}, coalesce(sum(w * w) FILTER (c = '{c}'), 0) AS sw2_{c}, count(*) FILTER (c = '{c}') AS n_{c}" for c in "dr")
    return f""", runs AS ({rows}), {members("md", data, "id" if data.startswith("pts") else "0 AS id")}, {members("mr", randoms, "id" if randoms.startswith("pts") else "0 AS id")},
rc AS (SELECT run, scale, level, k0, k1, k2, {sums} FROM (SELECT *, 'd' AS c FROM md UNION ALL SELECT *, 'r' FROM mr) GROUP BY ALL),
rt AS (SELECT run, level, sum(sw_d) AS all_d, sum(sw_r) AS all_r, sum(sw_d) / sum(sw_r) AS alpha FROM rc GROUP BY ALL),
rd AS (SELECT rc.*, all_d, all_r, alpha, CASE WHEN sw_r > 0 AND alpha > 0 THEN sw_d / (alpha * sw_r) - 1 END AS delta FROM rc JOIN rt USING (run, level)),
rs AS (SELECT run, level, scale / 2 ** level AS side, sum(sw_r) AS t, sum(sw_r * delta) AS s1, sum(sw_r * delta ** 2) AS s2, sum(sw_r * delta ** 3) AS s3, sum(sw_r * delta ** 4) AS s4 FROM rd WHERE delta IS NOT NULL GROUP BY ALL),
pool AS (SELECT run, level, dense_rank() OVER (ORDER BY side) - 1 AS pool FROM rs)"""


SHIFTS = multirun.shifted_grid(2, 3)
RUNS = multirun.compose(SHIFTS, multirun.log_resizings(0.5, 1.0, 1, 3))
CENTRAL = "s2 / t - (s1 / t) ** 2 AS mu2, s3 / t - 3 * (s1 / t) * (s2 / t) + 2 * (s1 / t) ** 3 AS mu3, s4 / t - 4 * (s1 / t) * (s3 / t) + 6 * (s1 / t) ** 2 * (s2 / t) - 3 * (s1 / t) ** 4 AS mu4"


@query("multi_run_pooled", sql(runs_sql(RUNS, [1, 2], "box_d", "box_r") + f""", b AS (SELECT pool, count(*) AS n_rows, sum(side * t) / sum(t) AS side, coalesce(var_samp(s2 / t - (s1 / t) ** 2), 0) AS across_runs, sum(t) AS t, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3, sum(s4) AS s4
  FROM rs JOIN pool USING (run, level) GROUP BY pool), m AS (SELECT *, {CENTRAL} FROM b)
SELECT pool::BIGINT AS pool, n_rows, round(side, 6) AS side, round(across_runs, 6) AS across_runs, t, round(s1 / t, 6) + 0.0 AS mean_delta, round(mu2, 6) AS var_delta, round(mu3, 6) AS m3_delta, round(mu4, 6) AS m4_delta, round(mu3 / mu2 ** 2, 6) AS s3_delta FROM m""", "box_d", "box_r"))
def multi_run_pooled(spark, d):
    rows = multirun.run_raw_sums(view(spark, d, "box_d"), view(spark, d, "box_r"), multirun.plan(spark, RUNS), levels=[1, 2])
    return multirun.pooled(rows, 0.02).select("pool", "n_rows", *r6("side", "across_runs"), "t", *r6("mean_delta", "var_delta", "m3_delta", "m4_delta", "s3_delta"))


_CORNER = "((k0 & 1) | ((k1 & 1) << 1) | ((k2 & 1) << 2))"


def run_haar_sql(level: int) -> str:
    """CTE rh: Haar coefficients of every run's cells of one parent level whose children all count, one row a pattern."""
    we = ", ".join(f"sum(CASE WHEN bit_count({_CORNER} & {e}) % 2 = 0 THEN delta ELSE -delta END) / 8 AS e{e}" for e in range(1, 8))
    one = " UNION ALL ".join(f"SELECT run, scale, p0, p1, p2, {e} AS pattern, e{e} AS we, sw_r AS w_p FROM ch" for e in range(1, 8))
    return f""", fa AS (SELECT run, k0 >> 1 AS p0, k1 >> 1 AS p1, k2 >> 1 AS p2, {we} FROM rd WHERE level = {level + 1} AND delta IS NOT NULL GROUP BY ALL HAVING count(*) = 8),
ch AS (SELECT fa.*, rd.scale, rd.sw_r FROM fa JOIN rd ON rd.run = fa.run AND rd.level = {level} AND rd.k0 = p0 AND rd.k1 = p1 AND rd.k2 = p2 WHERE rd.delta IS NOT NULL), rh AS ({one}),
rq AS (SELECT run, pattern, sum(w_p) AS t, sum(w_p * we * we) AS q FROM rh GROUP BY ALL)"""


@query("pooled_xi", sql(runs_sql(RUNS, list(range(4)), "box_d", "box_r") + """, s AS (SELECT run, scale, level, sum((sw_d * sw_d - sw2_d) / 2) AS dd, sum((sw_r * sw_r - sw2_r) / 2) AS rr, sum(sw_d * sw_r) AS dr FROM rc GROUP BY ALL),
sh AS (SELECT run, scale, level, dd - lead(dd, 1, 0) OVER o AS dd, dr - lead(dr, 1, 0) OVER o AS dr, rr - lead(rr, 1, 0) OVER o AS rr FROM s WINDOW o AS (PARTITION BY run ORDER BY level)),
t AS (SELECT run, sum(sw_d) AS wd, sum(sw2_d) AS wd2, sum(sw_r) AS wr, sum(sw2_r) AS wr2 FROM rc WHERE level = 0 GROUP BY run),
j AS (SELECT scale, level, sum(dd) AS dd, sum(dr) AS dr, sum(rr) AS rr, sum((wd * wd - wd2) / 2) AS nd, sum((wr * wr - wr2) / 2) AS nr, sum(wd * wr) AS nx FROM sh JOIN t USING (run) GROUP BY scale, level)
SELECT round(scale, 6) AS scale, level, dd, dr, rr, round(CASE WHEN rr <> 0 THEN (dd / nd - 2 * dr / nx + rr / nr) / (rr / nr) END, 6) AS xi FROM j""", "box_d", "box_r"))
def pooled_xi(spark, d):
    """Eight shifts at each of two scales."""
    return multirun.pooled_xi(view(spark, d, "box_d"), view(spark, d, "box_r"), multirun.plan(spark, RUNS), levels=range(4)).select(F.round("scale", 6).alias("scale"), "level", "dd", "dr", "rr", *r6("xi"))


@query("pooled_haar", sql(runs_sql(SHIFTS, [1, 2], "box_d", "box_r") + run_haar_sql(1) + " SELECT 0::BIGINT AS pool, pattern, 0.5::DOUBLE AS side, round(sum(q) / sum(t), 6) AS mean_we2 FROM rq GROUP BY pattern", "box_d", "box_r"))
def pooled_haar(spark, d):
    runs = multirun.plan(spark, SHIFTS)
    return multirun.pooled_haar(multirun.run_haar_sums(view(spark, d, "box_d"), view(spark, d, "box_r"), runs, levels=[1]), 0.02).select("pool", "pattern", *r6("side", "mean_we2"))


@query("pooled_counts", sql(runs_sql(SHIFTS, [2, 3], "box_d", "box_r") + """, c AS (SELECT run, level, n_d AS n, count(*) AS cells FROM rc GROUP BY ALL), s AS (SELECT run, level, sum(cells) AS whole FROM c GROUP BY ALL)
SELECT pool::BIGINT AS pool, n, sum(cells)::BIGINT AS cells, round(sum(cells / whole) / 8, 6) AS p FROM c JOIN s USING (run, level) JOIN pool USING (run, level) GROUP BY pool, n""", "box_d", "box_r"))
def pooled_counts(spark, d):
    runs = multirun.plan(spark, SHIFTS)
    return multirun.pooled_counts(multirun.run_counts(view(spark, d, "box_d"), view(spark, d, "box_r"), runs, levels=[2, 3]), 0.02).select("pool", "n", "cells", *r6("p"))


def run_gradient_sql(of: str, plan: list[tuple], levels: list[int]) -> str:
    """CTEs rg (derivatives of T and S_k for each point, run and level) and pg (added over a pool, with the pool's sums)."""
    both = [f"{k} * (s.s{k} + s.{'t' if k == 1 else f's{k - 1}'})" for k in (1, 2, 3, 4)]
    if of == "d":
        ds = [f"CASE WHEN delta IS NOT NULL THEN {k} * delta ** {k - 1} / alpha ELSE 0 END - {both[k - 1]} / (alpha * all_r) AS ds{k}" for k in (1, 2, 3, 4)]
    else:
        ds = [f"CASE WHEN delta IS NOT NULL THEN -({k - 1} * delta ** {k}) - {k} * delta ** {k - 1} ELSE 0 END + {both[k - 1]} / all_r AS ds{k}" for k in (1, 2, 3, 4)]
    add = ", ".join(f"sum(ds{k}) AS ds{k}" for k in (1, 2, 3, 4))
    moments = "da2 - 2 * a1 * da1 AS dvar, da3 - 3 * (a1 * da2 + a2 * da1) + 6 * a1 * a1 * da1 AS dm3, da4 - 4 * (a1 * da3 + a3 * da1) + 6 * (2 * a1 * a2 * da1 + a1 * a1 * da2) - 12 * a1 ** 3 * da1 AS dm4, a2 - a1 * a1 AS mu2, a3 - 3 * a1 * a2 + 2 * a1 ** 3 AS mu3"
    return runs_sql(plan, levels, "pts_d", "pts_r") + f""", rg AS (SELECT m.id, m.run, m.level, {"CASE WHEN delta IS NOT NULL THEN 1 ELSE 0 END" if of == "r" else "0"} AS dt, {", ".join(ds)}
  FROM m{of} m JOIN rd USING (run, level, k0, k1, k2) JOIN rs s USING (run, level)),
ps AS (SELECT pool, sum(t) AS t, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3, sum(s4) AS s4 FROM rs JOIN pool USING (run, level) GROUP BY pool),
pa AS (SELECT id, pool, sum(dt) AS dt, {add} FROM rg JOIN pool USING (run, level) GROUP BY ALL),
pb AS (SELECT id, pool, {", ".join(f"s{k} / t AS a{k}, (ds{k} - s{k} / t * dt) / t AS da{k}" for k in (1, 2, 3, 4))} FROM pa JOIN ps USING (pool)),
pg AS (SELECT id, pool::BIGINT AS pool, {moments} FROM pb)"""


def _pooled(name: str, statistic: str, of: str, value: str, plan: list[tuple] = SHIFTS, levels: list[int] = GRAD_LEVELS):
    @query(name, sql(run_gradient_sql(of, plan, levels) + f" SELECT id, pool, round(1000 * ({value}), 6) + 0.0 AS value FROM pg", "pts_d", "pts_r"))
    def run(spark, d):
        g = pooled_gradients.pooled_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), multirun.plan(spark, plan), statistic, of, levels=levels)
        return g.select("id", "pool", (F.round(1000 * F.col("value"), 6) + 0.0).alias("value"))


_pooled("pooled_gradient_var", "var", "d", "dvar")
_pooled("pooled_gradient_m3", "m3", "d", "dm3")
_pooled("pooled_gradient_m4", "m4", "d", "dm4")
_pooled("pooled_gradient_s3", "s3", "d", "CASE WHEN mu2 > 0 THEN dm3 / mu2 ** 2 - 2 * mu3 * dvar / mu2 ** 3 ELSE 0 END")
_HALVES = multirun.compose([("a", 1.0, 0.0, 0.0, 0.0), ("b", 1.0, 0.5, 0.25, 0.0)], [("h", 0.5, 0.0, 0.0, 0.0)])  # runs that clip points
_pooled("pooled_gradient_var_random", "var", "r", "dvar", _HALVES, [1])
_pooled("pooled_gradient_s3_random", "s3", "r", "CASE WHEN mu2 > 0 THEN dm3 / mu2 ** 2 - 2 * mu3 * dvar / mu2 ** 3 ELSE 0 END", _HALVES, [1])


@query("run_average_gradient", sql(run_gradient_sql("d", _HALVES, [1]) + """
SELECT id, round(1000 * sum((ds2 - 2 * s1 / t * ds1) / t) / 2, 6) AS value FROM rg JOIN rs USING (run, level) GROUP BY id""", "pts_d", "pts_r"))
def run_average_gradient(spark, d):
    g = pooled_gradients.run_average_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), multirun.plan(spark, _HALVES), 1)
    return g.select("id", F.round(1000 * F.col("value"), 6).alias("value"))


def haar_gradient_sql(of: str) -> str:
    """CTE hg: derivatives of each run's T and q of one parent level for each point."""
    sign = f"CASE WHEN bit_count({_CORNER} & pattern) % 2 = 0 THEN 1 ELSE -1 END"
    dq = f"2 * w_p * we * {sign} / (8 * c.sw_r * alpha)" if of == "d" else f"we * we - 2 * w_p * we * {sign} * (1 + delta) / (8 * c.sw_r)"
    common = "-2 * q / (alpha * all_r)" if of == "d" else "2 * q / all_r"
    return f""", mem AS (SELECT id, run, k0, k1, k2 FROM m{of} WHERE level = 2), al AS (SELECT DISTINCT run, alpha, all_r FROM rd),
hl AS (SELECT mem.id, mem.run, pattern, {1 if of == "r" else 0} AS dt, {dq} AS dq FROM mem JOIN rd c ON c.run = mem.run AND c.level = 2 AND c.k0 = mem.k0 AND c.k1 = mem.k1 AND c.k2 = mem.k2
  JOIN rh ON rh.run = mem.run AND p0 = mem.k0 >> 1 AND p1 = mem.k1 >> 1 AND p2 = mem.k2 >> 1 WHERE delta IS NOT NULL),
hg AS (SELECT id, run, pattern, sum(dt) AS dt, sum(dq) AS dq FROM (SELECT * FROM (SELECT id, run, pattern, dt, dq FROM hl) UNION ALL SELECT mem.id, mem.run, pattern, 0, {common} FROM mem JOIN rq USING (run) JOIN al USING (run)) GROUP BY ALL)""".replace(_CORNER, _CORNER.replace("k0", "mem.k0").replace("k1", "mem.k1").replace("k2", "mem.k2"))


def _pooled_haar(name: str, of: str):
    text = runs_sql(SHIFTS, [1, 2], "pts_d", "pts_r") + run_haar_sql(1) + haar_gradient_sql(of)
    pooled = ", hs AS (SELECT pattern, sum(t) AS t, sum(q) AS q FROM rq GROUP BY pattern), hv AS (SELECT id, pattern, (sum(dq) - any_value(hs.q / hs.t) * sum(dt)) / any_value(hs.t) AS value FROM hg JOIN hs USING (pattern) GROUP BY id, pattern)"

    @query(name, sql(text + pooled + " SELECT id, 0::BIGINT AS pool, pattern, round(1000 * value, 6) + 0.0 AS value FROM hv", "pts_d", "pts_r"))
    def run(spark, d):
        g = pooled_gradients.pooled_haar_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), multirun.plan(spark, SHIFTS), of, levels=[1])
        return g.select("id", "pool", "pattern", (F.round(1000 * F.col("value"), 6) + 0.0).alias("value"))

    @query(f"{name}_quadrupole", sql(text + pooled + " SELECT id, 0::BIGINT AS pool, round(1000 * sum(CASE pattern WHEN 4 THEN value WHEN 1 THEN -value / 2 WHEN 2 THEN -value / 2 ELSE 0 END), 6) + 0.0 AS value FROM hv GROUP BY id", "pts_d", "pts_r"))
    def quadrupole(spark, d):
        g = pooled_gradients.pooled_haar_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), multirun.plan(spark, SHIFTS), of, levels=[1])
        return pooled_gradients.quadrupole_gradient(g).select("id", "pool", (F.round(1000 * F.col("value"), 6) + 0.0).alias("value"))


_pooled_haar("pooled_gradient_haar", "d")
_pooled_haar("pooled_gradient_haar_random", "r")


def _pooled_xi(name: str, of: str):
    other = "r" if of == "d" else "d"
    lead = "lead({0}, 1, 0) OVER (PARTITION BY run ORDER BY level)"
    end = "(same - fdd * dn) / nd - 2 * (crossed - fdr * dnx) / nx" if of == "d" else "((2 * fdr - fdd) * (same - frr * dn) / nr - 2 * frr * (crossed - fdr * dnx) / nx) / frr"
    text = runs_sql(SHIFTS, [0, 1, 2, 3], "pts_d", "pts_r") + f""", ls AS (SELECT run, level, sum(sw_d * sw_d - sw2_d) / 2 AS dd, sum(sw_d * sw_r) AS dr, sum(sw_r * sw_r - sw2_r) / 2 AS rr FROM rc GROUP BY ALL),
sh AS (SELECT run, level, dd - {lead.format("dd")} AS dd, dr - {lead.format("dr")} AS dr, rr - {lead.format("rr")} AS rr FROM ls),
nn AS (SELECT run, sum(sw_d) AS wd, sum(sw_r) AS wr, sum(sw2_d) AS wd2, sum(sw2_r) AS wr2 FROM rc WHERE level = 0 GROUP BY run),
px AS (SELECT level, sum(dd) / sum((wd * wd - wd2) / 2) AS fdd, sum(dr) / sum(wd * wr) AS fdr, sum(rr) / sum((wr * wr - wr2) / 2) AS frr, sum((wd * wd - wd2) / 2) AS nd, sum(wd * wr) AS nx, sum((wr * wr - wr2) / 2) AS nr FROM sh JOIN nn USING (run) GROUP BY level),
me AS (SELECT m.id, m.w, m.run, m.level, sw_{of} - m.w AS same, sw_{other} AS crossed FROM m{of} m JOIN rc USING (run, level, k0, k1, k2)),
mg AS (SELECT id, w, run, level, same - coalesce(lead(same) OVER o, 0) AS same, crossed - lead(crossed, 1, 0) OVER o AS crossed FROM me WINDOW o AS (PARTITION BY id, run ORDER BY level)),
ms AS (SELECT id, level, sum(same) AS same, sum(crossed) AS crossed, sum(w{of} - w) AS dn, sum(w{other}) AS dnx FROM mg JOIN nn USING (run) GROUP BY ALL)
SELECT id, 1.0::DOUBLE AS scale, level, round(1000 * coalesce(({end}) / nullif(frr, 0), 0), 6) + 0.0 AS value FROM ms JOIN px USING (level)"""

    @query(name, sql(text, "pts_d", "pts_r"))
    def run(spark, d):
        g = pooled_gradients.pooled_xi_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), multirun.plan(spark, SHIFTS), of, levels=range(4))
        return g.select("id", "scale", "level", (F.round(1000 * F.col("value"), 6) + 0.0).alias("value"))


_pooled_xi("pooled_gradient_xi", "d")
_pooled_xi("pooled_gradient_xi_random", "r")

# -- gradients of one run ----------------------------------------------------------------

_MOMENTS = """, cg AS (SELECT c.*, m1, mu2, mu3, mu4, t FROM delta c JOIN mom USING (level)),
mem AS (SELECT id, w, level, c0 >> (16 - level) AS k0, c1 >> (16 - level) AS k1, c2 >> (16 - level) AS k2 FROM {0}, (SELECT unnest([1, 2]) AS level))"""


@query("gradient_var_random", sql(cells_sql("pts_d", "pts_r", GRAD_LEVELS) + DELTA_SQL + _MOMENTS.format("pts_r") + """
SELECT id, level, round(1000 * (2 * mu2 / all_r - CASE WHEN delta IS NOT NULL THEN (delta - m1) ** 2 + 2 * (1 + m1) * (delta - m1) + mu2 ELSE 0 END / t), 6) + 0.0 AS value FROM mem JOIN cg USING (level, k0, k1, k2)""", "pts_d", "pts_r"))
def gradient_var_random(spark, d):
    g = gradients.field_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), "var", "r", levels=GRAD_LEVELS)
    return g.select("id", "level", (F.round(1000 * F.col("value"), 6) + 0.0).alias("value"))


def _haar(name: str, of: str):
    text = runs_sql([("one", 1.0, 0.0, 0.0, 0.0)], [1, 2], "pts_d", "pts_r") + run_haar_sql(1) + haar_gradient_sql(of)

    @query(name, sql(text + " SELECT id, 1 AS level, pattern, round(1000 * (dq - q / t * dt) / t, 6) + 0.0 AS value FROM hg JOIN rq USING (run, pattern)", "pts_d", "pts_r"))
    def run(spark, d):
        g = gradients.haar_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), levels=[1], of=of)
        return g.select("id", "level", "pattern", (F.round(1000 * F.col("value"), 6) + 0.0).alias("value"))


_haar("gradient_haar", "d")
_haar("gradient_haar_random", "r")


@query("hvp_var", sql(", " + ", ".join(
    f"{n}_p AS (SELECT id, c0 >> 15 AS k0, c1 >> 15 AS k1, c2 >> 15 AS k2, w + {e} AS w FROM pts_d), {n}_c AS (SELECT k0, k1, k2, sum(w) FILTER (d = 1) AS sd, sum(w) FILTER (d = 0) AS sr FROM (SELECT k0, k1, k2, w, 1 AS d FROM {n}_p UNION ALL SELECT c0 >> 15, c1 >> 15, c2 >> 15, w, 0 FROM pts_r) GROUP BY ALL), "
    f"{n}_t AS (SELECT sum(sd) / sum(sr) AS alpha, sum(sr) AS t FROM {n}_c), {n}_d AS (SELECT k0, k1, k2, alpha, t, sr, coalesce(sd, 0) / (alpha * sr) - 1 AS delta FROM {n}_c, {n}_t WHERE sr > 0), "
    f"{n}_m AS (SELECT sum(sr * delta) / any_value(t) AS m1, sum(sr * delta * delta) / any_value(t) - (sum(sr * delta) / any_value(t)) ** 2 AS mu2 FROM {n}_d), "
    f"{n}_g AS (SELECT id, 2 * (delta - m1) / (alpha * t) - 2 * mu2 / (alpha * t) AS g FROM {n}_p JOIN {n}_d USING (k0, k1, k2), {n}_m)" for n, e in (("up", 0.01), ("dn", -0.01)))
    + " SELECT id, 1 AS level, round(100000 * (up_g.g - dn_g.g) / 0.02, 6) + 0.0 AS value FROM up_g JOIN dn_g USING (id)", "pts_d", "pts_r"))
def hvp_var(spark, d):
    p, r = view(spark, d, "pts_d"), view(spark, d, "pts_r")
    f = lambda x: gradients.field_gradient(x, r, "var", levels=[1])
    return gradients.hvp(f, p, p.select("id", F.lit(1.0).alias("v")), eps=0.01).select("id", "level", (F.round(100000 * F.col("value"), 6) + 0.0).alias("value"))


# -- pairs ------------------------------------------------------------------------------


def _rpz_sql(name: str, src: str) -> str:
    m = [f"(a{k} + b{k}) / 2.0" for k in range(3)]
    dot, norm = " + ".join(f"(b{k} - a{k}) * {m[k]}" for k in range(3)), "sqrt(" + " + ".join(f"{x} * {x}" for x in m) + ")"
    a, b = {"dd": ("pts_d", "pts_d"), "dr": ("pts_d", "pts_r"), "rr": ("pts_r", "pts_r")}[src]
    z = bins_sql("(x.z + y.z) / 2", [0.5, 1.0, 1.5, 2.0])
    return f""", {name}_l AS (SELECT p.*, abs(({dot}) / {norm}) AS pi, {z} AS zb FROM {src} p JOIN {a} x ON x.id = p.i JOIN {b} y ON y.id = p.j),
{name} AS (SELECT {bins_sql('sqrt(greatest(0, d2 - pi * pi))', RP)} AS rp_bin, {bins_sql('pi', PI)} AS pi_bin, sum(exp((([0.75, 1.25, 1.75])[zb + 1] - 1.2) ** 2 / -0.32)) AS n FROM {name}_l WHERE zb IS NOT NULL GROUP BY ALL)"""


@query("wp_kernel_z", sql("".join(pairs_sql(n, a, b, _TOP) for n, a, b in (("dd", "pts_d", "pts_d"), ("dr", "pts_d", "pts_r"), ("rr", "pts_r", "pts_r"))) + "".join(_rpz_sql(f"{n}2", n) for n in ("dd", "dr", "rr")) + _RP[_RP.index("\n, grid AS"):]
       + " SELECT rp_bin::INT AS rp_bin, round(2 * sum(xi * 2000), 6) AS wp FROM xi GROUP BY rp_bin", "pts_d", "pts_r"))
def wp_kernel_z(spark, d):
    return pairs.wp_kernel_z(view(spark, d, "pts_d"), view(spark, d, "pts_r"), RP, PI, [0.5, 1.0, 1.5, 2.0], 1.2, 0.4).select("rp_bin", *r6("wp"))


@query("overdensity_windowed", sql(pairs_sql("dd", "pts_d", "pts_d") + pairs_sql("dr", "pts_d", "pts_r") + f"""
, bd AS (SELECT id, bin, count(*) AS n FROM (SELECT i AS id, bin FROM dd UNION ALL SELECT j, bin FROM dd) GROUP BY ALL), br AS (SELECT i AS id, bin, count(*) AS n FROM dr GROUP BY ALL)
SELECT p.id, b.bin::INT AS bin, round(coalesce(bd.n, 0) * (SELECT count(*) FROM pts_r) / (br.n * (SELECT count(*) FROM pts_d)) - 1, 6) AS delta FROM pts_d p CROSS JOIN range({len(EDGES) - 1}) b(bin)
LEFT JOIN bd ON bd.id = p.id AND bd.bin = b.bin LEFT JOIN br ON br.id = p.id AND br.bin = b.bin""", "pts_d", "pts_r"))
def overdensity_windowed(spark, d):
    return pairs.overdensity_windowed(view(spark, d, "pts_d"), view(spark, d, "pts_r"), EDGES).select("id", "bin", *r6("delta"))


_WRAP = " + ".join(f"least(abs(a.c{k} - b.c{k}), 65536 - abs(a.c{k} - b.c{k})) ** 2" for k in range(3))
_SHELLS = "(4 / 3 * pi() * (([" + ", ".join(str(e) for e in EDGES[1:]) + "])[b.bin + 1] ** 3 - ([" + ", ".join(str(e) for e in EDGES[:-1]) + "])[b.bin + 1] ** 3))"


@query("weighted_xi", sql(f""", p AS (SELECT a.w * b.w AS w, {bins_sql(f"({_WRAP})", [e * e for e in EDGES])} AS bin FROM pts_d a, pts_d b WHERE a.id <> b.id AND {_WRAP} > 0 AND {_WRAP} < {EDGES[-1] ** 2})
SELECT b.bin::INT AS bin, round(coalesce((SELECT sum(w) FROM p WHERE p.bin = b.bin), 0) / ((SELECT count(*) * (count(*) - 1.0) FROM pts_d) * {_SHELLS} / 65536.0 ** 3) - 1, 6) AS xi FROM range({len(EDGES) - 1}) b(bin)""", "pts_d"))
def weighted_xi(spark, d):
    return pairs.weighted_xi(view(spark, d, "pts_d"), EDGES, 65536.0).select("bin", *r6("xi"))


_KERNEL = "CASE WHEN r <= 2 * radius THEN (1 - 0.75 * r / radius + (r / radius) ** 3 / 16) * 3 / (4 * pi() * radius ** 3) ELSE 0 END"


def _norms(x, spark, d):
    n = {k: float(view(spark, d, f"pts_{k}").count()) for k in "dr"}
    return (F.col("dd") / F.lit(n["d"] ** 2)).alias("fdd"), (F.col("dr") / F.lit(n["d"] * n["r"])).alias("fdr"), (F.col("rr") / F.lit(n["r"] ** 2)).alias("frr")


@query("sigma2_from_rp_pi", sql(_RP + f""", r AS (SELECT radius, dd / nd ** 2 AS fdd, dr / nd / nr AS fdr, rr / nr ** 2 AS frr, sqrt(([1250.0, 3000.0, 5000.0])[rp_bin + 1] ** 2 + ([1000.0, 3000.0, 5000.0])[pi_bin + 1] ** 2) AS r FROM xi, (SELECT unnest([2000.0, 3000.0]::DOUBLE[]) AS radius)),
k AS (SELECT *, {_KERNEL} AS k FROM r) SELECT radius, round(coalesce((sum(fdd * k) - 2 * sum(fdr * k) + sum(frr * k)) / nullif(sum(frr * k), 0), 0), 6) AS sigma2 FROM k GROUP BY radius""", "pts_d", "pts_r"))
def sigma2_from_rp_pi(spark, d):
    x = pairs.xi_rp_pi(view(spark, d, "pts_d"), view(spark, d, "pts_r"), RP, PI)
    return pairs.sigma2_from_rp_pi(x.select("rp_bin", "pi_bin", *_norms(x, spark, d)), RP, PI, [2000.0, 3000.0]).select("radius", *r6("sigma2"))


_MIDS = "([" + ", ".join(str((a + b) / 2) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)) + "])"


@query("sigma2_from_counts", sql(_ALL + _EST + f""", r AS (SELECT radius, dd / nd ** 2 AS fdd, dr / nd / nr AS fdr, rr / nr ** 2 AS frr, {_MIDS}[bin + 1] AS r FROM est, (SELECT unnest([2000.0, 3000.0]::DOUBLE[]) AS radius)),
k AS (SELECT *, {_KERNEL} AS k FROM r) SELECT radius, round((sum(fdd * k) - 2 * sum(fdr * k) + sum(frr * k)) / sum(frr * k), 6) AS sigma2 FROM k GROUP BY radius""", "pts_d", "pts_r"))
def sigma2_from_counts(spark, d):
    x = pairs.xi_estimators(view(spark, d, "pts_d"), view(spark, d, "pts_r"), EDGES)
    return pairs.sigma2_from_counts(x.select("bin", *_norms(x, spark, d)), EDGES, [2000.0, 3000.0]).select("radius", *r6("sigma2"))


@query("sigma2_from_xi", sql(_ALL + _EST + f""", r AS (SELECT radius, {_MIDS}[bin + 1]::DOUBLE AS r, xi_ls AS xi FROM ls, (SELECT unnest([2000.0, 3000.0]::DOUBLE[]) AS radius)), k AS (SELECT *, 4 * pi() * r * r * xi * {_KERNEL} AS f FROM r),
s AS (SELECT radius, (f + lead(f) OVER o) / 2 * (lead(r) OVER o - r) AS area FROM k WINDOW o AS (PARTITION BY radius ORDER BY r)) SELECT radius, round(sum(area), 6) AS sigma2 FROM s GROUP BY radius""", "pts_d", "pts_r"))
def sigma2_from_xi(spark, d):
    mid = F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)]), F.col("bin") + 1)
    x = pairs.xi_estimators(view(spark, d, "pts_d"), view(spark, d, "pts_r"), EDGES).select(mid.alias("r"), F.col("xi_ls").alias("xi"))
    return pairs.sigma2_from_xi(x, [2000.0, 3000.0]).select("radius", *r6("sigma2"))


@query("tidal_shapes", sql(pairs_sql("dd", "pts_d", "pts_d") + """
, e AS (SELECT i AS id, * FROM dd WHERE bin IS NOT NULL UNION ALL SELECT j, * FROM dd WHERE bin IS NOT NULL),
t AS (SELECT id, avg((b0 - a0) * (b0 - a0) / d2) - 1.0 / 3 AS xx, avg((b1 - a1) * (b1 - a1) / d2) - 1.0 / 3 AS yy, avg((b2 - a2) * (b2 - a2) / d2) - 1.0 / 3 AS zz,
  avg((b0 - a0) * (b1 - a1) / d2) AS xy, avg((b0 - a0) * (b2 - a2) / d2) AS xz, avg((b1 - a1) * (b2 - a2) / d2) AS yz FROM e GROUP BY id HAVING count(*) >= 4),
p AS (SELECT *, sqrt((xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM t),
a AS (SELECT *, acos(greatest(-1, least(1, (xx * yy * zz + 2 * xy * yz * xz - xx * yz * yz - yy * xz * xz - zz * xy * xy) / 2 / p ** 3))) / 3 AS phi FROM p),
v AS (SELECT id, 2 * p * cos(phi + 2 * pi() / 3) AS e0, -2 * p * (cos(phi) + cos(phi + 2 * pi() / 3)) AS e1, 2 * p * cos(phi) AS e2 FROM a)
SELECT id, round(e0, 6) + 0.0 AS e0, round(e1, 6) + 0.0 AS e1, round(e2, 6) + 0.0 AS e2, CASE WHEN greatest(abs(e0), abs(e1), abs(e2)) < 0.05 THEN 'isotropic' WHEN e0 < 0 AND e2 > 0 AND e1 - e0 < 0.05 THEN 'filament' WHEN e0 < 0 AND e2 > 0 AND e2 - e1 < 0.05 THEN 'sheet' ELSE 'triaxial' END AS shape FROM v""", "pts_d"))
def tidal_shapes(spark, d):
    t = pairs.pair_tensor(view(spark, d, "pts_d"), EDGES).groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("txx", "tyy", "tzz", "txy", "txz", "tyz")]).where("n >= 4")
    mean = t.select("id", *[(F.col(c) / F.col("n") - (1 / 3 if c[1] == c[2] else 0.0)).alias(c) for c in ("txx", "tyy", "tzz", "txy", "txz", "tyz")])
    return fields.shape_class(fields.eigenvalues(mean), 0.05).select("id", *r6("e0", "e1", "e2"), "shape")


# -- caps -------------------------------------------------------------------------------


def _moments(spark, d, which: str, power: int):
    return knn.cap_moments(knn.knn_moments(cap_counts(spark, d, which)), knn.shell_sizes(view(spark, d, f"sky_{which[1]}"), ZN), which, power)


def _moment_sql(which: str, powers: tuple[int, ...] = (1, 2)) -> str:
    n = f"sky_{which[1]}"
    values = ", ".join(f"s{p} / n_q / size AS v{p}" for p in powers)
    return caps_sql(which, f"sky_{which[0]}", n, which[0] == which[1]) + f", {which}_s AS (SELECT {bins_sql('red', ZN)} AS jn, count(*) AS size FROM {n} GROUP BY 1), {which}_v AS (SELECT t, iq, m.jn, {values} FROM {which}_m m JOIN {which}_s s ON m.jn = s.jn)"


_FOUR = "".join(_moment_sql(x) for x in ("dd", "dr", "rd", "rr"))
_JOIN = "FROM dd_v JOIN dr_v USING (t, iq, jn) JOIN rd_v USING (t, iq, jn) JOIN rr_v USING (t, iq, jn)"
_LS = "CASE WHEN rr_v.v{0} > 0 THEN (dd_v.v{0} - dr_v.v{0} - rd_v.v{0} + rr_v.v{0}) / rr_v.v{0} ELSE 0 END"


@query("moment_ls", sql(_FOUR + f" SELECT t::INT AS t, iq, jn::INT AS jn, round({_LS.format(2)}, 6) AS moment {_JOIN}", "sky_d", "sky_r"))
def moment_ls(spark, d):
    return knn.moment_ls(*[_moments(spark, d, x, 2) for x in ("dd", "dr", "rd", "rr")]).select("t", "iq", "jn", *r6("moment"))


@query("moment_hamilton", sql(_FOUR + f" SELECT t::INT AS t, iq, jn::INT AS jn, round(coalesce(dd_v.v2 * rr_v.v2 / nullif(dr_v.v2 * rd_v.v2, 0), 0) - 1, 6) AS moment {_JOIN}", "sky_d", "sky_r"))
def moment_hamilton(spark, d):
    return knn.moment_hamilton(*[_moments(spark, d, x, 2) for x in ("dd", "dr", "rd", "rr")]).select("t", "iq", "jn", *r6("moment"))


@query("sigma2_clust_ls", sql(_FOUR + f", m AS (SELECT t, iq, jn, {_LS.format(1)} AS m1, {_LS.format(2)} AS m2 {_JOIN}) SELECT t::INT AS t, iq, jn::INT AS jn, round(CASE WHEN m1 > 0 THEN (m2 - m1 * m1) / (m1 * m1) - 1 / m1 END, 4) AS sigma2 FROM m", "sky_d", "sky_r"))
def sigma2_clust_ls(spark, d):
    first, second = (knn.moment_ls(*[_moments(spark, d, x, p) for x in ("dd", "dr", "rd", "rr")]) for p in (1, 2))
    return knn.sigma2_ls(first, second).select("t", "iq", "jn", (F.round("sigma2", 4) + 0.0).alias("sigma2"))


def _xi_of_moments(spark, d):
    return knn.moment_ls(*[_moments(spark, d, x, 1) for x in ("dd", "dr", "rd", "rr")]).withColumnRenamed("moment", "xi")


@query("knn_xi_diag", sql(_FOUR + f" SELECT t::INT AS t, iq AS z_bin, round({_LS.format(1)}, 6) AS xi {_JOIN} WHERE iq = jn", "sky_d", "sky_r"))
def knn_xi_diag(spark, d):
    return knn.xi_diag(_xi_of_moments(spark, d)).select("t", "z_bin", *r6("xi"))


def _sky_s(t: int, i: int, j: int) -> tuple[float, float]:
    import math

    import numpy as np

    zs, ds = cosmology.Cosmology().table()
    a, b = ([0.75, 1.5][i], [0.85, 1.6][j])
    across, along = float(np.interp((a + b) / 2, zs, ds)) * math.radians(THETA[t]), cosmology.C_OVER_H100 * (b - a) / float(cosmology.Cosmology().e((a + b) / 2))
    return math.hypot(across, along), along / math.hypot(across, along)


_GEOMETRY = ", ".join(f"({t}, {i}, {j}, {s!r}::DOUBLE, {mu!r}::DOUBLE)" for t in range(3) for i in range(2) for j in range(2) for s, mu in [_sky_s(t, i, j)])


@query("knn_xi_multipole", sql(_FOUR + f""", x AS (SELECT t, iq, jn, {_LS.format(1)} AS xi {_JOIN}), g AS (SELECT * FROM (VALUES {_GEOMETRY}) v(t, iq, jn, s, mu)),
l AS (SELECT xi, {bins_sql('s', [0.0, 400.0, 1200.0, 4000.0])} AS s_bin, 1.5 * mu * mu - 0.5 AS l FROM x JOIN g USING (t, iq, jn)) SELECT s_bin::INT AS s_bin, round(sum(xi * l) / sum(l * l), 6) AS xi FROM l WHERE s_bin IS NOT NULL GROUP BY s_bin""", "sky_d", "sky_r"))
def knn_xi_multipole(spark, d):
    return knn.xi_multipole(_xi_of_moments(spark, d), THETA, [0.75, 1.5], [0.85, 1.6], 2, [0.0, 400.0, 1200.0, 4000.0]).select("s_bin", *r6("xi"))


_CONE = caps_sql("c", "sky_r", "sky_d", False).replace("CASE WHEN red >= 0.5 AND red < 1.0 THEN 0 WHEN red >= 1.0 AND red < 2.0 THEN 1 END AS iq", "0 AS iq")


@query("cone_shell_jackknife", sql(f""", n AS (SELECT *, {bins_sql('red', ZN)} AS jn FROM sky_d), f AS (SELECT DISTINCT region FROM sky_r UNION SELECT NULL),
e AS (SELECT f.region, a.id, t.t, j.jn FROM f, sky_r a, range({len(THETA)}) t(t), range({len(ZN) - 1}) j(jn) WHERE f.region IS NULL OR a.region <> f.region),
m AS (SELECT f.region, a.id, t.t, b.jn, count(*) AS n FROM f, sky_r a, n b, range({len(THETA)}) t(t) WHERE b.jn IS NOT NULL AND (f.region IS NULL OR (a.region <> f.region AND b.region <> f.region))
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= ([{', '.join(repr(chord(t) ** 2) for t in THETA)}])[t.t + 1] GROUP BY ALL),
c AS (SELECT e.*, coalesce(m.n, 0) AS n FROM e LEFT JOIN m ON m.region IS NOT DISTINCT FROM e.region AND m.id = e.id AND m.t = e.t AND m.jn = e.jn)
SELECT t::INT AS t, jn::INT AS jn, region, round(CASE WHEN avg(n) > 0 THEN var_samp(n) / avg(n) ** 2 - 1 / avg(n) END, 6) + 0.0 AS sigma2 FROM c GROUP BY ALL""", "sky_d", "sky_r"))
def cone_shell_jackknife(spark, d):
    return knn.cone_shell_jackknife(view(spark, d, "sky_r"), view(spark, d, "sky_d"), THETA, ZN).select("t", "jn", "region", *r6("sigma2"))


_Z3 = [0.5, 1.0, 1.5, 2.0]
_CONE3 = _CONE.replace(bins_sql("red", ZN), bins_sql("red", _Z3)).replace(f"range({len(ZN) - 1}) j(jn)", "range(3) j(jn)")
_S3 = _CONE3 + ", s AS (SELECT t, jn, CASE WHEN avg(n) > 0 THEN var_samp(n) / avg(n) ** 2 - 1 / avg(n) END AS sigma2 FROM c GROUP BY ALL), y AS (SELECT t, jn, sigma2, CASE WHEN sigma2 > 0 THEN ln(sigma2) END AS y, ln(([1.75, 2.25, 2.75])[jn + 1]) AS x FROM s)"


def _three_shells(spark, d):
    return knn.sigma2_cone_shell(knn.cone_counts(view(spark, d, "sky_r"), view(spark, d, "sky_d"), THETA, _Z3))


@query("knn_log_slope", sql(_S3 + """ SELECT t::INT AS t, jn::INT AS jn, round(CASE jn WHEN 0 THEN (lead(y) OVER o - y) / (lead(x) OVER o - x) WHEN 2 THEN (y - lag(y) OVER o) / (x - lag(x) OVER o)
ELSE (lead(y) OVER o - lag(y) OVER o) / (lead(x) OVER o - lag(x) OVER o) END, 6) + 0.0 AS slope FROM y WINDOW o AS (PARTITION BY t ORDER BY jn)""", "sky_d", "sky_r"))
def knn_log_slope(spark, d):
    return knn.log_slope(_three_shells(spark, d), [0.75, 1.25, 1.75]).select("t", "jn", *r6("slope"))


@query("knn_slope_between", sql(_S3 + """, b AS (SELECT t, jn, (lead(sigma2) OVER o - lag(sigma2) OVER o) / (lead(x) OVER o - lag(x) OVER o) AS slope FROM y WINDOW o AS (PARTITION BY t ORDER BY jn))
SELECT t::INT AS t, jn::INT AS jn, round(slope, 6) + 0.0 AS slope FROM b WHERE jn = 1""", "sky_d", "sky_r"))
def knn_slope_between(spark, d):
    return knn.slope_between(_three_shells(spark, d), [0.75, 1.25, 1.75]).select("t", "jn", *r6("slope"))


# -- maps and windows -------------------------------------------------------------------


def pixel_sql(n: int) -> str:
    """Ring-order pixel of (ra, u): belt and caps, as functions of phi in quarters of a turn."""
    tt, up, down = "(ra % 360 / 90)", f"floor({n} * (0.5 + ra % 360 / 90) - {n} * u * 0.75)", f"floor({n} * (0.5 + ra % 360 / 90) + {n} * u * 0.75)"
    ring = f"({n} + 1 + {up} - {down})"
    belt = f"{2 * n * (n - 1)} + ({ring} - 1) * {4 * n} + floor(({up} + {down} - {n} + 1 - {ring} % 2 + 1) / 2) % {4 * n}"
    r = f"(floor(({tt} - floor({tt})) * {n} * sqrt(3 * (1 - abs(u)))) + floor((1 - ({tt} - floor({tt}))) * {n} * sqrt(3 * (1 - abs(u)))) + 1)"
    at = f"(floor({tt} * {r}) % (4 * {r}))"
    return f"(CASE WHEN abs(u) <= 2.0 / 3 THEN {belt} WHEN u > 0 THEN 2 * {r} * ({r} - 1) + {at} ELSE {12 * n * n} - 2 * {r} * ({r} + 1) + {at} END)::BIGINT"


def _map_sql(name: str, table: str, n: int) -> str:
    return f", {name} AS (SELECT p.pix, coalesce(c.n, 0)::DOUBLE AS n FROM range({12 * n * n}) p(pix) LEFT JOIN (SELECT {pixel_sql(n)} AS pix, count(*) AS n FROM {table} GROUP BY 1) c USING (pix))"


_COMPLETE = _map_sql("mr", "sky_r", 2) + ", mm AS (SELECT pix, least(1, n / (SELECT quantile_disc(n, 0.5) FROM mr WHERE n > 0)) AS completeness FROM mr)"


@query("pixel_counts", sql(_map_sql("m", "sky_d", 4) + " SELECT pix, n::BIGINT AS n FROM m", "sky_d"))
def pixel_counts(spark, d):
    s = view(spark, d, "sky_d")
    counted = s.groupBy(healpix.pixel(F.col("ra"), F.col("u"), 4).alias("pix")).agg(F.count("*").alias("n"))
    return spark.range(12 * 16).select(F.col("id").alias("pix")).join(counted, "pix", "left").select("pix", F.coalesce("n", F.lit(0)).alias("n"))


@query("completeness_map", sql(_COMPLETE + " SELECT pix, round(completeness, 6) AS completeness FROM mm", "sky_r"))
def completeness_map(spark, d):
    return fields.completeness_map(view(spark, d, "sky_r"), 2).select("pix", *r6("completeness"))


@query("overdensity_map", sql(_COMPLETE + _map_sql("md", "sky_d", 2) + """, j AS (SELECT pix, n, completeness FROM md JOIN mm USING (pix)), a AS (SELECT sum(n) / sum(completeness) AS mean FROM j WHERE completeness >= 0.3)
SELECT pix, round(CASE WHEN completeness >= 0.3 THEN n / (mean * completeness) - 1 ELSE 0 END, 6) + 0.0 AS delta FROM j, a""", "sky_d", "sky_r"))
def overdensity_map(spark, d):
    return fields.overdensity_map(view(spark, d, "sky_d"), fields.completeness_map(view(spark, d, "sky_r"), 2), 2, 0.3).select("pix", *r6("delta"))


def centres_sql(name: str, n: int) -> str:
    """CTE of pixel middles as unit vectors: rings of four times their number of pixels in the caps, of 4 n between them."""
    rings = ", ".join(f"({i})" for i in range(1, 4 * n))
    count = f"CASE WHEN i < {n} THEN 4 * i WHEN i > {3 * n} THEN 4 * ({4 * n} - i) ELSE {4 * n} END"
    height = f"CASE WHEN i < {n} THEN 1 - i * i / {3.0 * n * n} WHEN i > {3 * n} THEN ({4 * n} - i) * ({4 * n} - i) / {3.0 * n * n} - 1 ELSE ({2 * n} - i) * 2 / {3.0 * n} END"
    shift = f"CASE WHEN i >= {n} AND i <= {3 * n} AND (i + {n}) % 2 = 1 THEN 0 ELSE 0.5 END"
    return f""", {name}_i AS (SELECT i, {count} AS k, {height} AS u, {shift} AS o FROM (VALUES {rings}) v(i)), {name}_j AS (SELECT *, (sum(k) OVER (ORDER BY i) - k)::BIGINT AS before FROM {name}_i),
{name} AS (SELECT before + j AS pix, (j + o) * 360.0 / k AS ra, u::DOUBLE AS u, cos(radians((j + o) * 360.0 / k)) * sqrt(1 - u * u) AS x, sin(radians((j + o) * 360.0 / k)) * sqrt(1 - u * u) AS y FROM {name}_j, range({4 * n}) r(j) WHERE j < k)"""


_APART = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.u - b.u) ** 2"


@query("cap_centre_grid", sql(_COMPLETE + centres_sql("pm", 2) + centres_sql("pc", 4) + f""", s AS (SELECT pm.*, completeness FROM pm JOIN mm USING (pix)), g AS (SELECT pc.pix AS id, pc.ra, pc.u, pc.x, pc.y, {pixel_sql(2).replace("ra", "pc.ra").replace("abs(u)", "abs(pc.u)")} AS home FROM pc)
SELECT a.id, round(any_value(a.ra), 6) AS ra, round(any_value(a.u), 6) + 0.0 AS u, round(avg(b.completeness), 6) AS covered FROM g a JOIN mm h ON h.pix = a.home AND h.completeness >= 0.5 JOIN s b ON {_APART} <= {chord(25.0) ** 2!r} GROUP BY a.id HAVING min(b.completeness) >= 0.5""", "sky_r"))
def cap_centre_grid(spark, d):
    return fields.cap_centre_grid(fields.completeness_map(view(spark, d, "sky_r"), 2), 2, 4, 25.0).select("id", *r6("ra", "u", "covered"))


@query("mask_correlation", sql(_COMPLETE + centres_sql("pm", 2) + f""", s AS (SELECT pm.*, completeness AS m FROM pm JOIN mm USING (pix)), p AS (SELECT a.m * b.m AS p, {bins_sql(f"({_APART})", [chord(e) ** 2 for e in (0.0, 31.0, 52.0, 74.0)])} AS bin FROM s a, s b)
SELECT bin::INT AS bin, count(*) AS n, round(avg(p), 6) AS xi FROM p WHERE bin IS NOT NULL GROUP BY bin""", "sky_r"))
def mask_correlation(spark, d):
    return survey_window.mask_correlation(fields.completeness_map(view(spark, d, "sky_r"), 2), 2, [0.0, 31.0, 52.0, 74.0]).select("bin", "n", *r6("xi"))


_RANDOM = [(i, j, 40.0 + 7 * i + 3 * j) for i in range(3) for j in range(3)]


@query("wp_analytic_jackknife", sql(pairs_sql("dd", "pts_d", "pts_d", _TOP) + """, l AS (SELECT d.*, x.region AS one, y.region AS two, abs(((b0 - a0) * (a0 + b0) / 2.0 + (b1 - a1) * (a1 + b1) / 2.0 + (b2 - a2) * (a2 + b2) / 2.0)
  / sqrt(((a0 + b0) / 2.0) ** 2 + ((a1 + b1) / 2.0) ** 2 + ((a2 + b2) / 2.0) ** 2)) AS pi FROM dd d JOIN pts_d x ON x.id = i JOIN pts_d y ON y.id = j)""" + f""", c AS (SELECT {bins_sql('sqrt(greatest(0, d2 - pi * pi))', RP)} AS rp_bin, {bins_sql('pi', PI)} AS pi_bin, one, two, count(*) AS n FROM l GROUP BY ALL),
f AS (SELECT region, (SELECT count(*) FROM pts_d) - count(*)::DOUBLE AS nd FROM pts_d GROUP BY region UNION ALL SELECT NULL, count(*) FROM pts_d), r AS (SELECT * FROM (VALUES {", ".join(map(str, _RANDOM))}) v(rp_bin, pi_bin, rr)),
g AS (SELECT region, nd, r.rp_bin, r.pi_bin, rr, coalesce((SELECT sum(n) FROM c WHERE c.rp_bin = r.rp_bin AND c.pi_bin = r.pi_bin AND (region IS NULL OR (one <> region AND two <> region))), 0) AS dd FROM f, r)
SELECT rp_bin::INT AS rp_bin, region, round(2 * sum(2000 * ((dd / (nd * (nd - 1) / 2) - 4 * rr / 1000 / 1000) / (rr / (1000 * 999 / 2)) + 1)), 6) AS wp FROM g GROUP BY rp_bin, region""", "pts_d"))
def wp_analytic_jackknife(spark, d):
    rr = spark.createDataFrame(_RANDOM, "rp_bin int, pi_bin int, rr double")
    return survey_window.wp_analytic(view(spark, d, "pts_d"), rr, 1000.0, RP, PI, region="region").select("rp_bin", "region", *r6("wp"))


@query("rr_analytic")
def rr_analytic(spark, d):
    radial = survey_window.radial_density(view(spark, d, "sky_r").select(F.col("red").alias("z")))
    return survey_window.rr_analytic(fields.completeness_map(view(spark, d, "sky_r"), 4), 4, radial, [50.0, 100.0, 150.0], [0.0, 50.0, 100.0], 1000.0)


@query("distances", sql(f""", g AS (SELECT i, i * 4.0 / 3999 AS z, 1 / sqrt(0.31 * (1 + i * 4.0 / 3999) ** 3 + 0.69) AS f FROM range(4000) t(i)), c AS (SELECT i, coalesce(sum((f + before) / 2) OVER (ORDER BY i), 0) * 4.0 / 3999 * 2997.92458 AS d FROM (SELECT *, lag(f) OVER (ORDER BY i) AS before FROM g)),
s AS (SELECT id, red / (4.0 / 3999) AS place FROM sky_d) SELECT id, round(a.d + (place - floor(place)) * (b.d - a.d), 4) AS chi FROM s JOIN c a ON a.i = floor(place) JOIN c b ON b.i = a.i + 1""", "sky_d"))
def distances(spark, d):
    return cosmology.with_distance(view(spark, d, "sky_d").select("id", "red"), z="red").select("id", (F.round("chi", 4) + 0.0).alias("chi"))

