"""Registered queries over catalogs made from the driver's tables, each with the SQL it is held against.

Catalogs are views in whole numbers, so cells and squared distances are exact in either
engine: ``box`` from lineitem with randoms from orders (no ids), ``pts`` from customer with
randoms from part (ids, regions), ``sky`` from the same two. Fractions are rounded to six
places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import coords, cosmology, healpix
from pointloom.functions.coords import chord
from pointloom.operators import cells, continuous, fields, gradients, graph, knn, neighbours, pairs, vectors, windows
from pointloom.plans import multirun

VIEWS = {
    "box_d": """SELECT (CAST(l_quantity AS BIGINT) * 1285 + l_partkey % 1285) % 65536 AS c0, (l_suppkey * 653 + l_partkey * 31) % 65536 AS c1,
      CAST(floor(l_extendedprice) AS BIGINT) % 65536 AS c2, CAST(1 + l_linenumber % 3 AS DOUBLE) AS w FROM lineitem""",
    "box_r": """SELECT (o_orderkey * 40503) % 65536 AS c0, (o_orderkey * 30011 + o_custkey * 17) % 65536 AS c1, (o_orderkey * 12289 + o_custkey * 77) % 65536 AS c2,
      CAST(1 + o_orderkey % 2 AS DOUBLE) AS w FROM orders""",
    "pts_d": """SELECT c_custkey AS id, (c_custkey * 40503) % 65536 AS c0, (c_custkey * c_custkey * 7 + c_nationkey * 2621) % 65536 AS c1, (c_custkey * 30011) % 65536 AS c2,
      CAST(1 + c_custkey % 3 AS DOUBLE) AS w, CAST(c_nationkey % 5 AS INT) AS region, 0.5 + CAST((c_custkey * 31) % 1500 AS DOUBLE) / 1000 AS z FROM customer""",
    "pts_r": """SELECT p_partkey AS id, (p_partkey * 25033) % 65536 AS c0, (p_partkey * 47041 + p_size * 1237) % 65536 AS c1, (p_partkey * 36151) % 65536 AS c2,
      CAST(1 + p_partkey % 2 AS DOUBLE) AS w, CAST(p_size % 5 AS INT) AS region, 0.5 + CAST((p_partkey * 37) % 1500 AS DOUBLE) / 1000 AS z FROM part""",
    "sky_d0": """SELECT c_custkey AS id, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 AS ra, CAST((c_custkey * 104729) % 20001 AS DOUBLE) / 10000 - 1 AS u,
      0.5 + CAST((c_custkey * 31) % 1500 AS DOUBLE) / 1000 AS red, CAST(c_nationkey % 5 AS INT) AS region, (c_custkey * 2654435761) % 1048576 AS bits FROM customer""",
    "sky_r0": """SELECT p_partkey AS id, CAST((p_partkey * 6007) % 36000 AS DOUBLE) / 100 AS ra, CAST((p_partkey * 86243) % 20001 AS DOUBLE) / 10000 - 1 AS u,
      0.5 + CAST((p_partkey * 37) % 1500 AS DOUBLE) / 1000 AS red, CAST(p_size % 5 AS INT) AS region, (p_partkey * 2654435761) % 1048576 AS bits FROM part""",
    "sky_d": "SELECT *, cos(radians(ra)) * sqrt(1 - u * u) AS x, sin(radians(ra)) * sqrt(1 - u * u) AS y, u AS z FROM sky_d0",
    "sky_r": "SELECT *, cos(radians(ra)) * sqrt(1 - u * u) AS x, sin(radians(ra)) * sqrt(1 - u * u) AS y, u AS z FROM sky_r0",
}
AXES = ["c0", "c1", "c2"]
EDGES = [1000.0, 2000.0, 3500.0, 5000.0, 7000.0]
RP, PI = [500.0, 2000.0, 4000.0, 6000.0], [0.0, 2000.0, 4000.0, 6000.0]
THETA, ZQ, ZN, KMAX = [2.0, 5.0, 10.0], [0.5, 1.0, 2.0], [0.5, 1.2, 2.0], 4
FIELD_LEVELS = [1, 2, 3]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog view as a DataFrame; only the columns it names are read."""
    text = VIEWS[name]
    base = {"lineitem": "l_", "orders": "o_", "customer": "c_", "part": "p_"}
    for table in base:
        if f"FROM {table}" in text:
            return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_columns(text))
    inner = view(spark, sf_dir, text.rpartition("FROM ")[2])
    return inner.selectExpr(*_columns(text))


def _columns(text: str) -> list[str]:
    body, out, depth, start = text.strip().removeprefix("SELECT").rpartition(" FROM ")[0], [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(body[start:i].strip())
            start = i + 1
    return [*out, body[start:].strip()]


def sql(body: str, *names: str) -> str:
    """SQL with the named views in front."""
    need: list[str] = []
    for n in names:
        if n.startswith("sky_"):
            need.append(f"{n}0")
        need.append(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in dict.fromkeys(need)) + body


def r6(*names: str):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]  # no negative zero


def cells_sql(data: str, randoms: str | None, levels: list[int], axes: list[str] = AXES, name: str = "cells") -> str:
    """CTE of cells(): one grouping for each level straight from the points."""
    k = ", ".join(f"{a} >> (16 - level) AS k{i}" for i, a in enumerate(axes))
    pts = f"SELECT {', '.join(axes)}, w, 1 AS d FROM {data}" + (f" UNION ALL SELECT {', '.join(axes)}, w, 0 FROM {randoms}" if randoms else "")
    sums = ", ".join(f"count(*) FILTER (d = {v}) AS n_{c}, coalesce(sum(w) FILTER (d = {v}), 0) AS sw_{c}, coalesce(sum(w * w) FILTER (d = {v}), 0) AS sw2_{c}" for c, v in (("d", 1), ("r", 0)))
    return f", {name} AS (SELECT level, {k}, {sums} FROM ({pts}), (SELECT unnest({levels}) AS level) GROUP BY ALL)"


DELTA_SQL = """, tot AS (SELECT level, sum(sw_d) AS all_d, sum(sw_r) AS all_r, sum(sw_d) / sum(sw_r) AS alpha FROM cells GROUP BY level),
delta AS (SELECT c.*, alpha, all_r, CASE WHEN sw_r > 0 THEN sw_d / (alpha * sw_r) - 1 END AS delta FROM cells c JOIN tot USING (level)),
sums AS (SELECT level, sum(sw_r) FILTER (delta IS NOT NULL) AS t, sum(sw_r * delta) AS s1, sum(sw_r * delta * delta) AS s2, sum(sw_r * delta ** 3) AS s3, sum(sw_r * delta ** 4) AS s4,
  min(delta) AS min_delta, max(delta) AS max_delta, count(delta) AS n_cells, count(*) FILTER (delta IS NULL AND n_d > 0) AS cells_outside,
  coalesce(sum(sw_d) FILTER (delta IS NULL), 0) AS weight_outside FROM delta GROUP BY level),
mom AS (SELECT *, s1 / t AS m1, s2 / t - (s1 / t) ** 2 AS mu2, s3 / t - 3 * (s1 / t) * (s2 / t) + 2 * (s1 / t) ** 3 AS mu3,
  s4 / t - 4 * (s1 / t) * (s3 / t) + 6 * (s1 / t) ** 2 * (s2 / t) - 3 * (s1 / t) ** 4 AS mu4 FROM sums)"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if text:
            _SQL[name] = text
        return f

    return add


# -- cells ------------------------------------------------------------------------------


@query("pair_shells", sql(cells_sql("box_d", None, list(range(9))) + """
, s AS (SELECT level, count(*) AS n_nonempty, sum(n_d * (n_d - 1) // 2)::BIGINT AS cumulative_pairs FROM cells GROUP BY level)
SELECT level, n_nonempty, cumulative_pairs, (cumulative_pairs - lead(cumulative_pairs, 1, 0) OVER (ORDER BY level))::BIGINT AS n_pairs FROM s""", "box_d"))
def pair_shells(spark, d):
    return cells.pair_shells(view(spark, d, "box_d"))


@query("level_counts", sql(cells_sql("box_d", None, list(range(9))) + """
SELECT level, count(*) AS n_nonempty, max(n_d) AS n_max, round(avg(n_d), 6) AS mean_nonempty, round(var_pop(n_d), 6) AS var_nonempty,
  round(sum(n_d) / 8.0 ** level, 6) AS mean_all, round(sum(n_d * n_d) / 8.0 ** level - (sum(n_d) / 8.0 ** level) ** 2, 6) AS var_all FROM cells GROUP BY level""", "box_d"))
def level_counts(spark, d):
    return cells.level_counts(view(spark, d, "box_d")).select("level", "n_nonempty", "n_max", *r6("mean_nonempty", "var_nonempty", "mean_all", "var_all"))


@query("count_histogram", sql(cells_sql("box_d", None, list(range(9))) + " SELECT level, n_d AS n, count(*) AS cells FROM cells GROUP BY ALL", "box_d"))
def count_histogram(spark, d):
    return cells.count_histogram(view(spark, d, "box_d"))


PAIRSTATS = """, ps AS (SELECT level, count(*) FILTER (n_d > 0) AS nonempty_d, count(*) FILTER (n_r > 0) AS nonempty_r, sum((sw_d * sw_d - sw2_d) / 2) AS dd,
  sum((sw_r * sw_r - sw2_r) / 2) AS rr, sum(sw_d * sw_r) AS dr FROM cells GROUP BY level)"""


@query("pair_level_stats", sql(cells_sql("box_d", "box_r", list(range(7))) + PAIRSTATS + " SELECT * FROM ps", "box_d", "box_r"))
def pair_level_stats(spark, d):
    return cells.pair_level_stats(cells.cells(view(spark, d, "box_d"), view(spark, d, "box_r"), levels=range(7)))


XI_SQL = PAIRSTATS + """, sh AS (SELECT level, dd - lead(dd, 1, 0) OVER o AS dd, dr - lead(dr, 1, 0) OVER o AS dr, rr - lead(rr, 1, 0) OVER o AS rr FROM ps WINDOW o AS (ORDER BY level)),
n AS (SELECT sum(sw_d) AS wd, sum(sw2_d) AS wd2, sum(sw_r) AS wr, sum(sw2_r) AS wr2 FROM cells WHERE level = 0),
f AS (SELECT sh.*, n.*, dd / ((wd * wd - wd2) / 2) AS fdd, dr / (wd * wr) AS fdr, rr / ((wr * wr - wr2) / 2) AS frr FROM sh, n)"""


@query("xi_shells", sql(cells_sql("box_d", "box_r", list(range(7))) + XI_SQL + " SELECT level, dd, dr, rr, round(CASE WHEN frr <> 0 THEN (fdd - 2 * fdr + frr) / frr END, 6) AS xi FROM f", "box_d", "box_r"))
def xi_shells(spark, d):
    return cells.xi_shells(view(spark, d, "box_d"), view(spark, d, "box_r"), levels=range(7)).select("level", "dd", "dr", "rr", *r6("xi"))


@query("field_stats", sql(cells_sql("box_d", "box_r", FIELD_LEVELS) + DELTA_SQL + """
SELECT level, t, n_cells, cells_outside, weight_outside, round(min_delta, 6) AS min_delta, round(max_delta, 6) AS max_delta, round(m1, 6) + 0.0 AS mean_delta,
  round(mu2, 6) AS var_delta, round(mu3, 6) AS m3_delta, round(mu4, 6) AS m4_delta, round(mu3 / mu2 ** 2, 6) AS s3_delta FROM mom""", "box_d", "box_r"))
def field_stats(spark, d):
    s = cells.field_stats(view(spark, d, "box_d"), view(spark, d, "box_r"), levels=FIELD_LEVELS)
    return s.select("level", "t", "n_cells", "cells_outside", "weight_outside", *r6("min_delta", "max_delta", "mean_delta", "var_delta", "m3_delta", "m4_delta", "s3_delta"))


@query("field_pdf", sql(cells_sql("box_d", "box_r", FIELD_LEVELS) + DELTA_SQL + """
SELECT level, CASE WHEN sw_d = 0 THEN -1 ELSE least(greatest(floor((log10(1 + delta) + 1) / 2 * 8), -1), 8) END::INT AS bin, count(*) AS cells, sum(sw_r) AS weight
FROM delta WHERE delta IS NOT NULL GROUP BY ALL""", "box_d", "box_r"))
def field_pdf(spark, d):
    return cells.field_pdf(view(spark, d, "box_d"), view(spark, d, "box_r"), -1.0, 1.0, 8, levels=FIELD_LEVELS)


@query("cic_pmf", sql(cells_sql("box_d", None, list(range(5))) + """
, seen AS (SELECT level, n_d AS n, count(*) AS cells FROM cells GROUP BY ALL),
whole AS (SELECT * FROM seen UNION ALL SELECT level, 0, (8 ** level - sum(cells))::BIGINT FROM seen GROUP BY level HAVING sum(cells) < 8 ** level)
SELECT level, n, cells, round(cells / sum(cells) OVER (PARTITION BY level), 6) AS p FROM whole""", "box_d"))
def cic_pmf(spark, d):
    return cells.cic_pmf(view(spark, d, "box_d")).select("level", "n", "cells", *r6("p"))


def haar_sql(levels: list[int]) -> str:
    we = ", ".join(f"sum(CASE WHEN bit_count(((k0 & 1) | ((k1 & 1) << 1) | ((k2 & 1) << 2)) & {e}) % 2 = 0 THEN delta ELSE -delta END) / 8 AS e{e}" for e in range(1, 8))
    rows = " UNION ALL ".join(f"SELECT h.level, h.p0, h.p1, h.p2, {e} AS pattern, e{e} AS we, d.sw_r AS w_p FROM h JOIN delta d ON d.level = h.level AND d.k0 = p0 AND d.k1 = p1 AND d.k2 = p2 WHERE d.delta IS NOT NULL" for e in range(1, 8))
    inside = ", ".join(str(x) for x in levels)
    return f""", h AS (SELECT level - 1 AS level, k0 >> 1 AS p0, k1 >> 1 AS p1, k2 >> 1 AS p2, {we} FROM delta WHERE delta IS NOT NULL AND level - 1 IN ({inside}) GROUP BY 1, 2, 3, 4 HAVING count(*) = 8),
haar AS ({rows})"""


HAAR_LEVELS = [1, 2]
_HAAR = cells_sql("box_d", "box_r", [1, 2, 3]) + DELTA_SQL + haar_sql(HAAR_LEVELS)


@query("haar_anisotropy", sql(_HAAR + " SELECT level, pattern, count(*) AS n_cells, sum(w_p) AS w_total, round(sum(w_p * we * we) / sum(w_p), 6) AS mean_we2 FROM haar GROUP BY ALL", "box_d", "box_r"))
def haar_anisotropy(spark, d):
    return cells.haar_anisotropy(view(spark, d, "box_d"), view(spark, d, "box_r"), levels=HAAR_LEVELS).select("level", "pattern", "n_cells", "w_total", *r6("mean_we2"))


@query("haar_quadrupole", sql(_HAAR + """, q AS (SELECT level, pattern, sum(w_p * we * we) / sum(w_p) AS m FROM haar GROUP BY ALL)
SELECT level, round(max(m) FILTER (pattern = 4) - (max(m) FILTER (pattern = 1) + max(m) FILTER (pattern = 2)) / 2, 6) AS q2 FROM q GROUP BY level""", "box_d", "box_r"))
def haar_quadrupole(spark, d):
    return cells.quadrupole(cells.haar_anisotropy(view(spark, d, "box_d"), view(spark, d, "box_r"), levels=HAAR_LEVELS)).select("level", *r6("q2"))


@query("scattering", sql(cells_sql("box_d", "box_r", [2, 3]) + DELTA_SQL + haar_sql([2]) + """
, first AS (SELECT pattern, p0 >> 0 AS k0, p1 AS k1, p2 AS k2, abs(we) AS m FROM haar WHERE pattern IN (1, 2, 4)),
second AS (SELECT pattern, k0 >> 1 AS q0, k1 >> 1 AS q1, k2 >> 1 AS q2, sum(CASE WHEN k0 % 2 = 0 THEN m ELSE -m END) / 8 AS a0, sum(CASE WHEN k1 % 2 = 0 THEN m ELSE -m END) / 8 AS a1,
  sum(CASE WHEN k2 % 2 = 0 THEN m ELSE -m END) / 8 AS a2 FROM first GROUP BY ALL)
SELECT (CASE pattern WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END)::INT AS axis1, axis2, count(*) AS n_cells, round(avg(abs(CASE axis2 WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END)), 6) AS mean_w2
FROM second, (SELECT unnest([0, 1, 2]) AS axis2) GROUP BY ALL""", "box_d", "box_r"))
def scattering(spark, d):
    return cells.scattering(view(spark, d, "box_d"), view(spark, d, "box_r"), fine=2, coarse=1).select("axis1", "axis2", "n_cells", *r6("mean_w2"))


@query("pair_gradient", sql(" SELECT id, count(*) OVER (PARTITION BY c0 >> 13, c1 >> 13, c2 >> 13) - 1 AS others FROM pts_d", "pts_d"))
def pair_gradient(spark, d):
    return cells.pair_gradient(view(spark, d, "pts_d"), level=3)


@query("grid_counts", sql("""
, c AS (SELECT count(*) AS n FROM box_d GROUP BY c0 * 6 // 65536, c1 * 6 // 65536, c2 * 6 // 65536), m AS (SELECT sum(n) / 216 AS m1, sum(n * n) / 216 AS m2, sum(n ** 3) / 216 AS m3 FROM c),
v AS (SELECT m1, m2 - m1 * m1 AS var, m3 - 3 * m1 * m2 + 2 * m1 ** 3 AS third, (m2 - m1 * m1 - m1) / (m1 * m1) AS v FROM m)
SELECT 216 AS n_cells, round(m1, 6) AS mean, round(v, 6) AS variance, round(CASE WHEN v > 0 THEN (third - 3 * var + 2 * m1) / m1 ** 3 / (v * v) ELSE 0 END, 6) AS s3 FROM v""", "box_d"))
def grid_counts(spark, d):
    return cells.grid_counts(view(spark, d, "box_d"), 6).select("n_cells", *r6("mean", "variance", "s3"))


@query("coordinate_range", sql("""
, b AS (SELECT 'c0' AS axis, bit_or(c0) AS v FROM (SELECT c0 FROM box_d UNION ALL SELECT c0 FROM box_r) UNION ALL SELECT 'c1', bit_or(c1) FROM (SELECT c1 FROM box_d UNION ALL SELECT c1 FROM box_r)
  UNION ALL SELECT 'c2', bit_or(c2) FROM (SELECT c2 FROM box_d UNION ALL SELECT c2 FROM box_r))
SELECT axis, (SELECT min(i) FROM range(40) t(i) WHERE (v >> i) & 1 = 1)::INT AS bit_min, (SELECT max(i) FROM range(40) t(i) WHERE (v >> i) & 1 = 1)::INT AS bit_max FROM b""", "box_d", "box_r"))
def coordinate_range(spark, d):
    return coords.coordinate_range(view(spark, d, "box_d"), AXES, view(spark, d, "box_r"))


# -- windows ----------------------------------------------------------------------------

_GRID = """, g AS (SELECT i AS k0, j AS k1, coalesce(n, 0) AS n FROM range(16) a(i), range(16) b(j) LEFT JOIN (SELECT c0 >> 12 AS x, c1 >> 12 AS y, count(*) AS n FROM box_d GROUP BY ALL) ON x = i AND y = j),
wide AS (SELECT a.k0, a.k1, width, sum(b.n) AS n FROM g a, (SELECT unnest([1, 2, 4, 8, 16]) AS width), g b WHERE (b.k0 - a.k0 + 16) % 16 < width AND (b.k1 - a.k1 + 16) % 16 < width GROUP BY ALL)"""


@query("window_pmf", sql(_GRID + " SELECT width::INT AS width, n::BIGINT AS n, count(*) AS windows FROM wide GROUP BY ALL", "box_d"))
def window_pmf(spark, d):
    return windows.window_pmf(view(spark, d, "box_d"), 4, [1, 2, 4, 8, 16], ["c0", "c1"])


@query("window_moments", sql(_GRID + """, m AS (SELECT width, avg(n) AS m1, avg(n ** 2) AS m2, avg(n ** 3) AS m3, avg(n ** 4) AS m4 FROM wide GROUP BY width)
SELECT width::INT AS width, 256 AS windows, round(m1, 6) AS mean, round(m2 - m1 * m1, 6) AS var FROM m""", "box_d"))
def window_moments(spark, d):
    m = windows.pmf_moments(windows.window_pmf(view(spark, d, "box_d"), 4, [1, 2, 4, 8, 16], ["c0", "c1"]))
    return m.select("width", "windows", *r6("mean", "var"))


@query("shift_levels", sql(_GRID + """, m AS (SELECT (4 - log2(width))::INT AS level, avg(n) AS mean, avg(n ** 2) - avg(n) ** 2 AS var FROM wide GROUP BY width)
SELECT level, round(mean, 6) AS mean, round(var, 6) AS var, round(coalesce(var - (lead(var) OVER (ORDER BY level) - var / 16), var), 6) AS dvar FROM m""", "box_d"))
def shift_levels(spark, d):
    return windows.shift_levels(view(spark, d, "box_d"), 4, ["c0", "c1"]).select("level", *r6("mean", "var", "dvar"))


@query("cell_correlation", sql(_GRID + """
SELECT lag::INT AS lag, round(sum(a.n * (b.n + c.n)) / 512 / (SELECT avg(n) FROM g) ** 2 - 1, 6) AS xi FROM g a, (SELECT unnest([1, 2, 4]) AS lag) l, g b, g c
WHERE b.k0 = (a.k0 + lag) % 16 AND b.k1 = a.k1 AND c.k0 = a.k0 AND c.k1 = (a.k1 + lag) % 16 GROUP BY lag""", "box_d"))
def cell_correlation(spark, d):
    return windows.cell_correlation(view(spark, d, "box_d"), 4, [1, 2, 4], ["c0", "c1"]).select("lag", *r6("xi"))


# -- pairs ------------------------------------------------------------------------------


def bins_sql(value: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a} AND {value} < {b} THEN {i}" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))) + " END"


D2 = "((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2))"


def pairs_sql(name: str, a: str, b: str, top: float = EDGES[-1], edges: list[float] = EDGES) -> str:
    auto = " AND a.id < b.id" if a == b else ""
    return f", {name} AS (SELECT a.id AS i, b.id AS j, a.w AS wi, b.w AS wj, a.c0 AS a0, a.c1 AS a1, a.c2 AS a2, b.c0 AS b0, b.c1 AS b1, b.c2 AS b2, {D2} AS d2, {bins_sql(D2, [e * e for e in edges])} AS bin FROM {a} a, {b} b WHERE {D2} > 0 AND {D2} < {top * top}{auto})"


_ALL = pairs_sql("dd", "pts_d", "pts_d") + pairs_sql("dr", "pts_d", "pts_r") + pairs_sql("rr", "pts_r", "pts_r")


@query("pair_histogram", sql(pairs_sql("dd", "pts_d", "pts_d") + f""" SELECT b.bin::INT AS bin, (2 * count(dd.bin))::BIGINT AS npairs, coalesce(2 * sum(wi * wj), 0)::DOUBLE AS wpairs
FROM range({len(EDGES) - 1}) b(bin) LEFT JOIN dd ON dd.bin = b.bin GROUP BY ALL""", "pts_d"))
def pair_histogram(spark, d):
    return pairs.pair_histogram(view(spark, d, "pts_d"), None, EDGES)


_EST = f""", est AS (SELECT b.bin, (SELECT 2 * count(*) FROM dd WHERE dd.bin = b.bin) AS dd, (SELECT count(*) FROM dr WHERE dr.bin = b.bin) AS dr, (SELECT 2 * count(*) FROM rr WHERE rr.bin = b.bin) AS rr,
  (SELECT count(*) FROM pts_d)::DOUBLE AS nd, (SELECT count(*) FROM pts_r)::DOUBLE AS nr FROM range({len(EDGES) - 1}) b(bin)),
ls AS (SELECT *, CASE WHEN rr > 0 THEN (dd / nd / nd - 2 * dr / nd / nr + rr / nr / nr) / (rr / nr / nr) ELSE 0 END AS xi_ls FROM est)"""


@query("xi_estimators", sql(_ALL + _EST + """ SELECT bin::INT AS bin, dd, dr, rr, round(CASE WHEN rr > 0 THEN dd / nd / nd / (rr / nr / nr) - 1 ELSE 0 END, 6) AS xi_simple,
round(dd * nr / (dr * nd) - 1, 6) AS xi_dp, round(xi_ls, 6) AS xi_ls, round(dd * rr / (dr::DOUBLE * dr) - 1, 6) AS xi_hamilton FROM ls""", "pts_d", "pts_r"))
def xi_estimators(spark, d):
    x = pairs.xi_estimators(view(spark, d, "pts_d"), view(spark, d, "pts_r"), EDGES)
    return x.select("bin", "dd", "dr", "rr", *r6("xi_simple", "xi_dp", "xi_ls", "xi_hamilton"))


@query("per_point_counts", sql(pairs_sql("dd", "pts_d", "pts_d") + " SELECT id, bin::INT AS bin, count(*) AS n FROM (SELECT i AS id, bin FROM dd WHERE bin IS NOT NULL UNION ALL SELECT j, bin FROM dd WHERE bin IS NOT NULL) GROUP BY ALL", "pts_d"))
def per_point_counts(spark, d):
    return pairs.per_point_counts(view(spark, d, "pts_d"), None, EDGES)


@query("lisa_weights", sql(_ALL + _EST + """
, a0 AS (SELECT bin, rr, CASE WHEN xi_ls > 0 THEN rr * abs(xi_ls) ELSE 0 END AS a FROM ls), a AS (SELECT bin, CASE WHEN (SELECT sum(a) FROM a0) = 0 THEN rr ELSE a END AS a FROM a0),
bd AS (SELECT id, sum(a) AS s FROM (SELECT i AS id, bin FROM dd UNION ALL SELECT j, bin FROM dd) JOIN a USING (bin) GROUP BY id), br AS (SELECT i AS id, sum(a) AS s FROM dr JOIN a USING (bin) GROUP BY i),
x AS (SELECT p.id, CASE WHEN br.s <> 0 THEN (SELECT count(*) FROM pts_r) * coalesce(bd.s, 0) / ((SELECT count(*) FROM pts_d) * br.s) - 1 ELSE 0 END AS delta FROM pts_d p LEFT JOIN bd USING (id) LEFT JOIN br USING (id))
SELECT id, round(delta, 6) AS delta, round(1 + delta, 6) AS weight FROM x""", "pts_d", "pts_r"))
def lisa_weights(spark, d):
    return pairs.lisa_weights(view(spark, d, "pts_d"), view(spark, d, "pts_r"), EDGES).select("id", *r6("delta", "weight"))


def _rp_sql(name: str, src: str) -> str:
    m = [f"(a{k} + b{k}) / 2.0" for k in range(3)]
    dot = " + ".join(f"(b{k} - a{k}) * {m[k]}" for k in range(3))
    norm = "sqrt(" + " + ".join(f"{x} * {x}" for x in m) + ")"
    return f", {name}_l AS (SELECT *, abs(({dot}) / {norm}) AS pi FROM {src}), {name} AS (SELECT {bins_sql('sqrt(greatest(0, d2 - pi * pi))', RP)} AS rp_bin, {bins_sql('pi', PI)} AS pi_bin, count(*) AS n FROM {name}_l GROUP BY ALL)"


_TOP = (RP[-1] ** 2 + PI[-1] ** 2) ** 0.5
_RP = "".join(pairs_sql(n, a, b, _TOP) for n, a, b in (("dd", "pts_d", "pts_d"), ("dr", "pts_d", "pts_r"), ("rr", "pts_r", "pts_r"))) + "".join(_rp_sql(f"{n}2", n) for n in ("dd", "dr", "rr")) + """
, grid AS (SELECT i AS rp_bin, j AS pi_bin, coalesce(dd2.n, 0)::DOUBLE AS dd, coalesce(dr2.n, 0)::DOUBLE AS dr, coalesce(rr2.n, 0)::DOUBLE AS rr, (SELECT count(*) FROM pts_d)::DOUBLE AS nd, (SELECT count(*) FROM pts_r)::DOUBLE AS nr
  FROM range(3) x(i) CROSS JOIN range(3) y(j) LEFT JOIN dd2 ON dd2.rp_bin = i AND dd2.pi_bin = j LEFT JOIN dr2 ON dr2.rp_bin = i AND dr2.pi_bin = j LEFT JOIN rr2 ON rr2.rp_bin = i AND rr2.pi_bin = j),
xi AS (SELECT *, CASE WHEN rr > 0 THEN (dd / (nd * (nd - 1) / 2) - 2 * dr / (nd * nr) + rr / (nr * (nr - 1) / 2)) / (rr / (nr * (nr - 1) / 2)) ELSE 0 END AS xi FROM grid)"""


@query("xi_rp_pi", sql(_RP + " SELECT rp_bin::INT AS rp_bin, pi_bin::INT AS pi_bin, dd, dr, rr, round(xi, 6) AS xi FROM xi", "pts_d", "pts_r"))
def xi_rp_pi(spark, d):
    return pairs.xi_rp_pi(view(spark, d, "pts_d"), view(spark, d, "pts_r"), RP, PI).select("rp_bin", "pi_bin", "dd", "dr", "rr", *r6("xi"))


@query("wp", sql(_RP + " SELECT rp_bin::INT AS rp_bin, round(2 * sum(xi * 2000), 6) AS wp FROM xi GROUP BY rp_bin", "pts_d", "pts_r"))
def wp(spark, d):
    return pairs.wp(pairs.xi_rp_pi(view(spark, d, "pts_d"), view(spark, d, "pts_r"), RP, PI), PI).select("rp_bin", *r6("wp"))


@query("neighbour_density", sql("""
, p AS (SELECT a.id, count(*) AS n FROM pts_d a, pts_r b WHERE a.id <> b.id AND least(abs(a.c0 - b.c0), 65536 - abs(a.c0 - b.c0)) ** 2 + least(abs(a.c1 - b.c1), 65536 - abs(a.c1 - b.c1)) ** 2
  + least(abs(a.c2 - b.c2), 65536 - abs(a.c2 - b.c2)) ** 2 < 9000.0 * 9000 GROUP BY a.id) SELECT a.id, coalesce(n, 0) AS n FROM pts_d a LEFT JOIN p USING (id)""", "pts_d", "pts_r"))
def neighbour_density(spark, d):
    return pairs.neighbour_density(view(spark, d, "pts_d"), view(spark, d, "pts_r"), 9000.0, box=65536.0).select("id", "n")


@query("triangles", sql(f"""
, e AS (SELECT a.id AS i, b.id AS j FROM pts_d a, pts_d b WHERE a.id < b.id AND {D2} BETWEEN 36000000 AND 100000000),
t AS (SELECT x.i, x.j, y.j AS k FROM e x, e y, e z WHERE x.j = y.i AND z.i = x.i AND z.j = y.j)
SELECT id, count(*) AS n FROM (SELECT unnest([i, j, k]) AS id FROM t) GROUP BY id""", "pts_d"))
def triangles(spark, d):
    return pairs.triangles(view(spark, d, "pts_d"), 8000.0, 2000.0)


@query("pair_tensor", sql(pairs_sql("dd", "pts_d", "pts_d") + """
, e AS (SELECT i AS id, * FROM dd WHERE bin IS NOT NULL UNION ALL SELECT j, * FROM dd WHERE bin IS NOT NULL)
SELECT id, bin::INT AS bin, count(*) AS n, round(sum((b0 - a0) * (b0 - a0) / d2), 6) AS txx, round(sum((b0 - a0) * (b1 - a1) / d2), 6) AS txy FROM e GROUP BY ALL""", "pts_d"))
def pair_tensor(spark, d):
    return pairs.pair_tensor(view(spark, d, "pts_d"), EDGES).select("id", "bin", "n", *r6("txx", "txy"))


@query("pair_quadrupole", sql(pairs_sql("dd", "pts_d", "pts_d") + """
, e AS (SELECT i AS id, * FROM dd WHERE bin IS NOT NULL UNION ALL SELECT j, * FROM dd WHERE bin IS NOT NULL)
SELECT id, count(*) AS n, round(sum(1.5 * (b2 - a2) * (b2 - a2) / d2 - 0.5), 6) AS sum_p FROM e GROUP BY ALL""", "pts_d"))
def pair_quadrupole(spark, d):
    return pairs.multipole_sums(view(spark, d, "pts_d"), EDGES, 2).select("id", "n", *r6("sum_p"))


@query("ap_histogram", sql(pairs_sql("dd", "pts_d", "pts_d", EDGES[-1] / 0.9) + f"""
, s AS (SELECT wi * wj AS p, sqrt(1.21 * (b2 - a2) * (b2 - a2) + 0.81 * (d2 - (b2 - a2) * (b2 - a2))) AS s FROM dd)
SELECT {bins_sql('s', EDGES)} AS bin, 2 * sum(p) AS wpairs FROM s WHERE s >= {EDGES[0]} AND s < {EDGES[-1]} GROUP BY ALL""", "pts_d"))
def ap_histogram(spark, d):
    return pairs.ap_histogram(view(spark, d, "pts_d"), None, EDGES, 1.1, 0.9)


def _kernel_sql(name: str, a: str, b: str, r: float) -> str:
    return f", {name} AS (SELECT a.id, sum((1 - 0.75 * sqrt({D2}) / {r} + (sqrt({D2}) / {r}) ** 3 / 16) * 3 / (4 * pi() * {r} ** 3)) AS s FROM {a} a, {b} b WHERE {D2} < {4 * r * r}{' AND a.id <> b.id' if a == b else ''} GROUP BY a.id)"


@query("density_weights", sql(_kernel_sql("kd", "pts_d", "pts_d", 5000.0) + _kernel_sql("kr", "pts_d", "pts_r", 5000.0) + """
SELECT p.id, round(coalesce(CASE WHEN kr.s <> 0 THEN coalesce(kd.s, 0) * (SELECT count(*) FROM pts_r) / (kr.s * (SELECT count(*) FROM pts_d)) END, 1), 6) AS weight FROM pts_d p LEFT JOIN kd USING (id) LEFT JOIN kr USING (id)""", "pts_d", "pts_r"))
def density_weights(spark, d):
    return pairs.density_weights(view(spark, d, "pts_d"), view(spark, d, "pts_r"), 5000.0).select("id", *r6("weight"))


@query("embedding_neighbours", """
SELECT a.vec_id AS id, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
AND list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) < 1.69 GROUP BY a.vec_id""")
def embedding_neighbours(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.near_counts(e, e, 1.69, "embedding", same=True)


# -- neighbour counts on the sky ---------------------------------------------------------


def caps_sql(name: str, q: str, n: str, same: bool) -> str:
    near = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
    tops = ", ".join(repr(chord(t) ** 2) for t in THETA)
    return f""", {name}_q AS (SELECT *, {bins_sql('red', ZQ)} AS iq FROM {q}), {name}_n AS (SELECT *, {bins_sql('red', ZN)} AS jn FROM {n}),
{name}_e AS (SELECT a.id, a.iq, a.region, t.t, j.jn FROM {name}_q a, range({len(THETA)}) t(t), range({len(ZN) - 1}) j(jn) WHERE a.iq IS NOT NULL),
{name}_c AS (SELECT a.id, b.jn, t.t, count(*) AS n FROM {name}_q a, {name}_n b, range({len(THETA)}) t(t) WHERE a.iq IS NOT NULL AND b.jn IS NOT NULL AND {near} <= ([{tops}])[t.t + 1]{' AND a.id <> b.id' if same else ''} GROUP BY ALL),
{name} AS (SELECT e.*, coalesce(c.n, 0) AS n FROM {name}_e e LEFT JOIN {name}_c c USING (id, t, jn)),
{name}_m AS (SELECT t, iq, jn, count(*) AS n_q, sum(n)::DOUBLE AS s1, sum(n ** 2)::DOUBLE AS s2, sum(n ** 3)::DOUBLE AS s3, sum(n ** 4)::DOUBLE AS s4 FROM {name} GROUP BY ALL)"""


def _counts(spark, d, which: str) -> DataFrame:
    q, n = (view(spark, d, f"sky_{c}") for c in which)
    return knn.cap_counts(q, n, THETA, ZQ, ZN, which[0] == which[1], region="region")


@query("knn_moments", sql(caps_sql("c", "sky_d", "sky_d", True) + " SELECT t::INT AS t, iq, jn::INT AS jn, n_q, s1, s2, s3, s4 FROM c_m", "sky_d"))
def knn_moments(spark, d):
    return knn.knn_moments(_counts(spark, d, "dd"))


@query("knn_ladder", sql(caps_sql("c", "sky_d", "sky_d", True) + f" SELECT t::INT AS t, iq, jn::INT AS jn, k::INT AS k, count(*) FILTER (n >= k) AS h FROM c, range(1, {KMAX + 1}) k(k) GROUP BY ALL", "sky_d"))
def knn_ladder(spark, d):
    return knn.knn_ladder(_counts(spark, d, "dd"), KMAX)


@query("knn_cross_dr", sql(caps_sql("c", "sky_d", "sky_r", False) + " SELECT t::INT AS t, iq, jn::INT AS jn, n_q, s1, s2 FROM c_m", "sky_d", "sky_r"))
def knn_cross_dr(spark, d):
    return knn.knn_moments(_counts(spark, d, "dr")).select("t", "iq", "jn", "n_q", "s1", "s2")


@query("count_pmf", sql(caps_sql("c", "sky_d", "sky_d", True) + f" SELECT t::INT AS t, iq, jn::INT AS jn, k::INT AS k, round(avg((least(n, {KMAX}) = k)::INT), 6) AS p FROM c, range({KMAX + 1}) k(k) GROUP BY ALL", "sky_d"))
def count_pmf(spark, d):
    c = _counts(spark, d, "dd")
    return knn.count_pmf(knn.knn_ladder(c, KMAX), knn.knn_moments(c)).select("t", "iq", "jn", "k", *r6("p"))


@query("sigma2_clust", sql(caps_sql("c", "sky_d", "sky_d", True) + " SELECT t::INT AS t, iq, jn::INT AS jn, round(CASE WHEN s1 > 0 THEN (s2 / n_q - (s1 / n_q) ** 2) / (s1 / n_q) ** 2 - n_q / s1 END, 6) AS sigma2 FROM c_m", "sky_d"))
def sigma2_clust(spark, d):
    return knn.sigma2_clust(knn.knn_moments(_counts(spark, d, "dd"))).select("t", "iq", "jn", *r6("sigma2"))


@query("knn_shape", sql(caps_sql("c", "sky_d", "sky_d", True) + """, m AS (SELECT t, iq, jn, s1 / n_q AS m1, s2 / n_q AS m2, s3 / n_q AS m3, s4 / n_q AS m4 FROM c_m), v AS (SELECT *, m2 - m1 * m1 AS var FROM m)
SELECT t::INT AS t, iq, jn::INT AS jn, round(CASE WHEN var > 0 THEN (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / var ** 1.5 END, 6) AS skewness, round(CASE WHEN var > 0 THEN (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / (var * var) - 3 END, 6) AS kurtosis FROM v""", "sky_d"))
def knn_shape(spark, d):
    return knn.shape(knn.knn_moments(_counts(spark, d, "dd"))).select("t", "iq", "jn", *r6("skewness", "kurtosis"))


def _mean(spark, d, which: str) -> DataFrame:
    return knn.cap_means(knn.knn_moments(_counts(spark, d, which)), knn.shell_sizes(view(spark, d, f"sky_{which[1]}"), ZN), which)


def _mean_sql(which: str) -> str:
    n = f"sky_{which[1]}"
    return caps_sql(which, f"sky_{which[0]}", n, which[0] == which[1]) + f", {which}_s AS (SELECT {bins_sql('red', ZN)} AS jn, count(*) AS size FROM {n} GROUP BY 1), {which}_v AS (SELECT t, iq, m.jn, s1 / n_q / size AS v FROM {which}_m m JOIN {which}_s s ON m.jn = s.jn)"


@query("knn_xi_ls", sql(_mean_sql("dd") + _mean_sql("dr") + _mean_sql("rr") + " SELECT t::INT AS t, iq, jn::INT AS jn, round(CASE WHEN rr_v.v <> 0 THEN (dd_v.v - 2 * dr_v.v + rr_v.v) / rr_v.v END, 6) AS xi FROM dd_v JOIN dr_v USING (t, iq, jn) JOIN rr_v USING (t, iq, jn)", "sky_d", "sky_r"))
def knn_xi_ls(spark, d):
    return knn.xi_ls(_mean(spark, d, "dd"), _mean(spark, d, "dr"), _mean(spark, d, "rr")).select("t", "iq", "jn", *r6("xi"))


@query("knn_xi_annular", sql(_mean_sql("dd") + _mean_sql("dr") + _mean_sql("rr") + "".join(f", {x}_a AS (SELECT t, iq, jn, v - lag(v, 1, 0) OVER (PARTITION BY iq, jn ORDER BY t) AS v FROM {x}_v)" for x in ("dd", "dr", "rr"))
       + " SELECT t::INT AS t, iq, jn::INT AS jn, round(CASE WHEN rr_a.v <> 0 THEN (dd_a.v - 2 * dr_a.v + rr_a.v) / rr_a.v END, 6) AS xi FROM dd_a JOIN dr_a USING (t, iq, jn) JOIN rr_a USING (t, iq, jn)", "sky_d", "sky_r"))
def knn_xi_annular(spark, d):
    return knn.xi_ls(*[knn.annular(_mean(spark, d, x), x) for x in ("dd", "dr", "rr")]).select("t", "iq", "jn", *r6("xi"))


@query("knn_hamilton", sql("".join(_mean_sql(x) for x in ("dd", "dr", "rd", "rr")) + " SELECT t::INT AS t, iq, jn::INT AS jn, round(dd_v.v * rr_v.v / nullif(dr_v.v * rd_v.v, 0) - 1, 6) AS xi FROM dd_v JOIN dr_v USING (t, iq, jn) JOIN rd_v USING (t, iq, jn) JOIN rr_v USING (t, iq, jn)", "sky_d", "sky_r"))
def knn_hamilton(spark, d):
    return knn.xi_hamilton(*[_mean(spark, d, x) for x in ("dd", "dr", "rd", "rr")]).select("t", "iq", "jn", *r6("xi"))


@query("first_moment", sql(caps_sql("c", "sky_d", "sky_d", True) + " SELECT t::INT AS t, iq, round(sum(s1 * (([0.85, 1.6])[jn + 1] - ([0.75, 1.5])[iq + 1])) / nullif(sum(s1), 0), 6) AS shift FROM c_m GROUP BY t, iq", "sky_d"))
def first_moment(spark, d):
    return knn.first_moment(knn.knn_moments(_counts(spark, d, "dd")), ZQ, ZN).select("t", "iq", *r6("shift"))


@query("jackknife_cov", sql(caps_sql("c", "sky_d", "sky_d", True) + """
, f AS (SELECT t, r.region, sum(n)::DOUBLE / count(*) AS v FROM c, (SELECT DISTINCT region FROM c) r WHERE c.region <> r.region AND iq = 0 AND jn = 0 GROUP BY ALL), d AS (SELECT t, region, v - avg(v) OVER (PARTITION BY t) AS d FROM f)
SELECT x.t::INT AS a, y.t::INT AS b, count(*) AS folds, round(sum(x.d * y.d) * (count(*) - 1) / count(*), 6) AS cov FROM d x JOIN d y USING (region) GROUP BY ALL""", "sky_d"))
def jackknife_cov(spark, d):
    m = knn.knn_moments(_counts(spark, d, "dd"), "region")
    left = knn.jackknife(m.where("iq = 0 and jn = 0"), ["n_q", "s1"])
    return knn.jackknife_cov(left.select(F.col("t").alias("bin"), "region", (F.col("s1") / F.col("n_q")).alias("value"))).select("a", "b", "folds", *r6("cov"))


@query("pip_counts", sql(f"""
, q AS (SELECT *, {bins_sql('red', ZQ)} AS iq, {bins_sql('red', ZN)} AS jn FROM sky_d),
p AS (SELECT a.id, a.iq, b.jn, t.t, sum(20.0 / bit_count(a.bits & b.bits)) AS n FROM q a, q b, range({len(THETA)}) t(t) WHERE a.id <> b.id AND a.iq IS NOT NULL AND b.jn IS NOT NULL AND (a.bits & b.bits) <> 0
  AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= ([{', '.join(repr(chord(t) ** 2) for t in THETA)}])[t.t + 1] GROUP BY ALL)
SELECT t::INT AS t, iq, jn, round(sum(n), 6) AS s1, round(sum(n * n), 6) AS s2 FROM (SELECT a.id, a.iq, a.jn, t.t, coalesce(p.n, 0) AS n FROM (SELECT DISTINCT id, iq, jn FROM p) a, range({len(THETA)}) t(t) LEFT JOIN p ON p.id = a.id AND p.jn = a.jn AND p.t = t.t) GROUP BY ALL""", "sky_d"))
def pip_counts(spark, d):
    s = view(spark, d, "sky_d").withColumn("bits", F.array("bits"))
    return knn.pip_counts(s, THETA, ZQ, ZN, 20).select("t", "iq", "jn", *r6("s1", "s2"))


@query("cone_shell", sql(caps_sql("c", "sky_r", "sky_d", False).replace("CASE WHEN red >= 0.5 AND red < 1.0 THEN 0 WHEN red >= 1.0 AND red < 2.0 THEN 1 END AS iq", "0 AS iq") + """
SELECT t::INT AS t, jn::INT AS jn, round(CASE WHEN avg(n) > 0 THEN var_samp(n) / avg(n) ** 2 - 1 / avg(n) END, 6) AS sigma2 FROM c GROUP BY ALL""", "sky_d", "sky_r"))
def cone_shell(spark, d):
    return knn.sigma2_cone_shell(knn.cone_counts(view(spark, d, "sky_r"), view(spark, d, "sky_d"), THETA, ZN)).select("t", "jn", *r6("sigma2"))


# -- gradients --------------------------------------------------------------------------

GRAD_LEVELS = [1, 2]
_GRAD = cells_sql("pts_d", "pts_r", GRAD_LEVELS) + DELTA_SQL + """
, cg AS (SELECT c.*, m1, mu2, mu3, mu4, t FROM delta c JOIN mom USING (level)),
mem AS (SELECT id, level, c0 >> (16 - level) AS k0, c1 >> (16 - level) AS k1, c2 >> (16 - level) AS k2 FROM pts_d, (SELECT unnest([1, 2]) AS level))"""


def _grad_sql(k: int) -> str:
    low = {2: "0.0", 3: "mu2", 4: "mu3"}[k]
    return f"(CASE WHEN delta IS NOT NULL THEN {k} * ((delta - m1) ** {k - 1} - {low}) ELSE 0 END / (alpha * t) - {k} * mu{k} / (alpha * all_r))"


def _grad_query(name: str, value: str):
    @query(f"gradient_{name}", sql(_GRAD + f" SELECT id, level, round(1000 * {value}, 6) AS value FROM mem JOIN cg USING (level, k0, k1, k2)", "pts_d", "pts_r"))
    def run(spark, d):
        g = gradients.field_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), name, levels=GRAD_LEVELS)
        return g.select("id", "level", F.round(1000 * F.col("value"), 6).alias("value"))


_grad_query("var", _grad_sql(2))
_grad_query("m3", _grad_sql(3))
_grad_query("m4", _grad_sql(4))
_grad_query("s3", f"({_grad_sql(3)} / mu2 ** 2 - 2 * mu3 * {_grad_sql(2)} / mu2 ** 3)")


@query("gradient_xi", sql(cells_sql("pts_d", "pts_r", [0, 1, 2, 3]) + XI_SQL + """
, mem AS (SELECT id, w, level, sw_d - w AS same, sw_r FROM pts_d JOIN cells ON k0 = c0 >> (16 - level) AND k1 = c1 >> (16 - level) AND k2 = c2 >> (16 - level)),
g AS (SELECT id, w, level, same - coalesce(lead(same) OVER o, 0) AS gs, sw_r - lead(sw_r, 1, 0) OVER o AS gx FROM mem WINDOW o AS (PARTITION BY id ORDER BY level))
SELECT id, level, round(1000 * coalesce((gs / ((wd * wd - wd2) / 2) - fdd * (wd - w) / ((wd * wd - wd2) / 2) - 2 * (gx / (wd * wr) - fdr / wd)) / nullif(frr, 0), 0), 6) AS value FROM g JOIN f USING (level)""", "pts_d", "pts_r"))
def gradient_xi(spark, d):
    g = gradients.xi_gradient(view(spark, d, "pts_d"), view(spark, d, "pts_r"), levels=range(4))
    return g.select("id", "level", F.round(1000 * F.col("value"), 6).alias("value"))


@query("jvp_var", sql(_GRAD + f" SELECT level, round(sum({_grad_sql(2)} * (id % 7)), 6) AS jvp FROM mem JOIN cg USING (level, k0, k1, k2) GROUP BY level", "pts_d", "pts_r"))
def jvp_var(spark, d):
    p = view(spark, d, "pts_d")
    g = gradients.field_gradient(p, view(spark, d, "pts_r"), "var", levels=GRAD_LEVELS)
    return gradients.jvp(g, p.select("id", (F.col("id") % 7).cast("double").alias("v"))).select("level", *r6("jvp"))


# -- run plans --------------------------------------------------------------------------


@query("run_coverage", sql("""
, runs AS (SELECT 'a' AS run, 1.0 AS scale, 0.5 AS o UNION ALL SELECT 'b', 0.5, 0.25), m AS (SELECT run, scale, w, (c0 - o * 65536 + 65536) % 65536 AS x, (c1 - o * 65536 + 65536) % 65536 AS y, (c2 - o * 65536 + 65536) % 65536 AS z FROM box_r, runs)
SELECT run, round(sum(w) FILTER (x < scale * 65536 AND y < scale * 65536 AND z < scale * 65536) / sum(w), 6) AS coverage FROM m GROUP BY run""", "box_r"))
def run_coverage(spark, d):
    runs = multirun.plan(spark, [("a", 1.0, 0.5, 0.5, 0.5), ("b", 0.5, 0.25, 0.25, 0.25)])
    return multirun.coverage(view(spark, d, "box_r"), runs).select("run", *r6("coverage"))


# -- maps, graphs, continuous estimators -------------------------------------------------


@query("paired_windows", sql("""
, g AS (SELECT i AS k0, j AS k1, coalesce(sd, 0) AS sd, coalesce(sr, 0) AS sr FROM range(16) a(i) CROSS JOIN range(16) b(j) LEFT JOIN (SELECT c0 >> 12 AS x, c1 >> 12 AS y, sum(w) AS sd FROM box_d GROUP BY ALL) ON x = i AND y = j
  LEFT JOIN (SELECT c0 >> 12 AS u, c1 >> 12 AS v, sum(w) AS sr FROM box_r GROUP BY ALL) ON u = i AND v = j),
wide AS (SELECT a.k0, a.k1, width, sum(b.sd) AS sd, sum(b.sr) AS sr FROM g a, (SELECT unnest([2, 3]) AS width), g b WHERE (b.k0 - a.k0 + 16) % 16 < width AND (b.k1 - a.k1 + 16) % 16 < width GROUP BY ALL),
x AS (SELECT width, sr, sd / ((SELECT sum(sd) / sum(sr) FROM g) * sr) - 1 AS delta FROM wide WHERE sr > 0)
SELECT width::INT AS width, sum(sr) AS t, round(sum(sr * delta * delta) / sum(sr) - (sum(sr * delta) / sum(sr)) ** 2, 6) AS var_delta FROM x GROUP BY width""", "box_d", "box_r"))
def paired_windows(spark, d):
    m = windows.paired_windows(view(spark, d, "box_d"), view(spark, d, "box_r"), 4, [2, 3], ["c0", "c1"])
    return m.select("width", "t", *r6("var_delta"))


@query("template_weights")
def template_weights(spark, d):
    s = view(spark, d, "sky_d").withColumn("pix", healpix.pixel(F.col("ra"), F.col("u"), 2))
    m = fields.count_map(view(spark, d, "sky_d"), 2)
    mean = m.agg(F.avg("n")).first()[0]
    t = fields.latitude_templates(F.degrees(F.asin("u")), F.col("ra"))
    maps = s.groupBy("pix").agg(*[F.avg(c).alias(k) for k, c in t.items()]).join(m, "pix").withColumn("residual", F.col("n") / F.lit(mean) - 1)
    return fields.template_weights(s.select("id", "pix"), maps, list(t))


@query("jackknife_regions")
def jackknife_regions(spark, d):
    return fields.jackknife_regions(view(spark, d, "sky_d"), 5, 2)


@query("partial_corr", sql("""
, r AS (SELECT corr(c0, c1) AS xy, corr(c0, c2) AS xz, corr(c1, c2) AS yz FROM pts_d) SELECT round(xy, 6) AS r, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM r""", "pts_d"))
def partial_corr(spark, d):
    return fields.partial_corr(view(spark, d, "pts_d"), "c0", "c1", "c2").select(*r6("r", "partial"))


@query("environment_means", sql("""
, m AS (SELECT quantile_disc(c0, 0.5) AS m FROM pts_d) SELECT half, count(*) AS n, round(avg(w), 6) AS mean_w, round(avg(c1), 6) AS mean_c1 FROM (SELECT *, (c0 > m)::INT AS half FROM pts_d, m) GROUP BY half""", "pts_d"))
def environment_means(spark, d):
    return fields.environment_means(fields.median_split(view(spark, d, "pts_d"), "c0"), "half", ["w", "c1"]).select("half", "n", *r6("mean_w", "mean_c1"))


@query("three_point", sql(f"""
, e AS (SELECT 'd' AS k, a.id AS i, b.id AS j FROM pts_d a, pts_d b WHERE a.id < b.id AND {D2} BETWEEN 49000000 AND 81000000 UNION ALL SELECT 'r', a.id, b.id FROM pts_r a, pts_r b WHERE a.id < b.id AND {D2} BETWEEN 49000000 AND 81000000),
t AS (SELECT x.k, count(*) AS n FROM e x, e y, e z WHERE x.k = y.k AND y.k = z.k AND x.j = y.i AND z.i = x.i AND z.j = y.j GROUP BY x.k),
c AS (SELECT coalesce((SELECT n FROM t WHERE k = 'd'), 0) AS ddd, coalesce((SELECT n FROM t WHERE k = 'r'), 0) AS rrr, (SELECT count(*) FROM pts_d)::DOUBLE AS nd, (SELECT count(*) FROM pts_r)::DOUBLE AS nr)
SELECT 8000.0::DOUBLE AS side, ddd, rrr, round(CASE WHEN rrr > 0 THEN ddd * nr * (nr - 1) * (nr - 2) / (rrr * nd * (nd - 1) * (nd - 2)) - 1 END, 6) AS zeta FROM c""".replace("49000000", str((8000 - 1000) ** 2)).replace("81000000", str((8000 + 1000) ** 2)), "pts_d", "pts_r"))
def three_point(spark, d):
    return graph.three_point(view(spark, d, "pts_d"), view(spark, d, "pts_r"), [8000.0], 1000.0).select("side", "ddd", "rrr", *r6("zeta"))


@query("nearest", sql(f"""
, p AS (SELECT a.id AS a_id, b.id AS b_id, {D2} AS d2 FROM pts_d a, pts_r b), k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rank FROM p) SELECT a_id, b_id, d2, rank::INT AS rank FROM k WHERE rank <= 3""", "pts_d", "pts_r"))
def nearest(spark, d):
    return neighbours.k_nearest(view(spark, d, "pts_d"), view(spark, d, "pts_r"), 3).select("a_id", "b_id", "d2", "rank")


@query("conditional_mean")
def conditional_mean(spark, d):
    import numpy as np

    known = view(spark, d, "pts_r").withColumn("value", F.col("w"))
    return graph.conditional_mean(view(spark, d, "pts_d"), known, lambda r: np.exp(-r / 8000.0), 6)


@query("sigma2_data_only", sql(f"""
, s AS (SELECT coalesce(sum(a.w * b.w * (1 - 0.75 * sqrt({D2}) / 5000 + (sqrt({D2}) / 5000) ** 3 / 16) * 3 / (4 * pi() * 5000.0 ** 3)), 0) AS s FROM pts_d a, pts_d b WHERE a.id < b.id AND {D2} < 100000000),
t AS (SELECT (sum(w) ** 2 - sum(w * w)) / 2 AS pairs FROM pts_d) SELECT 5000.0::DOUBLE AS radius, round((s / pairs - 3.5527136788005009e-15) / 3.5527136788005009e-15, 6) AS sigma2 FROM s, t""", "pts_d"))
def sigma2_data_only(spark, d):
    return continuous.sigma2_data_only(view(spark, d, "pts_d"), 5000.0, 2.0**-48).select("radius", *r6("sigma2"))


@query("xi_basis")
def xi_basis(spark, d):
    knots = [2000.0, 5000.0, 9000.0]
    c = continuous.xi_basis(view(spark, d, "pts_d"), view(spark, d, "pts_r"), knots)
    return spark.createDataFrame(list(zip(knots, c, strict=True)), "r double, xi double")


@query("wp_chebyshev")
def wp_chebyshev(spark, d):
    c = continuous.wp_chebyshev(view(spark, d, "pts_d"), view(spark, d, "pts_r"), 1000.0, 8000.0, 6000.0)
    return spark.createDataFrame(list(enumerate(c)), "k int, coefficient double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pointloom import field_queries, source_queries  # noqa: F401  the modules that build on this one register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from pointloom import field_queries, source_queries  # noqa: F401

    return dict(_SQL)
