"""Queries of sources, streams, sky coordinates and windows, with the SQL each is held against."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.derived_queries import _COMPLETE, SHIFTS, centres_sql, pixel_sql, runs_sql
from pointloom.functions import cosmology, sums
from pointloom.functions.coords import chord
from pointloom.operators import fields
from pointloom.plans import multirun, xi_fit
from pointloom.queries import AXES, VIEWS, ZN, _columns, bins_sql, query, r6, sql, view
from pointloom.sources import catalogs, mocks
from pointloom.streaming import cells as stream

# -- streams ----------------------------------------------------------------------------


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(result: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there now: the rows of its batches, of the last one alone in complete mode.

    Batches and checkpoint are kept in the shared folder that spark.checkpoint.dir names (a local
    one only in local mode, where none is named); a batch that runs again replaces itself.
    """
    spark = result.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{(named or tempfile.mkdtemp(prefix='pointloom-')).rstrip('/')}/drained-{uuid.uuid4().hex}"
    batches: dict[int, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        batches[number] = f"{folder}/batch-{number}"
        batch.write.mode("overwrite").parquet(batches[number])

    result.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = [batches[n] for n in (sorted(batches)[-1:] if mode == "complete" else sorted(batches))]
    return spark.read.schema(result.schema).parquet(*kept) if kept else spark.createDataFrame([], result.schema)


@query("stream_cell_counts", sql(" SELECT level::INT AS level, c0 >> (16 - level) AS k0, c1 >> (16 - level) AS k1, c2 >> (16 - level) AS k2, count(*) AS n, sum(w) AS sw FROM box_d, (SELECT unnest([0, 1, 2]) AS level) GROUP BY ALL", "box_d"))
def stream_cell_counts(spark, d):
    points = table_stream(spark, d, "lineitem").selectExpr(*_columns(VIEWS["box_d"]))
    return drained(stream.cell_counts(points, AXES, levels=[0, 1, 2]), "complete")


@query("stream_pair_increments", sql(", c AS (SELECT level, count(*) AS n FROM pts_d, (SELECT unnest([1, 2]) AS level) GROUP BY level, c0 >> (16 - level), c1 >> (16 - level), c2 >> (16 - level)) SELECT level::INT AS level, sum(n * (n - 1) // 2)::BIGINT AS pairs FROM c GROUP BY level", "pts_d"))
def stream_pair_increments(spark, d):
    points = table_stream(spark, d, "customer").selectExpr(*_columns(VIEWS["pts_d"]))
    return drained(stream.pair_increments(points, AXES, levels=[1, 2]), "update").groupBy("level").agg(F.sum("new_pairs").alias("pairs"))


@query("stream_event_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts)::VARCHAR AS since, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    found = drained(stream.windowed_counts(table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "1 day"), "complete")
    return found.select(F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "event_type", "n", F.round("value", 4).alias("value"))


# -- sources ----------------------------------------------------------------------------


@query("halton_points", "SELECT i AS id, round((SELECT sum((i // (2 ** k)::BIGINT) % 2 / 2 ** (k + 1)) FROM range(12) t(k)), 6) AS x, round((SELECT sum((i // (3 ** k)::BIGINT) % 3 / 3 ** (k + 1)) FROM range(8) t(k)), 6) AS y FROM range(1000) r(i)")
def halton_points(spark, d):
    return spark.range(1000).select("id", F.round(catalogs.halton(F.col("id"), 2), 6).alias("x"), F.round(catalogs.halton(F.col("id"), 3), 6).alias("y"))


@query("lattice", "SELECT i AS id, (i % 5 + 0.5) * 20.0::DOUBLE AS x0, (i // 5 % 5 + 0.5) * 20.0::DOUBLE AS x1, (i // 25 + 0.5) * 20.0::DOUBLE AS x2 FROM range(125) t(i)")
def lattice(spark, d):
    return catalogs.lattice(spark, 5, 100.0)


@query("survey_catalog", sql(" SELECT round(ra, 6) AS ra, round(u, 6) + 0.0 AS dec, red AS z, round((1 + id % 3) * CASE WHEN id % 4 = 0 THEN 1 ELSE 0.5 END * (0.1 + id % 2), 6) AS w FROM sky_d WHERE red BETWEEN 0.8 AND 1.6 AND (0.1 + id % 2) > 0", "sky_d"))
def survey_catalog(spark, d):
    rows = view(spark, d, "sky_d").select(F.col("ra").alias("RA"), F.col("u").alias("DEC"), F.col("red").alias("Z"), (1.0 + F.col("id") % 3).alias("WEIGHT_SYS"), F.when(F.col("id") % 4 != 0, 0.5).alias("WEIGHT_NOZ"), (0.1 + F.col("id") % 2).alias("WEIGHT_FKP"))
    return catalogs.survey_catalog(rows, 0.8, 1.6).select(*r6("ra", "dec"), "z", *r6("w"))


@query("compensated_total", "SELECT round(fsum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem")
def compensated_total(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return spark.createDataFrame([(round(sums.compensated_sum(rows, "x"), 4),)], "total double")


@query("shifted_to_positive", sql(""", a AS (SELECT c0, c1, c2 FROM pts_d UNION ALL SELECT c0, c1, c2 FROM pts_r), m AS (SELECT min(c0) AS m0, min(c1) AS m1, min(c2) AS m2, greatest(max(c0) - min(c0), max(c1) - min(c1), max(c2) - min(c2)) + 200 AS box FROM a)
SELECT id, (c0 - m0 + 100)::DOUBLE AS c0, (c1 - m1 + 100)::DOUBLE AS c1, (c2 - m2 + 100)::DOUBLE AS c2, box::DOUBLE AS box FROM pts_d, m""", "pts_d", "pts_r"))
def shifted_to_positive(spark, d):
    data, _, box = cosmology.shifted_to_positive(view(spark, d, "pts_d"), view(spark, d, "pts_r"), tuple(AXES))
    return data.select("id", *[F.col(a).cast("double").alias(a) for a in AXES], F.lit(float(box)).alias("box"))


# -- the sky ----------------------------------------------------------------------------


@query("sky_latitudes", sql(f""" SELECT id, round(degrees(asin(sin(radians(dec)) * sin(radians(27.12825)) + cos(radians(dec)) * cos(radians(27.12825)) * cos(radians(ra - 192.85948)))), 6) + 0.0 AS galactic,
round(degrees(asin(sin(radians(dec)) * cos(radians({fields.OBLIQUITY})) - cos(radians(dec)) * sin(radians({fields.OBLIQUITY})) * sin(radians(ra)))), 6) + 0.0 AS ecliptic FROM (SELECT id, ra, degrees(asin(u)) AS dec FROM sky_d)""", "sky_d"))
def sky_latitudes(spark, d):
    s = view(spark, d, "sky_d").select("id", "ra", F.degrees(F.asin("u")).alias("dec"))
    return s.select("id", catalogs.galactic_latitude(F.col("ra"), F.col("dec")).alias("galactic"), fields.ecliptic_latitude(F.col("ra"), F.col("dec")).alias("ecliptic")).select("id", *r6("galactic", "ecliptic"))


_Y = {
    "y1_0": "sqrt(3 / (4 * pi())) * u", "y2_0": "sqrt(5 / (16 * pi())) * (3 * u * u - 1)",
    "y1_1_cos": "-sqrt(3 / (2 * pi())) * s * cos(p)", "y1_1_sin": "sqrt(3 / (2 * pi())) * s * sin(p)", "y2_1_cos": "-sqrt(15 / (2 * pi())) * s * u * cos(p)", "y2_1_sin": "sqrt(15 / (2 * pi())) * s * u * sin(p)",
    "y2_2_cos": "sqrt(15 / (8 * pi())) * s * s * cos(2 * p)", "y2_2_sin": "-sqrt(15 / (8 * pi())) * s * s * sin(2 * p)",
}


@query("harmonic_templates", sql(f" SELECT id, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in _Y.items())} FROM (SELECT id, u, sqrt(1 - u * u) AS s, radians(ra) AS p FROM sky_d)", "sky_d"))
def harmonic_templates(spark, d):
    t = fields.harmonic_templates(F.col("ra"), F.col("u"), 2)
    return view(spark, d, "sky_d").select("id", *[c.alias(k) for k, c in t.items()]).select("id", *r6(*t))


@query("redshift_of_distance", sql(""", g AS (SELECT i, i * 4.0 / 3999 AS z, 1 / sqrt(0.31 * (1 + i * 4.0 / 3999) ** 3 + 0.69) AS f FROM range(4000) t(i)), c AS (SELECT i, z, coalesce(sum((f + before) / 2) OVER (ORDER BY i), 0) * 4.0 / 3999 * 2997.92458 AS d FROM (SELECT *, lag(f) OVER (ORDER BY i) AS before FROM g)),
n AS (SELECT *, lead(d) OVER (ORDER BY i) AS d1, lead(z) OVER (ORDER BY i) AS z1 FROM c), top AS (SELECT max(d) / 3999 AS step FROM c),
e AS (SELECT k, step, CASE WHEN k = 3999 THEN 4.0 ELSE z + (k * step - d) / (d1 - d) * (z1 - z) END AS z FROM top, range(4000) t(k) JOIN n ON k = 3999 AND i = 3999 OR k < 3999 AND k * step >= d AND k * step < d1),
s AS (SELECT id, (100.0 + 4 * (id % 1000)) / step AS place FROM sky_d, top)
SELECT id, round(a.z + (place - floor(place)) * (b.z - a.z), 4) AS z FROM s JOIN e a ON a.k = floor(place) JOIN e b ON b.k = a.k + 1""", "sky_d"))
def redshift_of_distance(spark, d):
    s = view(spark, d, "sky_d").select("id", (100.0 + 4 * (F.col("id") % 1000)).alias("chi"))
    return cosmology.with_redshift(s).select("id", F.round("z", 4).alias("z"))


_NEAR = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.u - b.u) ** 2"
_SIGMA = math.radians(40.0) / math.sqrt(8 * math.log(2))


@query("smoothed_map", sql(_COMPLETE + centres_sql("pm", 2) + f""", s AS (SELECT pm.*, completeness AS m FROM pm JOIN mm USING (pix)), w AS (SELECT a.pix, b.m, exp((2 * asin(least(1, sqrt({_NEAR}) / 2))) ** 2 / {-2 * _SIGMA * _SIGMA!r}::DOUBLE) AS k FROM s a, s b WHERE {_NEAR} <= {chord(min(180.0, math.degrees(_SIGMA) * 4)) ** 2!r}::DOUBLE)
SELECT pix, round(sum(k * m) / sum(k), 6) AS value FROM w GROUP BY pix""", "sky_r"))
def smoothed_map(spark, d):
    return fields.smoothed_map(fields.completeness_map(view(spark, d, "sky_r"), 2), 2, "completeness", 40.0).select("pix", *r6("value"))


_CAPS = [5.0, 40.0, 60.0]
_PIXEL = 4 * math.pi / 48
_AREA = _COMPLETE + centres_sql("pm", 2) + f""", s AS (SELECT pm.x, pm.y, pm.u, completeness AS m FROM pm JOIN mm USING (pix)), q AS (SELECT id, x, y, u, {pixel_sql(2)} AS home FROM sky_d),
f AS (SELECT a.id, t.t, sum(b.m) * {_PIXEL!r}::DOUBLE AS area FROM q a, s b, range(3) t(t) WHERE {_NEAR} <= ([{", ".join(f"{chord(t) ** 2!r}::DOUBLE" for t in _CAPS)}])[t.t + 1] GROUP BY ALL),
o AS (SELECT q.id, completeness * {2 * math.pi * (1 - math.cos(math.radians(_CAPS[0])))!r}::DOUBLE AS area FROM q JOIN mm ON pix = home),
area AS (SELECT 0 AS t, avg(area) AS area FROM o UNION ALL SELECT t.t, avg(coalesce(f.area, 0)) FROM q CROSS JOIN range(1, 3) t(t) LEFT JOIN f ON f.id = q.id AND f.t = t.t GROUP BY t.t)"""


@query("windowed_cap_area", sql(_AREA + " SELECT t::INT AS t, round(area, 6) AS area FROM area", "sky_d", "sky_r"))
def windowed_cap_area(spark, d):
    return mocks.windowed_cap_area(fields.completeness_map(view(spark, d, "sky_r"), 2), 2, view(spark, d, "sky_d"), _CAPS).select("t", *r6("area"))


@query("analytic_cap_sums", sql(_AREA + f""", sh AS (SELECT {bins_sql('red', ZN)} AS jn, count(*) / (SELECT count(*) FROM sky_d) AS share FROM sky_d GROUP BY 1)
SELECT t::INT AS t, 0 AS iq, jn::INT AS jn, 500::BIGINT AS n_q, round(500 * 10000 * share * area / (SELECT avg(completeness) * 4 * pi() FROM mm), 4) AS s1 FROM area, sh WHERE jn IS NOT NULL""", "sky_d", "sky_r"))
def analytic_cap_sums(spark, d):
    mask, data = fields.completeness_map(view(spark, d, "sky_r"), 2), view(spark, d, "sky_d")
    found = mocks.analytic_cap_sums(mocks.windowed_cap_area(mask, 2, data, _CAPS), mask, data, spark.createDataFrame([(0, 500)], "iq int, n_q long"), 10_000, ZN)
    return found.select("t", "iq", "jn", "n_q", F.round("s1", 4).alias("s1"))


# -- shells of runs ---------------------------------------------------------------------


@query("shift_shells", sql(runs_sql(SHIFTS, [0, 1, 2, 3], "box_d", "box_r") + """, ls AS (SELECT run, scale, level, sum(sw_d * sw_d - sw2_d) / 2 AS dd, sum(sw_d * sw_r) AS dr, sum(sw_r * sw_r - sw2_r) / 2 AS rr FROM rc GROUP BY ALL),
sh AS (SELECT run, scale, level, dd - lead(dd, 1, 0) OVER o AS dd, dr - lead(dr, 1, 0) OVER o AS dr, rr - lead(rr, 1, 0) OVER o AS rr FROM ls WINDOW o AS (PARTITION BY run ORDER BY level)),
nn AS (SELECT run, sum(sw_d) AS wd, sum(sw_r) AS wr, sum(sw2_d) AS wd2, sum(sw2_r) AS wr2 FROM rc WHERE level = 0 GROUP BY run),
x AS (SELECT scale, level, dd, rr, CASE WHEN rr <> 0 THEN (dd / ((wd * wd - wd2) / 2) - 2 * dr / (wd * wr) + rr / ((wr * wr - wr2) / 2)) / (rr / ((wr * wr - wr2) / 2)) END AS xi FROM sh JOIN nn USING (run))
SELECT scale, level, scale / 2 ** level / 4 AS "inner", scale / 2 ** level / 2 AS "outer", round(avg(xi), 6) AS xi, round(var_samp(xi) / count(xi), 6) AS var, sum(dd) AS dd, sum(rr) AS rr FROM x GROUP BY scale, level""", "box_d", "box_r"))
def shift_shells(spark, d):
    cells = multirun.run_cells(view(spark, d, "box_d"), view(spark, d, "box_r"), multirun.plan(spark, SHIFTS), levels=range(4))
    return xi_fit.shift_shells(xi_fit.run_xi(cells)).select("scale", "level", "inner", "outer", *r6("xi", "var"), "dd", "rr")
