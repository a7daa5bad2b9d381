"""Registered queries of Gaussian fields, quadratic fits and map spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointloom.derived_queries import _COMPLETE, _map_sql, centres_sql
from pointloom.functions import cosmology
from pointloom.operators import fields, gaussian, spectra, survey_window
from pointloom.queries import AXES, query, sql, view

THETA = [math.log(0.5), math.log(6000.0)]


def _valued(spark, d, name: str = "pts_d"):
    return view(spark, d, name).select("id", *AXES, (F.col("w") - 2).alias("value"))


@query("quadratic_fits")
def quadratic_fits(spark, d):
    return gaussian.quadratic_fits(_valued(spark, d), 20)


@query("quadratic_fits_line", sql("""
, n AS (SELECT a.id, (b.c0 - a.c0)::DOUBLE AS x, (b.w - a.w)::DOUBLE AS f, row_number() OVER (PARTITION BY a.id ORDER BY (b.c0 - a.c0) ** 2, b.id) AS rank FROM pts_d a, pts_d b WHERE a.id <> b.id),
s AS (SELECT id, count(*)::DOUBLE AS s11, sum(x) / 2 AS s12, sum(x * x) / 4 AS s22, sum(f / x) AS t1, sum(f) / 2 AS t2 FROM n WHERE rank <= 6 GROUP BY id),
h AS (SELECT id, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS g, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS h FROM s)
SELECT id, round(1000 * g, 4) + 0.0 AS gradient, round(1000000 * h, 3) + 0.0 AS hessian FROM h""", "pts_d"))
def quadratic_fits_line(spark, d):
    f = gaussian.quadratic_fits(_valued(spark, d), 6, ["c0"])
    return f.select("id", (F.round(1000 * F.get("gradient", F.lit(0)), 4) + 0.0).alias("gradient"), (F.round(1000000 * F.get("hessian", F.lit(0)), 3) + 0.0).alias("hessian"))


@query("kernel_likelihood")
def kernel_likelihood(spark, d):
    return gaussian.likelihood(gaussian.conditioning(_valued(spark, d), 10), gaussian.exponential, THETA)


@query("kernel_fit")
def kernel_fit(spark, d):
    """The likelihood at the parameters fitted to all points, and the parameters."""
    factors = gaussian.conditioning(_valued(spark, d), 10)
    theta, _, _ = gaussian.fit_kernel(factors, gaussian.exponential, THETA, steps=8)
    return gaussian.likelihood(factors, gaussian.exponential, theta).select(F.lit(theta[0]).alias("log_variance"), F.lit(theta[1]).alias("log_scale"), "loss", "gradient", "hessian", "n")


@query("field_derivatives")
def field_derivatives(spark, d):
    return gaussian.derivatives(gaussian.conditioning(_valued(spark, d), 10), THETA)


@query("map_field")
def map_field(spark, d):
    """Log density of the catalog, its integral by the randoms; ids of the randoms below 0."""
    data = view(spark, d, "pts_d").select("id", *AXES, F.lit(True).alias("counted"))
    volume = view(spark, d, "pts_r").select((-1 - F.col("id")).alias("id"), *AXES, F.lit(False).alias("counted"))
    points = data.unionByName(volume)
    factors = gaussian.conditioning(points.withColumn("value", F.lit(0.0)), 8)
    return gaussian.map_field(points, factors, gaussian.exponential, THETA, float(data.count()), "log", steps=8, tolerance=1e-6)[0]


# pseudo power at degrees 0 to 5 by the addition theorem, all pairs of pixels
@query("sky_power", sql(_COMPLETE + _map_sql("md", "sky_d", 2) + centres_sql("pm", 2) + f""", j AS (SELECT pix, n, completeness FROM md JOIN mm USING (pix)), a AS (SELECT sum(n) / sum(completeness) AS mean FROM j WHERE completeness >= 0.3),
f AS (SELECT x, y, u, CASE WHEN completeness >= 0.3 THEN n / (mean * completeness) - 1 ELSE 0 END * completeness AS v FROM j JOIN pm USING (pix), a),
p AS (SELECT a.v * b.v AS v, a.x * b.x + a.y * b.y + a.u * b.u AS t FROM f a, f b),
l AS (SELECT unnest([1.0::DOUBLE, t, (3 * t ** 2 - 1) / 2, (5 * t ** 3 - 3 * t) / 2, (35 * t ** 4 - 30 * t ** 2 + 3) / 8, (63 * t ** 5 - 70 * t ** 3 + 15 * t) / 8]) AS legendre, unnest(range(6))::INT AS l, v FROM p)
SELECT l, round(1000 * sum(v * legendre) * {(4 * math.pi / 48) ** 2 / (4 * math.pi)!r}::DOUBLE, 6) + 0.0 AS cl FROM l GROUP BY l""", "sky_d", "sky_r"))
def sky_power(spark, d):
    mask = fields.completeness_map(view(spark, d, "sky_r"), 2)
    delta = fields.overdensity_map(view(spark, d, "sky_d"), mask, 2, 0.3).join(mask, "pix").select("pix", (F.col("delta") * F.col("completeness")).alias("value"))
    return spectra.power(spectra.harmonics(delta, 2, 5)).select("l", (F.round(1000 * F.col("cl"), 6) + 0.0).alias("cl"))


@query("sky_spectrum")
def sky_spectrum(spark, d):
    return spectra.auto_spectrum(view(spark, d, "sky_d"), fields.completeness_map(view(spark, d, "sky_r"), 4), 4, 3, 0.1)


@query("sky_cross_spectrum")
def sky_cross_spectrum(spark, d):
    mask = fields.completeness_map(view(spark, d, "sky_r"), 4)
    other = fields.count_map(view(spark, d, "sky_r"), 4).withColumnRenamed("n", "value")
    return spectra.cross_spectrum(view(spark, d, "sky_d"), mask, other, mask, 4, 3, 0.1)


@query("window_xi")
def window_xi(spark, d):
    """Shells of the sky catalog in a cube about the observer, with the window of mask and radial density in place of randoms."""
    sky = cosmology.with_distance(view(spark, d, "sky_d"), z="red")
    half = 4000.0  # above the distance of the farthest redshift of the catalog
    data = sky.select(*[F.floor((F.col("chi") * F.col(c) + half) / (2 * half) * 65536).cast("long").alias(k) for c, k in zip(("x", "y", "u"), AXES, strict=True)])
    radial = survey_window.radial_density(view(spark, d, "sky_r").select(F.col("red").alias("z")))
    window = survey_window.window_cells(spark, fields.completeness_map(view(spark, d, "sky_r"), 2), 2, radial, [-half] * 3, 2 * half, 6)
    return survey_window.xi_from_window(data, window, range(6), weight=None)
