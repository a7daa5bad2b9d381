"""Harmonic coefficients, power spectra and mask coupling against plain sums over the sky."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import healpix
from pointloom.operators import spectra


def centres(spark, nside):
    ra, z = healpix.centre(F.col("id"), nside)
    rows = spark.range(12 * nside * nside).select("id", ra.alias("ra"), z.alias("z")).orderBy("id").collect()
    return np.array([r.ra for r in rows]), np.array([r.z for r in rows])


def values(spark, v):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pix long, value double").repartition(3)


def legendre(lmax, x):
    p = [np.ones_like(x), x]
    for n in range(1, lmax):
        p.append(((2 * n + 1) * x * p[n] - n * p[n - 1]) / (n + 1))
    return p[: lmax + 1]


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_rings_agree_with_centres(spark, nside):
    ring, place = healpix.ring_place(F.col("id"), nside)
    rows = spark.range(12 * nside * nside).select("id", ring.alias("ring"), place.alias("place")).orderBy("id").collect()
    ra, z = centres(spark, nside)
    n, first, height = spectra._ring(np.array([r.ring for r in rows]), nside)
    got = np.degrees(first + 2 * math.pi * np.array([r.place for r in rows]) / n)
    assert np.allclose(height, z) and np.allclose(got, ra)


def test_pseudo_power_is_the_plain_double_sum(spark):
    """By the addition theorem the power at a degree is a sum of Legendre polynomials over all pairs of pixels."""
    nside, lmax = 4, 11
    ra, z = centres(spark, nside)
    v = np.random.default_rng(3).normal(size=len(z))
    s, phi = np.sqrt(1 - z * z), np.radians(ra)
    x = np.stack([s * np.cos(phi), s * np.sin(phi), z], 1)
    want = [(v @ p @ v) * (math.pi / (3 * nside * nside)) ** 2 / (4 * math.pi) for p in legendre(lmax, np.clip(x @ x.T, -1, 1))]
    got = {r.l: r.cl for r in spectra.power(spectra.harmonics(values(spark, v), nside, lmax)).collect()}
    assert [got[n] for n in range(lmax + 1)] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_known_coefficients_come_back(spark):
    nside, lmax = 8, 12
    rng = np.random.default_rng(4)
    known = [(deg, m, float(rng.normal()), float(rng.normal()) if m else 0.0) for deg in range(lmax + 1) for m in range(deg + 1)]
    alm = spark.createDataFrame(known, spectra.ALM)
    made = spectra.synthesis(alm, nside, lmax)
    got = {(r.l, r.m): (r.re, r.im) for r in spectra.fitted_harmonics(made, nside, lmax, rounds=3).collect()}
    assert max(abs(got[deg, m][0] - re) + abs(got[deg, m][1] - im) for deg, m, re, im in known) < 1e-3
    rough = {(r.l, r.m): (r.re, r.im) for r in spectra.harmonics(made, nside, lmax).collect()}
    assert max(abs(rough[deg, m][0] - re) for deg, m, re, im in known) < 0.1


def test_functions_of_high_order_near_the_poles():
    z = np.array([0.0, 0.5, 0.9, 0.999])
    for m, lmax in ((0, 50), (30, 60), (700, 900)):
        rows = list(spectra._legendre(m, lmax, z))
        assert all(np.isfinite(r).all() for r in rows)
    grid = (np.arange(20000) + 0.5) / 10000 - 1
    for m, deg in ((5, 20), (40, 41)):
        lam = list(spectra._legendre(m, deg, grid))[-1]
        assert 2 * math.pi * (lam**2).sum() / 10000 == pytest.approx(1, rel=1e-3)


def test_coupling_of_the_whole_sky_is_none(spark):
    bins = spectra.degree_bins(4, 3)
    assert bins == [(2, 5), (5, 8), (8, 11)]
    assert spectra.coupling([4 * math.pi] + [0.0] * 11, bins, spark) == pytest.approx(np.eye(3), abs=1e-12)


def test_coupling_is_the_power_that_a_mask_makes(spark):
    """Row by row against 3j symbols from an integral of three Legendre polynomials."""
    top, rng = 8, np.random.default_rng(5)
    w, bins = np.abs(rng.normal(size=top + 1)), [(2, 4), (4, 6), (6, 8)]
    nodes, weights = np.polynomial.legendre.leggauss(40)
    p = legendre(top, nodes)
    m = np.array([[(2 * b + 1) / (4 * math.pi) * sum((2 * c + 1) * w[c] * (weights * p[a] * p[b] * p[c]).sum() / 2 for c in range(top + 1)) for b in range(top + 1)] for a in range(top + 1)])
    want = [[np.mean([m[a, lo2:hi2].sum() for a in range(lo, hi)]) for lo2, hi2 in bins] for lo, hi in bins]
    assert spectra.coupling(list(w), bins, spark) == pytest.approx(np.array(want), rel=1e-10)


def test_spectra_of_points_behind_a_mask(spark):
    """Power in a bin comes back through a mask; a map against itself has the auto power; missing pixels and null masks count as 0."""
    nside, n = 8, 12 * 64
    ra, z = centres(spark, nside)
    rng = np.random.default_rng(6)
    counts = rng.poisson(20 * (1 + 0.5 * z))
    pts = [(float(ra[p]), float(z[p])) for p in range(n) for _ in range(counts[p])]
    points = spark.createDataFrame(pts, "ra double, u double")
    full = spark.createDataFrame([(i, 1.0) for i in range(n)], "pix long, completeness double")
    got = spectra.auto_spectrum(points, full, nside, 4, rounds=1).orderBy("bin").collect()
    assert [r.ell for r in got] == [3.5, 7.5, 11.5, 15.5, 19.5] and got[0].f_sky == 1 and got[0].n_shot == pytest.approx(4 * math.pi / len(pts))
    assert all(r.cl_raw == pytest.approx(r.cl_coupled, rel=1e-2) for r in got) and all(r.cl == pytest.approx(r.cl_raw - r.n_shot) for r in got)
    assert all(abs(r.cl) < r.n_shot for r in got[:3])  # the dipole, which no bin holds, is all that these counts have beyond noise
    half = spark.createDataFrame([(i, None if z[i] < -0.8 else float(z[i] > -0.3)) for i in range(n)], "pix long, completeness double")
    behind = spectra.auto_spectrum(points, half, nside, 4, rounds=1).orderBy("bin").collect()
    assert behind[0].f_sky == pytest.approx(np.mean(z > -0.3)) and behind[0].n_shot == pytest.approx(math.pi / (3 * nside**2) * (z > -0.3).sum() / len(pts))
    mean = counts.sum() / n
    other = values(spark, counts / mean - 1).where("pix > 3")
    cross = spectra.cross_spectrum(points, full, other, full, nside, 4, rounds=1).orderBy("bin").collect()
    assert [r.cl for r in cross] == pytest.approx([r.cl_raw for r in got], rel=0.1)
    assert spectra.auto_spectrum(points.limit(0), full, nside, 4, rounds=0).count() == 0
