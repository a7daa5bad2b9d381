"""Model curves, fits, mocks and maps against identities and plain sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import cosmology, healpix, power, projected, sums, theory
from pointloom.functions.coords import unit_vector
from pointloom.operators import cells, continuous, fields, pairs, survey_window, wiener, windows
from pointloom.plans import fingerprint, multirun, xi_fit
from pointloom.sources import catalogs, mocks

COSMOLOGY, MATTER = cosmology.Cosmology(), power.Matter()


def test_spectrum_has_its_amplitude_and_oscillations():
    k = power.k_grid(n=4096)
    for wiggles in (True, False):
        p = power.linear_power(k, COSMOLOGY, MATTER, wiggles=wiggles)
        assert theory.sigma2_from_power(8.0, k, p)[0] == pytest.approx(MATTER.sigma8**2, rel=1e-4)
    ratio = power.linear_power(k, COSMOLOGY, MATTER) / power.linear_power(k, COSMOLOGY, MATTER, wiggles=False)
    band = (k > 0.02) & (k < 0.3)
    assert ratio[band].max() > 1.03 and ratio[band].min() < 0.97
    s = np.arange(60.0, 140.0, 1.0)
    xi = power.xi_of_power(s, k, power.linear_power(k, COSMOLOGY, MATTER) * np.exp(-((k * 0.5) ** 2)))
    bump = s[s > 85][np.argmax((xi * s * s)[s > 85])]
    assert 95 < bump < 110  # the acoustic scale


def test_halo_fit_keeps_large_scales():
    k = power.k_grid()
    scale = power.nonlinear_scale(COSMOLOGY, MATTER, 0.0)
    fine = np.geomspace(1e-4, 1e3, 5000)
    d2 = power.linear_power(fine, COSMOLOGY, MATTER) * fine**3 / (2 * math.pi**2)
    variance = lambda r: np.trapezoid(d2 * np.exp(-((fine * r) ** 2)), np.log(fine))
    r, e = 1 / scale[0], 1e-3
    assert variance(r) == pytest.approx(1, rel=1e-3)
    slope = (math.log(variance(r * (1 + e))) - math.log(variance(r * (1 - e)))) / (2 * e)
    assert scale[1] == pytest.approx(-3 - slope, abs=1e-2)
    second = (math.log(variance(r * math.exp(0.05))) - 2 * math.log(variance(r)) + math.log(variance(r * math.exp(-0.05)))) / 0.05**2
    assert scale[2] == pytest.approx(-second, abs=1e-2)
    boost = power.nonlinear_power(k, 0.0, COSMOLOGY, MATTER) / power.linear_power(k, COSMOLOGY, MATTER)
    assert boost[k < 0.01] == pytest.approx(1, abs=0.02) and boost[np.searchsorted(k, 1.0)] > 2


def test_correlation_is_the_plain_integral():
    k = np.geomspace(1e-4, 50, 40_000)
    p = np.exp(-((k * 2.0) ** 2)) * k
    assert power.xi_of_power([3.0, 20.0], k, p) == pytest.approx(theory.xi_from_power([3.0, 20.0], k, p), rel=1e-3, abs=1e-9)


def test_variance_slopes_and_windows():
    a, b = power.sigma2_predicted([7.99, 8.01], 0.5, COSMOLOGY, MATTER)
    assert power.sigma2_predicted(8.0, 0.5, COSMOLOGY, MATTER, slope=True)[0] == pytest.approx((b - a) / 0.02, rel=1e-3)
    assert power.sigma2_oscillation([60.0], 0.5, COSMOLOGY, MATTER, 2.0)[0] == pytest.approx(4 * power.sigma2_oscillation([60.0], 0.5, COSMOLOGY, MATTER)[0])
    x = np.array([0.0, 1.0, 3.8317, 10.0])
    assert power.disc_k(x) == pytest.approx([1.0, 2 * 0.4400505857, 0.0, 2 * 0.0434727462 / 10], abs=1e-3)
    assert power.sigma2_cylinder([8.0], 20.0, 0.5, COSMOLOGY, MATTER, sigma_chi=30.0)[0] < power.sigma2_cylinder([8.0], 20.0, 0.5, COSMOLOGY, MATTER)[0]


def test_projected_curves():
    rp = [5.0, 20.0, 60.0]
    exact = projected.wp_model(rp, 1.0, 0.0, COSMOLOGY, MATTER, 2.0, 100.0, 400.0, 4001)
    assert exact == pytest.approx(projected.wp_real(rp, 1.0, COSMOLOGY, MATTER, 2.0, 100.0, 4001), rel=0.02)
    smeared = projected.wp_model(rp, 1.0, 60.0, COSMOLOGY, MATTER, 2.0, 100.0)
    assert (smeared < exact).all()
    sample = projected.pair_sigma_chi(np.full(50, 1.0), np.full(50, 0.02), COSMOLOGY, 100)
    assert sample == pytest.approx(math.sqrt(2) * projected.sigma_chi(1.0, 0.02, COSMOLOGY))
    assert projected.wp_model(rp, 1.0, sample[:2], COSMOLOGY, MATTER) == pytest.approx(projected.wp_model(rp, 1.0, float(sample[0]), COSMOLOGY, MATTER))
    z, one = np.linspace(0.9, 1.1, 5), np.ones(5)
    spread = projected.wp_over_redshifts(rp, z, one, 2 * one, 0.0, COSMOLOGY, MATTER, pi_max=100.0)
    assert spread == pytest.approx(projected.wp_model(rp, 1.0, 0.0, COSMOLOGY, MATTER, 2.0, 100.0), rel=0.02)
    assert projected.amplitude_of_evolution(z, one / 0.2, one, COSMOLOGY) == pytest.approx(1, abs=0.01)
    assert np.trapezoid(projected.redshift_density(np.linspace(0, 3, 3001), [1.0, 2.0], [0.05, 0.1]), dx=1e-3) == pytest.approx(2, rel=1e-4)


def test_angular_spectra():
    z = np.linspace(0.5, 2.5, 30)
    n = np.exp(-((z - 1.5) ** 2) / 0.3)
    ell = [20.0, 200.0]
    gg, gk, kk = projected.cl_galaxies(ell, z, n, COSMOLOGY, MATTER), projected.cl_galaxies_lensing(ell, z, n, np.ones(30), COSMOLOGY, MATTER), projected.cl_lensing(ell, COSMOLOGY, MATTER)
    assert projected.cl_galaxies(ell, z, 3 * n, COSMOLOGY, MATTER, 2.0) == pytest.approx(4 * gg)
    assert (gk**2 < gg * kk).all()  # fields are never more than wholly correlated
    assert projected.lensing_kernel([0.0, 1.0, 1100.0], COSMOLOGY)[[0, 2]].tolist() == [0.0, 0.0]
    total, each = projected.cross_signal_to_noise(ell, gk, gg, kk + projected.lensing_noise(ell))
    assert total == pytest.approx(math.sqrt(each.sum()))
    edges = [0.8, 1.2, 1.6, 2.0]
    s = projected.sigma2_shells([0.01, 0.03], edges, z, n, COSMOLOGY, MATTER, n_ell=60)
    assert s.shape == (3, 2) and (s[:, 0] > s[:, 1]).all()
    mid, slope = projected.sigma2_shells_slope([0.01, 0.03], edges, z, n, COSMOLOGY, MATTER, n_ell=60)
    assert mid == pytest.approx([1.4]) and slope[0] == pytest.approx((s[2] - s[0]) / math.log(2.8 / 2.0))
    c = projected.sigma2_shell_covariance([0.01, 0.03], edges, z, n, COSMOLOGY, MATTER, n_ell=60)
    assert c == pytest.approx(c.T) and np.linalg.eigvalsh(c).min() > -1e-12 and c[0, 1] == 0
    parts = projected.sigma2_shell_parts([0.01, 0.03], edges, z, n, COSMOLOGY, MATTER, lambda x: (1 + x) ** 1.5, n_ell=60)
    assert parts["bias"][0] == pytest.approx(3.0)
    assert projected.sigma2_lensing([10.0], z, n, np.ones(30), COSMOLOGY, MATTER, n_ell=100)[0] > 0


def test_fits_and_filters():
    fit = projected.map_fit(lambda t: 4 * (t[0] - 1.3) ** 2 + (t[1] + 0.2) ** 2 + (t[0] - 1.3) * (t[1] + 0.2), [0.0, 0.5])
    assert fit.success and fit.theta == pytest.approx([1.3, -0.2], abs=1e-4) and fit.covariance == pytest.approx(2 * np.linalg.inv([[8, 1], [1, 2]]), rel=1e-3)
    assert projected.map_fit(lambda t: (t[0] - 1) ** 2, [0.0], [(-1.0, 0.5)]).theta[0] == 0.5
    t, smooth = np.array([1.0, -2.0, 0.5]), np.array([3.0, 3.0, 3.0])
    for errors, factor in ((np.full(3, 0.1), 1), (np.eye(3) * 0.01, (50 - 5) / 49)):
        a = projected.matched_filter(smooth + 1.5 * t, smooth, t, errors, 50)
        assert a.value == pytest.approx(1.5) and a.error == pytest.approx(1 / math.sqrt(525 * factor)) and a.chi2_best == pytest.approx(0, abs=1e-6)
    assert math.isnan(projected.matched_filter(smooth, smooth, t, np.eye(3), 4).value)
    x = np.linspace(80, 120, 41)
    bump = lambda a: np.exp(-((x / a - 100) ** 2) / 50)
    scan = projected.scale_scan(x, bump(1.03), np.zeros(41), bump, np.full(41, 0.1))
    assert scan["alpha"] == pytest.approx(1.03, abs=0.005) and scan["amplitude"] == pytest.approx(1, abs=0.02)
    rp = np.array([5.0, 20.0, 40.0])
    model = lambda c, m, b: projected.wp_model(rp, 1.0, 0.0, c, m, b, steps=100)
    true = model(COSMOLOGY, MATTER, 2.4)
    best, full = projected.fit_curves([(model, true, 0.01 * true)], free=("bias",), matter=MATTER)
    assert full["bias"] == pytest.approx(2.4, rel=1e-3) and best.loss < 1e-3
    bins = [{"z": z, "sigma": 10.0, "rp": rp, "wp": (2 * ((1 + z) / 2.5) ** 1.2) ** 2 * projected.wp_model(rp, z, 10.0, COSMOLOGY, MATTER), "error": np.ones(3)} for z in (1.0, 1.5, 2.0)]
    assert projected.fit_bias_power_law(bins, COSMOLOGY, MATTER).theta == pytest.approx([2.0, 1.2], abs=1e-2)
    assert projected.oscillation_template([100.0], 1.0, 5.0, COSMOLOGY, MATTER, 2.0)[0] == pytest.approx(4 * projected.oscillation_template([100.0], 1.0, 5.0, COSMOLOGY, MATTER)[0])


def test_continuous_xi_through_shells(spark):
    low, high = 10.0, 1000.0
    truth = np.array([2.0, 1.0, 0.4, 0.1])
    edges = np.geomspace(12, 900, 15)
    rows = [(float(a), float(b), float(xi_fit.design_row(a, b, 4, low, high) @ truth), 0.01, 100.0, 50.0) for a, b in zip(edges[:-1], edges[1:])]
    shells = spark.createDataFrame([*rows, (0.0, 5.0, 1.0, 0.1, 1.0, 1.0), (20.0, 30.0, None, 0.1, 1.0, 1.0)], "inner double, outer double, xi double, var double, dd double, rr double")
    for weighting in ("bootstrap", "poisson", "uniform"):
        fit = xi_fit.fit_xi(shells, 4, low, high, weighting)
        assert fit.coefficients == pytest.approx(truth, abs=1e-4) and fit.used == 14
    assert fit.at([low, high, 5.0]) == pytest.approx([2.0, 0.1, 0.0], abs=1e-4) and (fit.sigma([50.0]) > 0).all()
    with pytest.raises(ValueError):
        xi_fit.fit_xi(shells, 20, low, high)
    assert xi_fit.design_row(10, 20, 4, low, high, rr=5.0).sum() == pytest.approx(1)


def test_cell_variance_from_shells(spark):
    kernel = xi_fit.CubeKernel.sampled(3, 100_000, 64, 3)
    r = np.linspace(0, 3.5, 4000)
    assert np.trapezoid(kernel.at(r, 2.0), r) == pytest.approx(1, abs=0.01) and kernel.support(2.0) == pytest.approx(2 * math.sqrt(3)) and kernel.pairs == 100_000
    shells = spark.createDataFrame([(1.0, k, 0.1 * k, 0.1 * k + 0.1, 0.5) for k in range(1, 18)] + [(1.0, 40, 1.0, 2.0, None)], "scale double, level int, inner double, outer double, xi double")
    got = xi_fit.cell_variances(shells, kernel, {1.0: 1.0}).first().variance
    assert got == pytest.approx(0.5, abs=0.02)  # a constant xi is the cell's variance, but for what lies below 0.1
    r = random.Random(3)
    points = lambda n: spark.createDataFrame([(*(r.randrange(65536) for _ in range(3)), 1.0) for _ in range(n)], "c0 long, c1 long, c2 long, w double")
    runs = multirun.plan(spark, [("a", 1.0, 0.0, 0.0, 0.0), ("b", 1.0, 0.3, 0.1, 0.2), ("c", 1.0, 0.15, 0.4, 0.05)])
    single = xi_fit.run_xi(multirun.run_cells(points(400), points(900), runs, levels=range(3)))
    s = xi_fit.shift_shells(single).collect()
    assert len(s) == 3 and all(x.outer == 2 * x.inner and x.var > 0 for x in s)


def test_compensated_sums(spark):
    values = [1e16, 1.0, -1e16, 1e-3] * 100
    assert sums.neumaier_sum(values) == pytest.approx(100.1, abs=1e-9)
    s = sums.CompensatedSum()
    for v in (1.0, 1e100, 1.0, -1e100):
        s.add(v)
    assert s.value() == 2.0
    s.reset()
    assert s.value() == 0.0
    assert sums.compensated_sum(spark.createDataFrame([(v,) for v in values] + [(None,)], "x double"), "x") == pytest.approx(100.1, abs=1e-9)


def test_sky_and_back(spark):
    p = spark.createDataFrame([(1, 100.0, 200.0, -300.0), (2, -1.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    sky = cosmology.to_sky(p)
    back = cosmology.with_distance(sky, z="red")
    x, y, z = cosmology.cartesian(F.col("ra"), F.col("dec"), F.col("chi"))
    for r in back.select("id", "x", "y", "z", x.alias("x2"), y.alias("y2"), z.alias("z2")).collect():
        assert (r.x2, r.y2, r.z2) == pytest.approx((r.x, r.y, r.z), abs=1e-3)
    d, q, box = cosmology.shifted_to_positive(p, p, ("x", "y", "z"), 10.0)
    ends = d.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    assert min(ends) == 10.0 and max(ends) <= box - 10.0 and q.count() == 3


def test_mock_survey(spark):
    data, randoms = mocks.quasar_mock(spark, 2000, 4000, clusters=40, seed=5)
    for df, least in ((data, 1950), (randoms, 4000)):
        rows = df.withColumn("b", catalogs.galactic_latitude(F.col("ra"), F.col("dec"))).collect()
        assert least <= len(rows) <= 4000 and all(abs(r.b) >= 10 and 0.5 <= r.z <= 4.5 for r in rows)
    z = np.array([r.z for r in randoms.collect()])
    share = mocks.two_hump_density(np.linspace(0.5, 4.5, 401))
    assert np.mean(z < 1.3) == pytest.approx(share[:80].sum() / share.sum(), abs=0.03)


def test_randoms_of_a_selection_map(spark):
    mask = spark.range(12 * 16).select(F.col("id").alias("pix"), F.when(F.col("id") < 96, 0.0).when(F.col("id") % 2 == 0, 0.5).otherwise(1.0).alias("completeness"))
    data = spark.createDataFrame([(1.0 + k / 100,) for k in range(100)], "z double")
    r = mocks.selection_randoms(mask, 4, 3000, data, [1.0, 1.5, 2.0])
    counts = r.groupBy(healpix.pixel(F.col("ra"), F.col("u"), 4).alias("pix")).count().collect()
    assert sum(c["count"] for c in counts) == 3000 and all(c.pix >= 96 for c in counts)
    odd = sum(c["count"] for c in counts if c.pix % 2)
    assert odd / 3000 == pytest.approx(2 / 3, abs=0.05)
    both = mocks.region_randoms({"n": mask, "s": mask}, 4, {"n": 100, "s": 50}, {"n": data, "s": data}, [1.0, 2.0])
    assert {x.region: x["count"] for x in both.groupBy("region").count().collect()} == {"n": 100, "s": 50}
    q = r.limit(200)
    full = spark.range(12 * 256).select(F.col("id").alias("pix"), F.lit(1.0).alias("completeness"))
    area = {x.t: x.area for x in mocks.windowed_cap_area(full, 16, q, [1.0, 20.0]).collect()}
    assert area[0] == pytest.approx(2 * math.pi * (1 - math.cos(math.radians(1)))) and area[1] == pytest.approx(2 * math.pi * (1 - math.cos(math.radians(20))), rel=0.03)
    s1 = mocks.analytic_cap_sums(mocks.windowed_cap_area(full, 16, q, [20.0]), full, data, spark.createDataFrame([(0, 50)], "iq int, n_q long"), 1000, [1.0, 1.5, 2.0], "z").collect()
    assert len(s1) == 2 and s1[0].s1 == pytest.approx(50 * 1000 * 0.5 * (1 - math.cos(math.radians(20))) / 2, rel=0.03)


def test_pixel_middles(spark):
    for n in (1, 2, 8):
        ra, u = healpix.centre(F.col("pix"), n)
        got = spark.range(12 * n * n).select(F.col("id").alias("pix")).select("pix", healpix.pixel(ra, u, n).alias("back"), u.alias("u")).collect()
        assert all(r.pix == r.back for r in got) and sum(r.u for r in got) == pytest.approx(0, abs=1e-9)


def test_maps_smoothed_and_weighed(spark):
    pixels = spark.range(192).select(F.col("id").alias("pix"), F.lit(2.0).alias("m"))
    assert all(r.value == pytest.approx(2.0) for r in fields.smoothed_map(pixels, 4, "m", 20.0).collect())
    mask = pixels.select("pix", F.lit(1.0).alias("completeness"))
    sky = catalogs.uniform_sky(spark, 3000).withColumnRenamed("sin_dec", "u")
    w = fields.residual_weights(sky.unionByName(sky.where("u > 0").withColumn("id", F.col("id") + 10_000)), mask, 4, 15.0)
    by = {r.north: r.w for r in w.groupBy((F.col("u") > 0).alias("north")).agg(F.avg("weight").alias("w")).collect()}
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1) and by[False] / by[True] == pytest.approx(2, rel=0.15)


def test_harmonics_are_orthogonal(spark):
    ra, u = healpix.centre(F.col("id"), 8)
    at = spark.range(12 * 64).select(ra.alias("ra"), u.alias("u"))
    t = fields.harmonic_templates(F.col("ra"), F.col("u"), 3)
    rows = np.array([tuple(r) for r in at.select(*[c.alias(k) for k, c in t.items()]).collect()])
    gram = rows.T @ rows * 4 * math.pi / len(rows)
    assert len(t) == 15
    assert gram == pytest.approx(np.diag([1.0 if k.endswith("_0") else 2.0 for k in t]), abs=0.05)
    pole = spark.range(1).select(fields.ecliptic_latitude(F.lit(270.0), F.lit(90 - fields.OBLIQUITY)).alias("b")).first().b
    assert pole == pytest.approx(90.0, abs=1e-4)


def test_pair_redshifts_are_plain_sums(spark):
    r = random.Random(2)
    z = [r.uniform(0.5, 1.5) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    mids, density, n = fields.pair_redshifts(df, COSMOLOGY, 150.0, 10)
    chi = np.interp(z, *COSMOLOGY.table())
    near = [(z[i] + z[j]) / 2 for i in range(300) for j in range(i) if abs(chi[i] - chi[j]) < 150]
    assert n == pytest.approx(len(near), rel=0.02)
    want, _ = np.histogram(near, np.linspace(min(z), max(z), 11))
    assert density * np.trapezoid(want, mids) == pytest.approx(want, rel=0.1, abs=30)


def test_random_pairs_of_the_window(spark):
    """Analytic rr of a full sky against pairs of a random catalog of the same radial density."""
    sky = catalogs.uniform_sky(spark, 4000).select("id", "ra", F.col("sin_dec").alias("u"), (0.05 + 0.15 * F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("z"))
    x, y, z = unit_vector(F.col("ra"), F.col("u"))
    placed = cosmology.with_distance(sky).select("id", *[(c * F.col("chi")).alias(f"c{i}") for i, c in enumerate((x, y, z))])
    mask = spark.range(12 * 64).select(F.col("id").alias("pix"), F.lit(1.0).alias("completeness"))
    rp, pi = [40.0, 80.0, 120.0], [0.0, 60.0, 120.0]
    radial = survey_window.radial_density(sky, bandwidth=0.01)
    analytic = {(r.rp_bin, r.pi_bin): r.rr for r in survey_window.rr_analytic(mask, 8, radial, rp, pi, 4000.0, per_volume=False).collect()}
    counted = pairs.rp_pi_counts(placed, None, rp, pi, weight=None).select("rp_bin", "pi_bin", F.col("wpairs").alias("rr"))
    for r in counted.collect():
        assert analytic[r.rp_bin, r.pi_bin] == pytest.approx(r.rr, rel=0.2)
    thin = (np.linspace(3000.0, 3200.0, 80), np.full(80, 1 / 200))
    a, b = ([r.rr for r in survey_window.rr_analytic(mask, 8, thin, rp, pi, 10.0, per_volume=v).orderBy("rp_bin", "pi_bin").collect()] for v in (True, False))
    assert a == pytest.approx(b, rel=0.02)
    assert survey_window.calibration(spark.createDataFrame([(*k, v) for k, v in analytic.items()], "rp_bin int, pi_bin int, rr double"), counted) == pytest.approx(1, abs=0.15)
    wp = survey_window.wp_analytic(placed, counted.withColumn("rr", F.col("rr") * 1.0), 4000.0, rp, pi)
    assert all(abs(r.wp) < 250 for r in wp.collect())


def test_weighted_pairs_recover(spark):
    r = random.Random(8)
    box = spark.createDataFrame([(i, *(r.uniform(0, 100) for _ in range(3)), 1.0) for i in range(800)], "id long, c0 double, c1 double, c2 double, w double")
    xi = pairs.weighted_xi(box, [5.0, 10.0, 15.0], 100.0)
    assert all(abs(x.xi) < 0.1 for x in xi.collect())
    assert [x.ok for x in pairs.recovery(xi, xi).collect()] == [True, True]


def test_wiener_weights_are_the_dense_solution(spark):
    r = random.Random(4)
    at = [(i, *(r.uniform(0, 100) for _ in range(3)), 1e-4) for i in range(120)]
    points = spark.createDataFrame(at, "id long, c0 double, c1 double, c2 double, nbar double")
    centres, xi = [5.0, 15.0, 30.0], [0.8, 0.3, 0.05]
    got = {x.id: x.weight for x in wiener.wiener_weights(points, centres, xi, 20.0).collect()}
    x = np.array([p[1:4] for p in at])
    apart = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    volume = 4 / 3 * math.pi * 20.0**3
    d = ((apart < 20).sum(axis=1) - 1) / volume / 1e-4 - 1
    c = np.interp(apart, centres, xi, right=0.0)
    np.fill_diagonal(c, 1.0)
    want = 1 + c @ np.linalg.solve(c + np.eye(120) * (1 / (1e-4 * volume) + 1e-6), d - d.mean())
    assert [got[i] for i in range(120)] == pytest.approx(want.tolist(), abs=1e-4)
    assert wiener.kernel_radius(1e-4) == pytest.approx((30 * 3 / (4 * math.pi * 1e-4)) ** (1 / 3))
    assert wiener.wiener_weights(points.limit(0), centres, xi, 20.0).count() == 0


def test_spline_and_wave_bases(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 1.0, 7.0, 50.0, 199.9)], "r double")
    rows = df.select(*[b.alias(f"b{k}") for k, b in enumerate(continuous.cubic_splines(F.col("r"), 7, 0.1, 200.0))]).collect()
    assert all(sum(r) == pytest.approx(1) and min(r) >= 0 for r in rows)  # splines of one knot vector add up to 1
    waves = df.select(*[b.alias(f"w{k}") for k, b in enumerate(continuous.waves(F.col("r"), [0.0, 0.5]))]).collect()
    assert [r.w0 for r in waves] == [1.0] * 5 and waves[1].w1 == pytest.approx(math.sin(0.5) / 0.5)


def test_fingerprint_files(spark, tmp_path):
    r = random.Random(6)
    points = spark.createDataFrame([(r.randrange(65536), r.randrange(65536)) for _ in range(500)], "c0 long, c1 long")
    fingerprint.write(fingerprint.fingerprint(points, 4), str(tmp_path / "own"))
    reference = fingerprint.fingerprint(fingerprint.even_points(spark, 500), 4)
    assert sorted(reference) == ["correlation", "levels", "map", "pmf"]
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "own" / n))
    assert read("map").agg(F.sum("count")).first()[0] == 500 and read("map").count() == 1024
    assert read("levels").count() == reference["levels"].count()
    assert reference["levels"].orderBy(F.desc("level")).first()["var"] < read("levels").orderBy(F.desc("level")).first()["var"]


def test_box_without_randoms(spark):
    r = random.Random(7)
    points = spark.createDataFrame([(*(r.randrange(65536) for _ in range(3)), 1.0) for _ in range(300)], "c0 long, c1 long, c2 long, w double")
    full = spark.range(8**3).select(*[(F.floor(F.col("id") / 8**i) % 8 * 8192 + 4096).alias(f"c{i}") for i in range(3)], F.lit(1.0).alias("w"))
    box = {x.level: x for x in cells.box_field_stats(points, levels=[1, 2, 3]).collect()}
    for x in cells.field_stats(points, full, levels=[1, 2, 3]).collect():
        b = box[x.level]
        assert (b.mean_delta, b.var_delta, b.m3_delta, b.m4_delta) == pytest.approx((x.mean_delta, x.var_delta, x.m3_delta, x.m4_delta), abs=1e-9)
    assert windows.log_sides(1, 16, 3, 2.0) == sorted({round(10 ** (k / 6)) for k in range(8)} | {16})
    runs = multirun.plan(spark, [("a", 0.5, 0.25, 0.0, 0.0)])
    d = multirun.diagnostics(points, runs, 5).first()
    assert d.run == "a" and d.offset == "0.250000;0.000000;0.000000" and 0 < d.coverage < 0.5 and d.n_levels == 5


def test_window_cells_stand_for_a_large_random_catalog(spark):
    """A shell of even density over half the sky: window and randoms give the same pairs and the same estimate."""
    import numpy as np

    from pointloom.operators import cells, survey_window

    rng = np.random.default_rng(9)

    def shell(n):
        x = rng.uniform(-200, 200, (20 * n, 3))
        r = np.sqrt((x * x).sum(1))
        return x[(r > 100) & (r < 190) & (x[:, 2] > 0)][:n]

    def frame(x):
        k = np.floor((x + 200) / 400 * 65536).astype(int)
        return spark.createDataFrame([tuple(map(int, r)) for r in k], "c0 long, c1 long, c2 long")

    data, randoms = frame(np.concatenate([shell(1500), shell(40).repeat(10, 0) + rng.normal(0, 2, (400, 3))])), frame(shell(30000))
    mask = spark.range(12 * 64).select(F.col("id").alias("pix"), (healpix.centre(F.col("id"), 8)[1] > 1e-9).cast("double").alias("completeness")).where("completeness > 0")
    chi = np.linspace(100, 190, 91)
    window = survey_window.window_cells(spark, mask, 8, (chi, chi**2), [-200.0] * 3, 400.0, 6)
    total = window.agg(F.sum("w"), F.count("*")).first()
    assert abs(total[1] / 64**3 - 2 * math.pi / 3 * (190**3 - 100**3) / 400**3) < 0.01 and total[0] > 0
    got = {r.level: r for r in survey_window.xi_from_window(data, window, range(5), weight=None).collect()}
    want = {r.level: r for r in cells.xi_shells(data, randoms, levels=range(5), weight=None).collect()}
    share = lambda rows, k, of: rows[of][k] / sum(rows[x][k] for x in rows)
    for level in range(5):
        assert share(got, "rr", level) == pytest.approx(share(want, "rr", level), rel=0.05)
        assert got[level].xi == pytest.approx(want[level].xi, abs=0.05 + 0.05 * abs(want[level].xi))


def test_bands_are_orthonormal_over_the_survey(spark):
    rng, knots = np.random.default_rng(11), [20.0, 35.0, 50.0, 70.0, 100.0]
    x = rng.uniform(0, 150, (200, 3))
    randoms = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, c0 double, c1 double, c2 double")
    coefficients = continuous.compensated_bands(randoms, knots)
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(200, 1)]
    r = r[(r >= 20) & (r < 100)]
    t = np.array([np.interp(r, knots, np.eye(5)[k]) for k in range(5)])
    h = coefficients @ t
    assert np.allclose(h.mean(1), 0, atol=1e-10) and np.allclose(h @ h.T / len(r), np.eye(4), atol=1e-9)
    shown = spark.createDataFrame([(float(v),) for v in [10.0, *r[:50], 100.0]], "r double").select("r", *[f.alias(f"h{k}") for k, f in enumerate(continuous.bands(F.col("r"), knots, coefficients))]).collect()
    assert all(v[k + 1] == pytest.approx(0.0 if v.r in (10.0, 100.0) else coefficients[k] @ [np.interp(v.r, knots, np.eye(5)[j]) for j in range(5)], abs=1e-9) for v in shown for k in range(4))
    assert not continuous.compensated_bands(randoms.limit(0), knots).any()


def test_basis_weights_are_the_dense_filter(spark):
    """A smooth covariance on splines, which is indefinite here, against the dense solution."""
    rng = np.random.default_rng(12)
    x, n, radius = rng.uniform(0, 60, (80, 3)), 80, 15.0
    points = spark.createDataFrame([(i, *map(float, p), n / 60**3) for i, p in enumerate(x)], "id long, c0 double, c1 double, c2 double, nbar double")
    theta, basis = [1.5, 0.6, -0.2, 0.1, 0.05], lambda r: continuous.cubic_splines(r, 5, 0.5, 40.0)
    got = {r.id: r.weight for r in wiener.basis_weights(points, theta, basis, 0.5, 40.0, radius).collect()}
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    flat = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.ravel())], "i long, r double")
    values = np.array([v.c for v in flat.select("i", sum(F.lit(t) * f for t, f in zip(theta, basis(F.col("r")))).alias("c")).orderBy("i").collect()]).reshape(n, n)
    volume = 4 / 3 * math.pi * radius**3
    d = ((r < radius).sum(1) - 1) / volume / (n / 60**3) - 1
    d = d - d.mean()
    c = np.where(r < 40, values, 0.0)
    np.fill_diagonal(c, 1.5)
    want = 1 + c @ np.linalg.solve(c + np.eye(n) * (1 / (n / 60**3 * volume) + 1e-6 * 1.5), d)
    assert np.abs(np.array([got[i] for i in range(n)]) - want).max() < 1e-3 * np.abs(want).max()


def test_pairs_by_regions_are_brute_force(spark):
    """Points that share a place or an id, which never meets itself however far it lies, and a region without a name."""
    r = random.Random(8)
    rows = [(i if i % 9 else i % 4, *(float(r.randrange(12) * 5) for _ in range(3)), r.choice(["a", "b", None]), float(r.randrange(1, 4))) for i in range(400)]
    rows += [(1000 + i, *row[1:]) for i, row in enumerate(rows[:60])]
    rp, pi, want = [0.0, 5.0, 10.0, 15.0], [0.0, 5.0, 15.0], {}
    for k, (i, *p, one, v) in enumerate(rows):
        for j, *q, two, w in rows[:k]:
            d2, sight = sum((x - y) ** 2 for x, y in zip(p, q, strict=True)), math.sqrt(sum(((x + y) / 2) ** 2 for x, y in zip(p, q, strict=True)))
            along = abs(sum((y - x) * (x + y) / 2 for x, y in zip(p, q, strict=True)) / sight) if sight else 0.0
            across = math.sqrt(max(0.0, d2 - along * along))
            if i != j and across < rp[-1] and along < pi[-1]:
                at = (sum(across >= e for e in rp) - 1, sum(along >= e for e in pi) - 1, *sorted((str(one), str(two))))
                want[at] = want.get(at, 0.0) + v * w
    data, got = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, region string, w double"), {}
    for x in survey_window._by_regions(data, rp, pi, ["c0", "c1", "c2"], "w", "region").collect():
        at = (x.rp_bin, x.pi_bin, *sorted((str(x.one), str(x.two))))
        got[at] = got.get(at, 0.0) + x.dd
    assert {k: v for k, v in got.items() if v} == want


def test_root_reaches():
    for edge in (0.1, 1 / 3, 500.0, 2000.0, 1e-9):
        x = survey_window._root_reaches(edge)
        assert math.sqrt(x) >= edge > math.sqrt(math.nextafter(x, 0.0))
