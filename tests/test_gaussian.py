"""Nearest neighbours, Gaussian conditioning, kernel likelihoods, posterior maxima and quadratic fits against dense computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import gaussian, neighbours

SCHEMA = "id long, c0 double, c1 double, c2 double"


def frame(spark, x, **columns):
    kinds = {k: "boolean" if isinstance(v[0], (bool, np.bool_)) else "int" if isinstance(v[0], (int, np.integer)) else "double" for k, v in columns.items()}
    rows = [(i, *map(float, p), *[v[i].item() if hasattr(v[i], "item") else v[i] for v in columns.values()]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {k} {t}" for k, t in kinds.items())).repartition(4)


def nearest(a, b, k, same=False, box=None, ga=None, gb=None):
    out = {}
    for i, p in enumerate(a):
        d = np.abs(b - p)
        d = np.minimum(d, box - d) if box else d
        d2 = d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2
        found = sorted((d2[j], j) for j in range(len(b)) if not (same and i == j) and (ga is None or ga[i] == gb[j]))[:k]
        if found:
            out[i] = [j for _, j in found]
    return out


RNG = np.random.default_rng(5)
EVEN = RNG.integers(0, 1000, (300, 3)).astype(float)
CLUMPED = np.concatenate([EVEN[:150], 500 + RNG.integers(0, 3, (100, 3)), np.repeat([[10.0, 10, 10]], 60, 0), 700 + RNG.random((40, 3)) * 1e-3])


@pytest.mark.parametrize(
    "a, b, k, settings",
    [(EVEN, EVEN[:200] + 1, 4, {}), (CLUMPED, CLUMPED, 5, {"same": True}), (EVEN % 100, (EVEN + 3) % 100, 6, {"box": 100.0}), (CLUMPED, CLUMPED[::3], 20, {}), (EVEN[:5], EVEN[:3], 7, {}), (CLUMPED, CLUMPED, 3, {"same": True, "ga": np.arange(350) % 3, "gb": np.arange(350) % 2})],
)
def test_nearest_are_brute_force(spark, a, b, k, settings):
    keyed = "ga" in settings
    fa, fb = frame(spark, a, **({"g": settings["ga"]} if keyed else {})), frame(spark, b, **({"g": settings["gb"]} if keyed else {}))
    got = {}
    for r in neighbours.k_nearest(fa, fb, k, same=settings.get("same", False), box=settings.get("box"), by=["g"] if keyed else []).collect():
        got.setdefault(r.a_id, {})[r["rank"]] = r.b_id
    assert {i: [v[x] for x in sorted(v)] for i, v in got.items()} == nearest(a, b, k, **settings)


def test_nearest_without_points_or_coordinates(spark):
    odd = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 2.0, 3.0), (3, float("inf"), 0.0, 0.0), (4, float("nan"), 0.0, 0.0)], SCHEMA)
    assert [(r.a_id, r.b_id) for r in neighbours.k_nearest(odd, odd, 2).collect()] == [(1, 1)]
    assert neighbours.k_nearest(odd, odd.limit(0), 2).count() == 0 and neighbours.k_nearest(odd.limit(0), odd, 2).count() == 0
    assert neighbours.k_nearest(odd, odd, 2, same=True).count() == 0


def covariance(x, y, theta, kernel):
    r = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    return kernel(r, theta)[0]


def loss_of(x, y, theta, kernel):
    c = covariance(x, x, theta, kernel)
    return 0.5 * y @ np.linalg.solve(c, y) + 0.5 * np.linalg.slogdet(c)[1]


def generations(spark, n):
    h = F.xxhash64(F.lit(17), F.col("id"))
    by = {r.id: int(r.h) for r in spark.range(n).select("id", h.alias("h")).collect()}
    return np.array([min(62, (by[i] & -by[i]).bit_length() - 1) for i in range(n)])


def dense_precision(spark, x, k, theta, kernel, full):
    """The inverse covariance of the conditioning by plain loops."""
    g, n = generations(spark, len(x)), len(x)
    first = min(t for t in range(64) if (g >= t).sum() <= full)
    q = np.zeros((n, n))
    top = np.flatnonzero(g >= first)
    q[np.ix_(top, top)] += np.linalg.inv(covariance(x[top], x[top], theta, kernel))
    for i in np.flatnonzero(g < first):
        before = np.flatnonzero(g > g[i])
        near = before[np.argsort(((x[before] - x[i]) ** 2).sum(1), kind="stable")[:k]]
        w = np.linalg.solve(covariance(x[near], x[near], theta, kernel), covariance(x[near], x[[i]], theta, kernel)[:, 0])
        left = covariance(x[[i]], x[[i]], theta, kernel)[0, 0] - w @ covariance(x[near], x[[i]], theta, kernel)[:, 0]
        of, e = np.r_[i, near], np.r_[1, -w]
        q[np.ix_(of, of)] += np.outer(e, e) / left
    return q


@pytest.mark.parametrize("kernel", [gaussian.rbf, gaussian.exponential])
def test_likelihood_of_few_points_is_the_dense_one(spark, monkeypatch, kernel):
    monkeypatch.setattr(gaussian, "FULL", 100)
    x, theta = RNG.random((60, 3)), [0.3, math.log(0.4)]
    y = np.sin(5 * x[:, 0]) + 0.1 * RNG.normal(size=60)
    factors = gaussian.conditioning(frame(spark, x, value=y), 5)
    got = gaussian.likelihood(factors, kernel, theta).first()
    assert got.n == 60 and got.loss == pytest.approx(loss_of(x, y, theta, kernel), rel=1e-9)
    h = 1e-4
    at = lambda a, b: loss_of(x, y, [theta[0] + a * h, theta[1] + b * h], kernel)
    assert got.gradient == pytest.approx([(at(1, 0) - at(-1, 0)) / (2 * h), (at(0, 1) - at(0, -1)) / (2 * h)], rel=1e-4, abs=1e-3)
    cross = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * h * h)
    assert got.hessian == pytest.approx([(at(1, 0) - 2 * at(0, 0) + at(-1, 0)) / h**2, cross, cross, (at(0, 1) - 2 * at(0, 0) + at(0, -1)) / h**2], rel=2e-3, abs=2e-2)


def test_likelihood_and_precision_of_the_neighbour_conditioning(spark, monkeypatch):
    monkeypatch.setattr(gaussian, "FULL", 20)
    x, theta = RNG.random((200, 3)), [0.0, math.log(0.3)]
    y = np.cos(4 * x[:, 1])
    q = dense_precision(spark, x, 7, theta, gaussian.rbf, 20)
    factors = gaussian.conditioning(frame(spark, x, value=y), 7)
    got = np.zeros_like(q)
    for r in gaussian.precision(factors, gaussian.rbf, theta).collect():
        got[r.i, r.j] += r.q
    assert np.abs(got - q).max() <= 1e-7 * np.abs(q).max()
    assert gaussian.likelihood(factors, gaussian.rbf, theta).first().loss == pytest.approx(0.5 * y @ q @ y - 0.5 * np.linalg.slogdet(q)[1], rel=1e-7)


def test_fitted_kernel_is_the_likeliest(spark, monkeypatch):
    monkeypatch.setattr(gaussian, "FULL", 30)
    x = RNG.random((150, 3))
    true = [0.5, math.log(0.25)]
    y = np.linalg.cholesky(covariance(x, x, true, gaussian.exponential)) @ RNG.normal(size=150)
    factors = gaussian.conditioning(frame(spark, x, value=y), 10)
    theta, fisher, losses = gaussian.fit_kernel(factors, gaussian.exponential, [0.0, math.log(0.5)])
    assert all(b < a for a, b in zip(losses, losses[1:])) and np.all(np.linalg.eigvalsh(fisher) > 0)
    assert np.abs(gaussian.likelihood(factors, gaussian.exponential, theta).first().gradient).max() < 1e-2
    assert np.abs(np.array(theta) - true) @ fisher @ np.abs(np.array(theta) - true) < 25  # within errors of the truth


def newton(q, counted, mean, form):
    x, share = np.zeros(len(q)), mean / max(1, (~counted).sum())
    for _ in range(60):
        if form == "log":
            slope, bend = np.where(counted, -1, share * np.exp(x)), np.where(counted, 0, share * np.exp(x))
            cost = lambda v: np.where(counted, -v, share * np.exp(v)).sum()
        else:
            slope, bend = np.where(counted, -1 / (1 + x), np.where(1 + x > 0, share, 0)), np.where(counted, 1 / (1 + x) ** 2, 0)
            cost = lambda v: np.where(counted, -np.log(np.maximum(1 + v, 1e-10)), share * np.maximum(1 + v, 0)).sum()
        s, t = np.linalg.solve(q + np.diag(bend), -(q @ x + slope)), 1.0
        loss = lambda v: 0.5 * v @ q @ v + cost(v)  # noqa: B023, E731
        while loss(x + t * s) > loss(x) and t > 1e-6:
            t /= 2
        x = x + t * s
    return x, loss(x)


@pytest.mark.parametrize("form, block, kernel", [("log", 1024, gaussian.rbf), ("density", 60, gaussian.exponential)])
def test_field_is_the_dense_optimum(spark, monkeypatch, form, block, kernel):
    monkeypatch.setattr(gaussian, "FULL", 40)
    monkeypatch.setattr(gaussian, "BLOCK", block)
    n = 300 if form == "log" else 150
    x = np.concatenate([0.5 + 0.12 * RNG.normal(size=(n // 3, 3)), RNG.random((n - n // 3, 3))])
    counted, theta = np.arange(n) < n // 3, [math.log(0.5 if form == "log" else 0.05), math.log(0.2)]  # densities that stay above 0
    points = frame(spark, x, counted=counted)
    field, losses = gaussian.map_field(points, gaussian.conditioning(points.withColumn("value", F.lit(0.0)), 8), kernel, theta, n / 3, form, tolerance=1e-7)
    want, least = newton(dense_precision(spark, x, 8, theta, kernel, 40), counted, n / 3, form)
    got = {r.id: r for r in field.collect()}
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] == pytest.approx(least, rel=1e-5)
    assert np.abs(np.array([got[i].field for i in range(n)]) - want).max() < 3e-3 * max(1, np.abs(want).max())
    assert got[7].delta == pytest.approx(math.exp(got[7].field) - 1 if form == "log" else got[7].field)


@pytest.mark.parametrize("box", [None, 1.0])
def test_quadratic_fields_are_fitted_exactly(spark, box):
    """A quadratic field comes back; in a box a point near the wall sees its images."""
    x = RNG.random((200, 3))
    h, g = np.array([[2.0, 0.5, -0.3], [0.5, -1.0, 0.2], [-0.3, 0.2, -3.0]]), np.array([0.3, -0.2, 0.1])
    y = x @ g + 0.5 * np.einsum("ni,ij,nj->n", x, h, x)
    got = {r.id: r for r in gaussian.quadratic_fits(frame(spark, x, value=y), 20, box=box).collect()}
    assert len(got) == 200
    inner = [i for i in range(200) if box is None or np.all(np.abs(x[i] - 0.5) < 0.1)]
    for i in inner:
        assert got[i].gradient == pytest.approx(g + h @ x[i], abs=1e-7) and got[i].hessian == pytest.approx(h.ravel(), abs=1e-5)
    i = inner[0]
    assert got[i].eigenvalues == pytest.approx(np.linalg.eigvalsh(h)[::-1], abs=1e-5) and got[i].web == "filament" and got[i].laplacian == pytest.approx(-2, abs=1e-5)
    free = h + np.eye(3) * 2 / 3
    assert got[i].shear2 == pytest.approx((free * free).sum(), abs=1e-4)


def test_quadratic_fits_of_few_points(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 0.0, 3.0), (3, None, 0.0, 0.0, 3.0), (4, 0.0, 0.0, 0.0, None)]
    got = {r.id: r for r in gaussian.quadratic_fits(spark.createDataFrame(rows, SCHEMA + ", value double"), 20).collect()}
    assert set(got) == {1, 2} and got[1].gradient[0] == pytest.approx(2 / 1.25) and got[1].hessian[0] == pytest.approx(1 / 1.25)
    alone = gaussian.quadratic_fits(spark.createDataFrame(rows[:1], SCHEMA + ", value double"), 20).first()
    assert alone.gradient == [0.0] * 3 and alone.web == "void"


def test_derivatives_of_the_conditional_mean(spark, monkeypatch):
    monkeypatch.setattr(gaussian, "FULL", 15)
    x, theta = RNG.random((60, 3)), [0.2, math.log(0.5)]
    y = np.sin(3 * x[:, 0]) * x[:, 1]
    factors = gaussian.conditioning(frame(spark, x, value=y), 9)
    given = {r.id: [n.id for n in r.near] for r in factors.collect()}
    top = given.pop(None)
    got = {r.id: r for r in gaussian.derivatives(factors, theta).collect()}
    assert set(got) == set(range(60))
    h = 1e-5
    for i in range(0, 60, 7):
        near = given.get(i, top)
        w = np.linalg.solve(covariance(x[near], x[near], theta, gaussian.rbf), y[near])
        smooth = lambda p: math.exp(theta[0]) * np.exp(-((x[near] - p) ** 2).sum(1) / (2 * math.exp(theta[1]) ** 2)) @ w  # noqa: B023, E731
        for a in range(3):
            e = np.eye(3)[a] * h
            assert got[i].gradient[a] == pytest.approx((smooth(x[i] + e) - smooth(x[i] - e)) / (2 * h), rel=1e-3, abs=1e-3)
            assert got[i].hessian[4 * a] == pytest.approx((smooth(x[i] + 100 * e) - 2 * smooth(x[i]) + smooth(x[i] - 100 * e)) / (100 * h) ** 2, rel=1e-2, abs=5e-2)


def test_kernels_of_two_halves(spark):
    x = RNG.random((80, 3))
    label = np.arange(80) * 1.0
    got = {r.half: r for r in gaussian.clustering_by_label(frame(spark, x, label=label), "label", 6, gaussian.exponential, [math.log(0.5), math.log(0.3)], steps=3).collect()}
    assert set(got) == {"high", "low"} and got["high"].n + got["low"].n == 80 and all(len(r.theta) == 2 for r in got.values())


def test_points_at_one_place(spark):
    """Twins with values of their own: the jitter is each point's, so their matrix can be inverted."""
    x = np.repeat(RNG.random((200, 3)), 2, axis=0)
    theta = [0.0, math.log(0.5)]
    factors = gaussian.conditioning(frame(spark, x, value=RNG.normal(size=400)), 6)
    row = gaussian.likelihood(factors, gaussian.exponential, theta).first()
    assert row.n == 400 and np.isfinite([row.loss, *row.gradient, *row.hessian]).all()
    found = gaussian.derivatives(factors, theta).collect()
    assert len(found) == 400 and np.isfinite([[r.mean, *r.gradient, *r.hessian] for r in found]).all()


def test_nearest_rows_are_found_in_place(spark, monkeypatch):
    """A clump beside a void, over many groups and parts; every table cut on the way is a small multiple of the input, no row a candidate."""
    r = random.Random(11)
    rows = [(i, *(r.randrange(64) for _ in range(3))) for i in range(1500)] + [(2000 + i, *(r.randrange(65536) for _ in range(3))) for i in range(100)] + [(3000 + i, 7, 7, 7) for i in range(200)]
    points = spark.createDataFrame(rows, "id long, c0 long, c1 long, c2 long")
    monkeypatch.setattr(neighbours, "GROUP", 100)
    monkeypatch.setattr(neighbours, "MINE", 40)
    monkeypatch.setattr(neighbours, "THEIRS", 300)
    sizes, cut = [], neighbours.cut
    monkeypatch.setattr(neighbours, "cut", lambda df: sizes.append(cut(df)) or sizes[-1])
    found = {}
    for n in neighbours.k_nearest(points, points, 20, same=True).collect():
        found.setdefault(n.a_id, []).append((n["rank"], n.d2, n.b_id))
    for i, *at in rows[::7]:
        near = sorted((sum((x - y) ** 2 for x, y in zip(at, other, strict=True)), j) for j, *other in rows if j != i)[:20]
        assert sorted(found[i]) == [(rank, *p) for rank, p in enumerate(near, 1)]
    assert max(df.count() for df in sizes) <= 5 * len(rows)
