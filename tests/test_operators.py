"""Identities of the catalog operators on small made-up catalogs."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pointloom.functions import coords, cosmology, healpix, kernels
from pointloom.operators import cells, gradients, knn, pairs, rangejoin, vectors, windows
from pointloom.plans import multirun
from pointloom.sources import catalogs
from pointloom.streaming import cells as stream

AXES = ("c0", "c1", "c2")


def catalog(spark, n, seed, top=65536):
    r = random.Random(seed)
    rows = [(i, r.randrange(top), r.randrange(top), r.randrange(top), float(r.randrange(1, 4))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, c0 long, c1 long, c2 long, w double")


@pytest.fixture(scope="module")
def data(spark):
    rows, df = catalog(spark, 150, 1)
    return rows, df.cache()


@pytest.fixture(scope="module")
def randoms(spark):
    rows, df = catalog(spark, 400, 2)
    return rows, df.cache()


def d2(a, b, box=None):
    g = [abs(x - y) for x, y in zip(a[1:4], b[1:4])]
    if box:
        g = [min(x, box - x) for x in g]
    return sum(x * x for x in g)


@pytest.mark.parametrize("box", [None, 65536])
def test_range_join_is_brute_force(data, randoms, box):
    radius = 14000.0
    got = {(r.a_id, r.b_id): r.d2 for r in rangejoin.pairs(data[1], randoms[1], radius, AXES, box=box).collect()}
    want = {(a[0], b[0]): d2(a, b, box) for a in data[0] for b in randoms[0] if d2(a, b, box) < radius * radius}
    assert got == want


def test_range_join_of_dense_cells(spark):
    """Dense cells dealt over parts give the pairs of the plain join, each once."""
    r = random.Random(12)
    rows = [(i, *(r.gauss(0, 3 if i < 300 else 60) for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double")
    found = lambda **o: sorted((min(x.a_id, x.b_id), max(x.a_id, x.b_id)) for x in rangejoin.pairs(df, df, 5.0, **o).collect())
    assert found(hot=20) == found() and found(once=True, hot=20) == found(once=True) == sorted(set(p for p in found() if p[0] < p[1]))


def test_range_join_with_few_cells(data):
    radius = 30000.0
    got = sorted((r.a_id, r.b_id) for r in rangejoin.self_pairs(data[1], radius, AXES, box=65536).collect())
    assert got == sorted((a[0], b[0]) for a, b in combinations(data[0], 2) if d2(a, b, 65536) < radius * radius)
    with pytest.raises(ValueError):
        rangejoin.pairs(data[1], data[1], 40000.0, AXES, box=65536)


def test_per_point_counts_sum_to_pairs(data):
    edges = [2000.0, 8000.0, 15000.0]
    h = {r.bin: r.npairs for r in pairs.pair_histogram(data[1], None, edges).collect()}
    p = {r.bin: r.n for r in pairs.per_point_counts(data[1], None, edges).groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    assert h == {b: p.get(b, 0) for b in h}


def test_shells_sum_to_all_pairs(data):
    s = cells.pair_shells(data[1], levels=range(6)).collect()
    assert sum(r.n_pairs for r in s) == 150 * 149 // 2


def test_empty_catalog(spark, randoms):
    none = randoms[1].limit(0)
    assert cells.pair_shells(none).collect() == []
    assert pairs.binned_pairs(none, randoms[1], [1.0, 5000.0]).collect() == []
    assert [r.npairs for r in pairs.pair_histogram(none, None, [1.0, 2.0, 3.0]).collect()] == [0, 0]


def test_density_of_randoms_is_flat(randoms):
    s = cells.field_stats(randoms[1], randoms[1], levels=[1, 2]).collect()
    assert all(abs(r.var_delta) < 1e-12 and abs(r.mean_delta) < 1e-12 for r in s)


def numeric(f, rows, spark, i, eps=1e-4):
    out = []
    for sign in (1, -1):
        moved = [(*r[:4], r[4] + sign * eps) if r[0] == i else r for r in rows]
        out.append(f(spark.createDataFrame(moved, "id long, c0 long, c1 long, c2 long, w double")))
    return {k: (out[0][k] - out[1][k]) / (2 * eps) for k in out[0]}


@pytest.mark.parametrize("of", ["d", "r"])
@pytest.mark.parametrize("name", ["var", "m3", "m4", "s3"])
def test_field_gradients(spark, data, randoms, name, of):
    column = {"var": "var_delta", "m3": "m3_delta", "m4": "m4_delta", "s3": "s3_delta"}[name]

    def value(df):
        d, r = (df, randoms[1]) if of == "d" else (data[1], df)
        return {x.level: x[column] for x in cells.field_stats(d, r, levels=[1]).collect()}

    want = numeric(value, (data if of == "d" else randoms)[0], spark, 7)
    got = {r.level: r.value for r in gradients.field_gradient(data[1], randoms[1], name, of, levels=[1]).where("id = 7").collect()}
    assert got[1] == pytest.approx(want[1], rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("of", ["d", "r"])
def test_xi_gradient(spark, data, randoms, of):
    def value(df):
        d, r = (df, randoms[1]) if of == "d" else (data[1], df)
        return {x.level: x.xi for x in cells.xi_shells(d, r, levels=range(3)).collect()}

    want = numeric(value, (data if of == "d" else randoms)[0], spark, 11)
    got = {r.level: r.value for r in gradients.xi_gradient(data[1], randoms[1], of, levels=range(3)).where("id = 11").collect()}
    assert got == pytest.approx(want, rel=1e-4, abs=1e-8)


def test_haar_gradient(spark, data, randoms):
    def value(df):
        return {(x.level, x.pattern): x.mean_we2 for x in cells.haar_anisotropy(df, randoms[1], levels=[0]).collect()}

    want = numeric(value, data[0], spark, 3)
    got = {(r.level, r.pattern): r.value for r in gradients.haar_gradient(data[1], randoms[1], levels=[0]).where("id = 3").collect()}
    assert got == pytest.approx(want, rel=1e-4, abs=1e-8)


def test_gradient_along_weights_vanishes(data, randoms):
    g = gradients.field_gradient(data[1], randoms[1], "var", levels=[1, 2])
    assert all(abs(r.jvp) < 1e-9 for r in gradients.jvp(g, data[1].select("id", F.col("w").alias("v"))).collect())


def test_windows_conserve_points(data):
    pmf = windows.window_pmf(data[1], 3, [1, 3, 8], AXES).collect()
    for width in (1, 3, 8):
        assert sum(r.n * r.windows for r in pmf if r.width == width) == 150 * width**3
        assert sum(r.windows for r in pmf if r.width == width) == 512
    inside = windows.window_pmf(data[1], 3, [3], AXES, periodic=False).collect()
    assert sum(r.windows for r in inside) == 6**3


def test_knn_ladder_is_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(120):
        u, a = r.uniform(-1, 1), r.uniform(0, 2 * math.pi)
        rows.append((i, math.sqrt(1 - u * u) * math.cos(a), math.sqrt(1 - u * u) * math.sin(a), u, r.uniform(0.4, 2.1)))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, red double")
    thetas, zq, zn = [5.0, 20.0, 60.0], [0.5, 1.0, 2.0], [0.5, 1.25, 2.0]
    got = {(x.t, x.iq, x.jn, x.k): x.h for x in knn.knn_ladder(knn.cap_counts(df, df, thetas, zq, zn, True), 4).collect()}
    want = {}
    for a in rows:
        for iq in range(2):
            if not zq[iq] <= a[4] < zq[iq + 1]:
                continue
            for jn in range(2):
                for t, th in enumerate(thetas):
                    n = sum(1 for b in rows if b[0] != a[0] and zn[jn] <= b[4] < zn[jn + 1] and sum((x - y) ** 2 for x, y in zip(a[1:4], b[1:4])) <= coords.chord(th) ** 2)
                    for k in range(1, 5):
                        want[t, iq, jn, k] = want.get((t, iq, jn, k), 0) + (n >= k)
    assert got == want


def test_jackknife_of_equal_folds(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 2, None), (1, 0, 2.0), (1, 1, 2.0)], "bin int, region int, value double")
    got = {(r.a, r.b): r["cov"] for r in knn.jackknife_cov(s).collect()}
    assert got[0, 0] == pytest.approx(1.0) and got[0, 1] == 0


def test_healpix_areas(spark):
    n = spark.range(200000).select((F.rand(3) * 360).alias("ra"), (F.rand(4) * 2 - 1).alias("u")).groupBy(healpix.pixel(F.col("ra"), F.col("u"), 4).alias("p")).count().collect()
    assert {r.p for r in n} == set(range(192))
    assert all(abs(r["count"] - 200000 / 192) < 6 * math.sqrt(200000 / 192) for r in n)


def test_distance_is_monotone_and_clamped(spark):
    z = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (4.0,), (4.5,), (None,)], "z double")
    chi = [r.chi for r in cosmology.with_distance(z).orderBy(F.asc_nulls_last("z")).collect()]
    assert chi[0] == 0 and chi[0] < chi[1] < chi[2] < chi[3] == chi[4] and chi[5] is None
    assert chi[2] == pytest.approx(2318, rel=0.01)


def test_kernels_integrate_to_one(spark):
    r = spark.range(1, 20001).select((F.col("id") / 1000.0).alias("r"))
    for k in (kernels.top_hat(F.col("r"), 2.0), kernels.gauss(F.col("r"), 2.0), kernels.shell(F.col("r"), 2.0, 4.0)):
        assert r.agg(F.sum(4 * math.pi * F.col("r") ** 2 * k * 0.001)).first()[0] == pytest.approx(1, abs=1e-3)


def test_occupation_needs_erf(spark):
    m = spark.createDataFrame([(1e12,), (1e13,), (1e15,)], "m double")
    got = [r[0] for r in m.select(kernels.occupation(F.col("m"), 12.0, 0.3, 1e12, 2e13, 1.0)).collect()]
    assert got[0] == pytest.approx(0.5) and got[0] < got[1] < got[2]


def test_plan_identity_and_coverage(spark, data):
    runs = multirun.plan(spark, [("same", 1.0, 0.0, 0.0, 0.0), ("half", 0.5, 0.0, 0.0, 0.0)])
    out = multirun.apply(data[1], runs)
    same = sorted(tuple(r) for r in out.where("run = 'same'").select("id", *AXES).collect())
    assert same == sorted(r[:4] for r in data[0])
    cov = {r.run: r.coverage for r in multirun.coverage(data[1], runs).collect()}
    whole = sum(r[4] for r in data[0])
    assert cov["same"] == 1 and cov["half"] == pytest.approx(sum(r[4] for r in data[0] if max(r[1:4]) < 32768) / whole)
    assert len(multirun.shifted_grid(2, 3)) == 8 and any(r[1] == 1.0 for r in multirun.log_resizings(0.3, 2.0, 1, 3))


def test_raw_points_and_fits(spark, tmp_path):
    import numpy as np

    x = np.arange(12, dtype="<f8")
    (tmp_path / "p.bin").write_bytes(x.tobytes())
    got = catalogs.read_points_f64(spark, str(tmp_path / "p.bin"), 3).orderBy("row").collect()
    assert [(r.x0, r.x1, r.x2) for r in got] == [tuple(x[i : i + 3]) for i in (0, 3, 6, 9)]

    def header(*cards):
        raw = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
        return raw.ljust(-(-len(raw) // 2880) * 2880).encode()

    table = np.array([(1.5, 2), (2.5, 3)], [("ra", ">f8"), ("n", ">i4")]).tobytes()
    first = header(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0))
    second = header(("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 12), ("NAXIS2", 2), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TTYPE1", "'RA'"), ("TFORM1", "'D'"), ("TTYPE2", "'N'"), ("TFORM2", "'J'"))
    (tmp_path / "t.fits").write_bytes(first + second + table.ljust(2880, b"\0"))
    rows = catalogs.read_fits(spark, str(tmp_path / "t.fits"), ["RA", "N", "W"]).collect()
    assert [tuple(r) for r in rows] == [(1.5, 2.0, None), (2.5, 3.0, None)]


def test_halton_and_allotment(spark):
    got = [r[0] for r in spark.range(1, 5).select(catalogs.halton(F.col("id"), 2)).collect()]
    assert got == [0.5, 0.25, 0.75, 0.125]
    assert catalogs.allotted(10, {"N": 1, "S": 2}) == {"N": 3, "S": 7}


def test_drawn_redshifts_follow_the_histogram(spark):
    data = spark.createDataFrame([(0.1,)] * 3 + [(1.5,)], "z double")
    p = catalogs.sampled_redshifts(catalogs.uniform_sky(spark, 4000), data, [0.0, 1.0, 2.0])
    share = p.agg(F.avg((F.col("z") < 1).cast("int"))).first()[0]
    assert share == pytest.approx(0.75, abs=0.03)


def test_stream_of_cells_equals_batch(spark, data, tmp_path):
    data[1].repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(data[1].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.cell_counts(rows, levels=[0, 1]).writeStream.outputMode("complete").format("memory").queryName("cells_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("cells_now").collect())
    assert got == sorted(tuple(r) for r in stream.cell_counts(data[1], levels=[0, 1]).collect())


def test_pair_increments_sum_to_all_pairs(spark, data, tmp_path):
    data[1].repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(data[1].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.pair_increments(rows, levels=[0]).writeStream.outputMode("update").format("memory").queryName("pairs_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("pairs_now").agg(F.sum("new_pairs")).first()[0] == 150 * 149 // 2


def test_quantize_and_bins(spark):
    x = spark.createDataFrame([(-0.5,), (0.0,), (99.999,), (100.0,), (None,)], "x double")
    assert [r[0] for r in x.select(coords.quantize(F.col("x"), 100.0, 4)).collect()] == [15, 0, 15, 0, None]
    assert [r[0] for r in x.select(coords.bin_of(F.col("x"), [0.0, 50.0, 100.0])).collect()] == [None, 0, 1, None, None]


def test_k_nearest_is_brute_force(data, randoms):
    from pointloom.operators import neighbours

    got = {}
    for r in neighbours.k_nearest(data[1], randoms[1], 4).collect():
        got.setdefault(r.a_id, []).append((r.d2, r.b_id))
    for a in data[0]:
        assert sorted(got[a[0]]) == sorted((d2(a, b), b[0]) for b in randoms[0])[:4]


def test_conditional_mean_passes_through_known_points(spark):
    import numpy as np

    from pointloom.operators import graph

    rows = [(i, (i * 37) % 100 * 1.0, (i * 53) % 100 * 1.0, (i * 71) % 100 * 1.0, float(i % 5)) for i in range(40)]
    known = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, value double")
    got = {r.id: r["mean"] for r in graph.conditional_mean(known.drop("value"), known, lambda r: np.exp(-r / 50.0), 8).collect()}
    assert got == pytest.approx({r[0]: r[4] for r in rows}, abs=1e-2)


def test_conditional_mean_in_voids(spark):
    """Points far from all known points take the k nearest of the whole catalog; none vanishes."""
    import numpy as np

    from pointloom.operators import graph

    rows = [(i, (i * 37) % 11 * 1.0, (i * 53) % 13 * 1.0, (i * 71) % 17 * 1.0, float(i % 5)) for i in range(30)] + [(30, 400.0, 0.0, 0.0, 7.0)]
    points = [(1, 5.0, 5.0, 5.0), (2, 100.0, 90.0, -80.0), (3, 399.0, 0.0, 0.0), (4, -3000.0, 0.0, 0.0), (5, None, 0.0, 0.0)]
    known = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, value double")
    new = spark.createDataFrame(points, "id long, c0 double, c1 double, c2 double")
    covariance = lambda r: np.exp(-r / 500.0)

    def brute(at, k):
        x = np.array(sorted(rows, key=lambda r: (d2((0, *at), r), r[0]))[:k])
        c = covariance(np.sqrt(((x[:, None, 1:4] - x[None, :, 1:4]) ** 2).sum(-1))) + 1e-6 * np.eye(len(x))
        return covariance(np.sqrt(((x[:, 1:4] - at) ** 2).sum(-1))) @ np.linalg.solve(c, x[:, 4])

    for k in (6, 50):
        got = {r.id: r["mean"] for r in graph.conditional_mean(new, known, covariance, k).collect()}
        assert got == pytest.approx({p[0]: 0.0 if p[1] is None else brute(p[1:], k) for p in points}, abs=1e-6)
    assert {r.id: r["mean"] for r in graph.conditional_mean(new, known.limit(0), covariance, 6).collect()} == {p[0]: 0.0 for p in points}


def test_regions_are_balanced(spark):
    from pointloom.operators import fields

    sky = catalogs.uniform_sky(spark, 3000).withColumnRenamed("sin_dec", "u")
    regions = fields.jackknife_regions(sky, 4, 2)
    counts = sky.withColumn("pix", healpix.pixel(F.col("ra"), F.col("u"), 2)).join(regions, "pix").groupBy("region").count().collect()
    assert len(counts) == 4 and max(r["count"] for r in counts) - min(r["count"] for r in counts) < 100
    with pytest.raises(ValueError):
        fields.jackknife_regions(sky, 4, 4096)


def test_theory_curves():
    import numpy as np

    from pointloom.functions import theory

    edges, density = theory.unit_cube_kernel()
    assert (density * np.diff(edges)).sum() == pytest.approx(1) and theory.growth(0.0)[0] == pytest.approx(1) and theory.growth(1.0)[0] < 0.7
    k = theory.log_k_grid(1e-4, 100.0, 8192)
    power = np.exp(-(k**2))  # a Gaussian, whose transform is known
    assert theory.xi_from_power(1.0, k, power)[0] == pytest.approx((4 * math.pi) ** -1.5 * math.exp(-0.25), rel=1e-3)
    assert theory.sigma2_from_power(1e-3, k, power)[0] == pytest.approx((4 * math.pi) ** -1.5, rel=1e-3)


def test_pooled_runs_of_equal_shifts(data, randoms):
    runs = multirun.plan(data[1].sparkSession, [("a", 1.0, 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0, 0.0)])
    pooled = multirun.pooled(multirun.run_raw_sums(data[1], randoms[1], runs, levels=[1]), 0.01).collect()
    single = cells.field_stats(data[1], randoms[1], levels=[1]).first()
    assert len(pooled) == 1 and pooled[0].n_rows == 2 and pooled[0].across_runs == pytest.approx(0, abs=1e-15)
    assert pooled[0].var_delta == pytest.approx(single.var_delta) and pooled[0].t == pytest.approx(2 * single.t)


def test_basis_fit_of_shells(spark):
    shells = spark.createDataFrame([(10.0, 2.0, 0.1), (100.0, 1.0, 0.1), (1000.0, 0.5, 0.1), (50.0, None, 0.1)], "r double, xi double, var double")
    c, chi2 = multirun.fit_xi_continuous(shells, [10.0, 100.0, 1000.0])
    assert c == pytest.approx([2.0, 1.0, 0.5], abs=1e-6) and chi2 == pytest.approx(0, abs=1e-9)


def test_resizings_reach_both_ends():
    scales = lambda *a: [r[1] for r in multirun.log_resizings(*a, 3)]
    assert scales(0.5, 1.0, 1) == pytest.approx([0.5, 1.0])
    assert scales(0.2, 0.7, 1) == pytest.approx([0.2, 0.2 * 10 ** (1 / 3), 0.7])  # 0.7 off the grid, 1 outside
    assert scales(0.5, 2.0, 1) == pytest.approx([0.5, 1.0, 0.5 * 10 ** (1 / 3), 2.0])


def test_triangles_of_a_hub(spark):
    """A point with many partners: each triangle once at each of its corners."""
    r = random.Random(5)
    at = [(0, 0.0, 0.0, 0.0)] + [(i, *(r.uniform(-12, 12) for _ in range(3))) for i in range(1, 60)]
    near = lambda a, b: 8 <= math.dist(a[1:], b[1:]) <= 12
    want = Counter(p[0] for i, a in enumerate(at) for j, b in enumerate(at[:i]) for c in at[:j] if near(a, b) and near(b, c) and near(a, c) for p in (a, b, c))
    got = pairs.triangles(spark.createDataFrame(at, "id long, c0 double, c1 double, c2 double"), 10.0, 2.0).collect()
    assert {r.id: r.n for r in got} == want


def test_pair_sums_without_a_row_for_a_pair(spark, monkeypatch):
    """Counts and sums of tiles that are dealt over parts, against all pairs; and no join that could send copies of a catalog to the driver."""
    import numpy as np

    from pointloom.operators import tiles

    rng = np.random.default_rng(3)
    at = np.concatenate([rng.integers(0, 400, (300, 3)), rng.integers(190, 210, (300, 3)), np.full((40, 3), 200)]).astype(float)  # a clump and a pile
    rows = [(i, *map(float, p), float(1 + i % 3), i % 2) for i, p in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, w double, kind long")
    tops, w = [25.0, 400.0, 2500.0], np.array([r[4] for r in rows])
    d2 = ((at[:, None] - at[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    for most in (8_192, 50):
        monkeypatch.setattr(tiles, "MINE", most)
        monkeypatch.setattr(tiles, "THEIRS", 2 * most)
        for closed in (False, True):
            got = {(r.id, r.label): r for r in tiles.near_counts(df, df, tops, label="kind", weight="w", closed=closed, same=True).collect()}
            for i in range(len(rows)):
                for kind in (0, 1):
                    low = -1.0
                    for t, top in enumerate(tops):
                        inside = ((d2[i] > low) & (d2[i] <= top) if closed else (d2[i] >= max(low, 0.0)) & (d2[i] < top)) & (np.arange(len(rows)) % 2 == kind)
                        r = got.get((i, kind))
                        assert (r[f"n{t}"] if r else 0) == inside.sum() and abs((r[f"w{t}"] if r else 0.0) - w[inside].sum()) < 1e-9
                        low = top
        s = {r.id: r.s for r in pairs.kernel_sums(df, None, 25.0).collect()}
        x = np.sqrt(d2) / 25
        expected = np.where(x < 2, (1 - 0.75 * x + np.minimum(x, 9) ** 3 / 16) * 3 / (4 * np.pi * 25.0**3), 0.0).sum(1)
        assert all(abs(s.get(i, 0.0) - e) < 1e-12 for i, e in enumerate(expected))
    plan = rangejoin.pairs(df, df, 20.0)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_median_split_is_exact_on_many_rows(spark):
    from pointloom.operators import fields

    df = spark.range(0, 1_000_000, 1, 8).select(((F.col("id") * 7919) % 1_000_003).alias("label"))
    values = sorted(i * 7919 % 1_000_003 for i in range(1_000_000))
    assert fields._median(df, "label") == values[499_999]
    assert {r.half: r["count"] for r in fields.median_split(df, "label").groupBy("half").count().collect()} == {0: 500_000, 1: 500_000}
    odd = spark.createDataFrame([(3.0,), (None,), (1.0,), (3.0,)], "label double")
    assert sorted(str(r.half) for r in fields.median_split(odd, "label").collect()) == ["0", "0", "0", "None"]
    assert fields.median_split(odd.where("label is null"), "label").first().half is None


@pytest.mark.parametrize("part", [3, 100])
def test_near_counts_of_long_vectors(spark, monkeypatch, part):
    """Against all pairs: components by null or length missing, distances at the limit, ids given twice, huge and infinite values."""
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(60)]
    rows += [(3, [0.0] * 6), (60, [None, 1.0, 0.5]), (61, [None] * 6), (62, []), (63, None), (None, [0.5] * 6), (64, [0.5]), (65, [1e30] * 6), (66, [1e30] * 6), (67, [float("inf")] + [0.5] * 5), (68, [None] + [0.5] * 5), (69, [float("nan")] + [0.5] * 5)]

    def near(a, b):
        both = [(x, y) for x, y in zip(a, b, strict=False) if x is not None and y is not None]
        return bool(both) and sum((x - y) * (x - y) for x, y in both) < 1.25

    df = spark.createDataFrame(rows, "id long, v array<float>")
    whole = [x for x in rows if None not in x]
    for same in (True, False):
        expected = Counter()
        for i, a in whole:
            expected[i] += sum(near(a, b) and not (same and i == j) for j, b in whole)
        assert {x.id: x.n for x in vectors.near_counts(df, df, 1.25, "v", same).collect()} == {i: n for i, n in expected.items() if n}
