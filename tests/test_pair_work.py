"""Pair and triangle sums of larger tables: no row for a pair, places that repeat, boxes without a range join."""

import math

import numpy as np
import pytest


from pointloom.operators import graph, pairs, tiles


def _points(spark, at, w=None):
    rows = [(i, *map(float, p), float(1 + i % 3) if w is None else float(w[i])) for i, p in enumerate(at)]
    return spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, w double")


def _clump(seed, n=120, top=60):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.integers(0, top, (n, 3)), rng.integers(25, 35, (n // 2, 3)), np.full((6, 3), 30)]).astype(float)  # a clump and a pile


def _d2(a, b):
    return ((a[:, None] - b[None]) ** 2).sum(-1)


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("shift", [0.0, 0.125])
@pytest.mark.parametrize("most", [None, 40])
def test_triangles_have_no_wedges(spark, monkeypatch, shift, most):
    """Whole and broken coordinates, tiles that are dealt over parts; the plan joins no edges."""
    if most:
        monkeypatch.setattr(tiles, "MINE", most)
        monkeypatch.setattr(tiles, "THEIRS", 2 * most)
        monkeypatch.setattr(tiles, "PIECE", 16)
    at = _clump(2) + shift * np.arange(186)[:, None] % 1
    near = (_d2(at, at) >= 64) & (_d2(at, at) <= 144)
    a = near.astype(float)
    want = {i: int(n) for i, n in enumerate(((a @ a) * a).sum(1) / 2) if n}
    df = pairs.triangles(_points(spark, at), 10.0, 2.0)
    assert {r.id: r.n for r in df.collect()} == want
    assert "SortMergeJoin" not in _plan(df) and "ShuffledHashJoin" not in _plan(df)
    row = graph.three_point(_points(spark, at), _points(spark, at[:150]), [10.0], 2.0).first()
    assert (row.ddd, row.rrr) == (sum(want.values()) // 3, int(((a[:150, :150] @ a[:150, :150]) * a[:150, :150]).sum()) // 6)


def test_triangles_of_an_id_that_repeats(spark):
    """Rows of one id are one vertex, as in the SQL."""
    rows = [(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0), (3, 5.0, 8.5, 0.0), (1, 500.0, 0.0, 0.0), (4, 510.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double")
    assert {r.id: r.n for r in pairs.triangles(df, 10.0, 2.0).collect()} == {1: 1, 2: 1, 3: 1}


def test_box_counts_join_no_cells(spark):
    """Shortest images by tiles: weighted pairs and neighbour counts of a periodic box; the plan has no range join."""
    at, box = _clump(5, top=100), 100.0
    w, other = np.array([1.0 + i % 3 for i in range(len(at))]), _clump(6, top=100)
    shortest = lambda a, b: (np.minimum(abs(a[:, None] - b[None]), box - abs(a[:, None] - b[None])) ** 2).sum(-1)
    edges, df = [4.0, 20.0, 50.0], _points(spark, at)
    d2 = shortest(at, at)
    want = [((d2 >= lo * lo) & (d2 < hi * hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    h = pairs.pair_histogram(df, None, edges, box=box)
    assert "ShuffledHashJoin" not in _plan(h)
    assert [(r.npairs, r.wpairs) for r in h.orderBy("bin").collect()] == [(int(m.sum()), float(w @ m @ w)) for m in want]
    assert {(r.id, r.bin): r.n for r in pairs.per_point_counts(df, None, edges, box=box).collect()} == {(i, k): int(n) for k, m in enumerate(want) for i, n in enumerate(m.sum(1)) if n}
    near = (shortest(at, other) < 30.0**2) & (np.arange(len(at))[:, None] != np.arange(len(other))[None])
    n = pairs.neighbour_density(df, _points(spark, other), 30.0, box=box)
    assert "ShuffledHashJoin" not in _plan(n) and {r.id: r.n for r in n.collect()} == dict(enumerate(near.sum(1).tolist()))
    with pytest.raises(ValueError):
        pairs.pair_histogram(df, None, [1.0, 51.0], box=box)


def _repeating(spark):
    """A pile, an id that repeats at two places and at one, and a row without an id, with all pairs of different ids."""
    at = _clump(8)
    ids = np.arange(len(at)).tolist()
    ids[7], ids[181] = 3, 180
    w = np.array([1.0 + i % 3 for i in range(len(at))])
    rows = [(i, *map(float, p), float(v)) for i, p, v in zip(ids, at, w, strict=True)] + [(None, 30.0, 30.0, 30.0, 2.0)]
    other = np.triu(np.array(ids)[:, None] != np.array(ids)[None], 1)
    return spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, w double"), at, np.array(ids), w, other


@pytest.mark.parametrize("rp", [[0.0, 6.0, 15.0], [3.0, 9.0, 20.0]])
def test_places_count_their_pairs_once(spark, monkeypatch, rp):
    """rp-pi counts, kernel sums and their totals where places and ids repeat, with dealt tiles."""
    from pointloom.functions.kernels import ARRAY_KERNELS
    from pointloom.operators import continuous

    monkeypatch.setattr(tiles, "MINE", 40)
    monkeypatch.setattr(tiles, "THEIRS", 80)
    df, at, ids, w, other = _repeating(spark)
    pi_edges = [0.0, 5.0, 12.0]
    gap, mid = at[None] - at[:, None], (at[:, None] + at[None]) / 2
    pi = np.abs((gap * mid).sum(-1)) / np.sqrt((mid * mid).sum(-1))
    across = np.sqrt(np.maximum((gap * gap).sum(-1) - pi * pi, 0))
    want = {}
    for i in range(2):
        for j in range(2):
            m = other & (across >= rp[i]) & (across < rp[i + 1]) & (pi >= pi_edges[j]) & (pi < pi_edges[j + 1])
            if m.any():
                want[i, j] = (int(m.sum()), float(w @ m @ w))
    c = pairs.rp_pi_counts(df, None, rp, pi_edges)
    assert {(r.rp_bin, r.pi_bin): (r.npairs, r.wpairs) for r in c.collect()} == want
    r = np.sqrt(_d2(at, at))
    k = ARRAY_KERNELS["top_hat"](r, 8.0) * (r < 16.0)
    both = k * (other | other.T)
    sums = {int(i): both[ids == i].sum() for i in ids}
    got = {x.id: x.s for x in pairs.kernel_sums(df, None, 8.0).collect()}
    assert got.keys() == {i for i in sums if sums[i] > 0} and all(got[i] == pytest.approx(sums[i], rel=1e-9) for i in got)
    s = continuous.sigma2_data_only(df.where("id is not null"), 8.0, 1e-6).first().sigma2
    assert s == pytest.approx(((w @ (k * other) @ w) / ((w.sum() ** 2 - w @ w) / 2) - 1e-6) / 1e-6, rel=1e-9)


@pytest.mark.parametrize("knots", [[0.0, 8.0, 20.0], [5.0, 12.0, 14.0, 20.0]])
def test_basis_sums_of_places(spark, knots):
    """Tents and Chebyshev polynomials fitted to sums by tiles, against all pairs."""
    from pointloom.operators import continuous

    rng = np.random.default_rng(11)
    at, random_ = _clump(9), np.concatenate([rng.integers(0, 60, (250, 3)), np.full((4, 3), 20)]).astype(float)
    frames = _points(spark, at), _points(spark, random_)
    triples = []
    for a, b in ((at, None), (at, random_), (random_, None)):
        gap, mid = ((a if b is None else b)[None] - a[:, None]), (a[:, None] + (a if b is None else b)[None]) / 2
        pi = np.abs((gap * mid).sum(-1)) / np.sqrt((mid * mid).sum(-1))
        d2 = (gap * gap).sum(-1)
        keep = np.triu(np.ones_like(d2, bool), 1) if b is None else np.ones_like(d2, bool)
        triples.append((np.sqrt(d2)[keep], np.sqrt(np.maximum(d2 - pi * pi, 0))[keep], pi[keep], len(a) * (len(a) - 1) / 2 if b is None else a.shape[0] * b.shape[0]))

    def fit(basis):
        (dd, _), (dr, _), (rr, gram) = [((f := basis(*t[:3])).sum(1) / t[3], f @ f.T / t[3]) for t in triples]
        return np.linalg.lstsq(gram, dd - 2 * dr + rr, rcond=None)[0]

    tent = lambda r, rp, pi: np.array([np.interp(r, knots, row) for row in np.eye(len(knots))]) * ((r >= knots[0]) & (r < knots[-1]))
    assert continuous.xi_basis(*frames, knots) == pytest.approx(fit(tent), rel=1e-7)
    if knots[0]:
        cheb = lambda r, rp, pi: np.array([np.cos(k * np.arccos(np.clip(2 * np.log(np.maximum(rp, 1e-9) / 2.0) / math.log(8) - 1, -1, 1))) for k in range(4)]) * ((rp >= 2) & (rp < 16) & (pi < 10))
        assert continuous.wp_chebyshev(*frames, 2.0, 16.0, 10.0) == pytest.approx(20 * fit(cheb), rel=1e-6)


def test_redshift_bins_of_one_place(spark):
    """Points at one place with other redshifts are pairs at no distance."""
    rows = [(1, 10.0, 0.0, 0.0, 0.5), (2, 10.0, 0.0, 0.0, 0.5), (3, 10.0, 0.0, 0.0, 1.5), (4, 12.0, 0.0, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, z double")
    c = pairs.rp_pi_counts(df, None, [0.0, 1.0], [0.0, 1.0, 3.0], weight=None, z="z", z_edges=[0.0, 0.8, 1.2])
    assert {(r.rp_bin, r.pi_bin, r.z_bin): r.npairs for r in c.collect()} == {(0, 0, 0): 1, (0, 0, 1): 2, (0, 1, 0): 2, (0, 1, 1): 1}


def test_rounds_of_the_posterior_keep_their_size(spark):
    """Each round joins what the last has joined: the estimate of the state's size stays that of a table. The blocks' solution is a block diagonal one."""
    from pointloom.operators import gaussian

    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.uniform(0, 100, 3)), bool(i % 2)) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, counted boolean")
    q = np.eye(40) * 4 + np.diag(np.full(39, -1.0), 1) + np.diag(np.full(39, -1.0), -1)
    entries = spark.createDataFrame([(int(i), int(j), float(q[i, j])) for i, j in zip(*np.nonzero(q), strict=True)], "i long, j long, q double")
    blocks, members = gaussian._blocks(points, entries, ["c0", "c1", "c2"])
    b = rng.normal(size=40)
    now = spark.createDataFrame([(i, bool(i % 2), 0.0, 0.0, 0.5, 0.0, float(v)) for i, v in enumerate(b)], "id long, counted boolean, x double, qx double, w double, s double, r double")
    one = {r.id: (r.q, r.y) for r in gaussian._in_blocks(blocks, members, now, "r", True).collect()}
    a = q + 0.5 * np.eye(40)
    assert [one[i][0] for i in range(40)] == pytest.approx((a @ b).tolist()) and [one[i][1] for i in range(40)] == pytest.approx(b.tolist())  # all in one block
    found = gaussian._descend(now, blocks, members, 12, 0.0)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 12
    assert [r.s for r in found.orderBy("id").collect()] == pytest.approx(np.linalg.solve(a, b).tolist(), rel=1e-9)
