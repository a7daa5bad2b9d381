"""Continuous estimators: pair sums of basis functions, solved on the driver as small linear systems."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.coords import Sights, root_reaches
from pointloom.functions.kernels import ARRAY_KERNELS, SUPPORT
from pointloom.operators.neighbours import cut
from pointloom.operators.rangejoin import AXES, self_pairs
from pointloom.operators.tiles import BLOCK, PAIRED, inside_places, place_sums, places


def chebyshev(x: Column, n: int) -> list[Column]:
    """T_0 .. T_{n-1} of x in [-1, 1]."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return [F.lit(1.0) if k == 0 else F.cos(angle * k) for k in range(n)]


def tents(x: Column, knots: Sequence[float]) -> list[Column]:
    """Piecewise linear basis on knots, constant beyond the ends."""
    out = []
    held = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), x))
    for i, k in enumerate(knots):
        up = F.lit(1.0) if i == 0 else (held - F.lit(float(knots[i - 1]))) / F.lit(float(k - knots[i - 1]))
        down = F.lit(1.0) if i == len(knots) - 1 else (F.lit(float(knots[i + 1])) - held) / F.lit(float(knots[i + 1] - k))
        out.append(F.greatest(F.lit(0.0), F.least(up, down)))
    return out


def cubic_splines(x: Column, n: int, low: float, high: float) -> list[Column]:
    """``n`` cubic splines on knots spaced evenly in the logarithm, the end knots fourfold; 0 outside [low, high)."""
    if n < 4:
        raise ValueError("cubic splines are four at least")
    inner = [low * (high / low) ** (k / (n - 3)) for k in range(1, n - 3)]
    knots = [low] * 4 + inner + [high] * 4
    basis = [F.when((x >= F.lit(a)) & (x < F.lit(b)), 1.0).otherwise(0.0) if b > a else F.lit(0.0) for a, b in zip(knots[:-1], knots[1:], strict=True)]
    for degree in (1, 2, 3):
        rise = lambda k, e=degree: (x - F.lit(knots[k])) / F.lit(knots[k + e] - knots[k]) if knots[k + e] > knots[k] else F.lit(0.0)
        fall = lambda k, e=degree: (F.lit(knots[k + e]) - x) / F.lit(knots[k + e] - knots[k]) if knots[k + e] > knots[k] else F.lit(0.0)
        basis = [rise(k) * basis[k] + fall(k + 1) * basis[k + 1] for k in range(len(basis) - 1)]
    return basis


def waves(x: Column, ks: Sequence[float]) -> list[Column]:
    """sin(kx) / (kx) for each k, 1 where kx is 0."""
    return [F.when(x * F.lit(float(k)) == 0, 1.0).otherwise(F.sin(x * F.lit(float(k))) / (x * F.lit(float(k)))) for k in ks]


def _sums(p: DataFrame, basis: list[Column], gram: bool) -> tuple[np.ndarray, np.ndarray | None]:
    n = len(basis)
    held = p.select(*[b.alias(f"b{i}") for i, b in enumerate(basis)])
    wanted = [F.sum(f"b{i}").alias(f"s{i}") for i in range(n)]
    if gram:
        wanted += [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    row = held.agg(*wanted).first()
    s = np.array([row[f"s{i}"] or 0.0 for i in range(n)])
    return s, np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)]) if gram else None


def _moments(a: DataFrame, b: DataFrame | None, knots: Sequence[float], axes: Sequence[str]) -> list[np.ndarray]:
    """Number, sum and sum of squares of (r - middle of the knots) over the pairs between any two neighbouring knots, from places()."""
    squares, middle = [root_reaches(float(k)) for k in knots[:-1]] + [float(knots[-1]) ** 2], float(np.mean(knots))

    def work(mine, theirs):
        sums = np.zeros((len(knots) - 1, 3))

        def add(block, chunk, at, d2):
            m, w = mine["_n"][block], theirs["_n"][chunk]
            reached = [d2 >= t for t in squares]
            u = np.sqrt(np.minimum(d2, squares[-1], out=d2), out=d2)
            u -= middle
            for k in range(len(sums)):
                f = (reached[k] & ~reached[k + 1]).astype(np.float64)
                for power in range(3):
                    sums[k, power] += m @ f @ w
                    if power < 2:
                        f *= u

        return add, lambda: {"k": np.arange(len(sums), dtype=np.int32), **{f"m{i}": v for i, v in enumerate(sums.T)}}

    found = place_sums(a, b, knots[-1], work, "k int, m0 double, m1 double, m2 double", axes)
    if b is None and knots[0] <= 0:  # pairs of one place
        rows, n, _ = inside_places(a)
        found = found.unionByName(rows.select(F.lit(0).alias("k"), n.alias("m0"), (n * -middle).alias("m1"), (n * middle**2).alias("m2")))
    rows = {r["k"]: [r["m0"], r["m1"], r["m2"]] for r in found.groupBy("k").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(3)]).collect()}  # one row a knot
    return [np.array(rows.get(k, [0.0] * 3)) for k in range(len(knots) - 1)]


def _tent_sums(moments: list[np.ndarray], knots: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of tents and of their products: between two knots one falls and the other rises by the same part."""
    s, g, middle = np.zeros(len(knots)), np.zeros((len(knots),) * 2), float(np.mean(knots))
    for k, (m0, m1, m2) in enumerate(moments):
        width, low = knots[k + 1] - knots[k], knots[k] - middle
        t, t2 = (m1 - low * m0) / width, (m2 - 2 * low * m1 + low * low * m0) / width**2
        s[k : k + 2] += [m0 - t, t]
        g[k : k + 2, k : k + 2] += [[m0 - 2 * t + t2, t - t2], [t - t2, t2]]
    return s, g


def xi_basis(data: DataFrame, randoms: DataFrame, knots: Sequence[float], axes: Sequence[str] = AXES) -> list[float]:
    """Coefficients of xi(r) on tents: solve (sum_RR f f^T) c = sum_DD f - 2 sum_DR f + sum_RR f, each over its norm."""
    nd, nr = data.count(), randoms.count()
    d, r = (cut(places(df, axes)) for df in (data, randoms))
    found = []
    for a, b, norm in ((d, None, nd * (nd - 1) / 2), (d, r, nd * nr), (r, None, nr * (nr - 1) / 2)):
        found.append([x / max(norm, 1.0) for x in _tent_sums(_moments(a, b, knots, axes), knots)])
    (dd, _), (dr, _), (rr, gram) = found
    return [float(x) for x in np.linalg.lstsq(gram, dd - 2 * dr + rr, rcond=None)[0]]


def compensated_bands(randoms: DataFrame, knots: Sequence[float], axes: Sequence[str] = AXES, box: float | None = None) -> np.ndarray:
    """Coefficients on tents, by rows, of one band fewer than there are knots: functions of the separation that vanish on average over the survey's random pairs and are orthonormal over them.

    The survey's volume enters through its random pairs between the first and the last knot,
    whose Gram matrix of tents is summed on the executors. A band starts at its knot's tent and
    is made orthogonal to the constant, which all tents add up to, and to the bands before it.
    A band that no pair can tell from those before it is 0.
    """
    p = self_pairs(randoms, knots[-1], axes, box=box).where(F.col("d2") >= knots[0] ** 2)
    _, gram = _sums(p, tents(F.sqrt("d2"), knots), True)
    gram = gram / max(gram.sum(), 1.0)  # the tents add up to 1, so that this is the number of pairs
    found = [np.ones(len(knots))]
    for k in range(len(knots) - 1):
        band = np.eye(len(knots))[k]
        size = band @ gram @ band
        for _ in range(2):  # twice, against rounding
            for other in found:
                band = band - (other @ gram @ band) * other
        left = band @ gram @ band
        found.append(band / math.sqrt(left) if left > 1e-12 * size else np.zeros(len(knots)))
    return np.array(found[1:])


def bands(x: Column, knots: Sequence[float], coefficients: np.ndarray) -> list[Column]:
    """compensated_bands() as functions of a separation between the first and the last knot; 0 outside."""
    inside = (x >= F.lit(float(knots[0]))) & (x < F.lit(float(knots[-1])))
    t = tents(x, knots)
    return [F.when(inside, sum((F.lit(float(c)) * f for c, f in zip(row, t, strict=True)), F.lit(0.0))).otherwise(0.0) for row in coefficients]


def _chebyshev_sums(a: DataFrame, b: DataFrame | None, rp_min: float, rp_max: float, pi_max: float, n: int, axes: Sequence[str]) -> np.ndarray:
    """Sums of T_0 .. T_{n-1} of ln rp, which runs from -1 to 1, over the pairs of places()."""
    low, high, scale = root_reaches(rp_min), root_reaches(rp_max), 1 / math.log(rp_max / rp_min)

    def work(mine, theirs):
        sums, sights = np.zeros(n), Sights(mine["_at"], theirs["_at"], BLOCK * PAIRED)

        def add(block, chunk, at, d2):
            across, pi = sights(block, chunk, d2)
            inside = (across >= low) & (across < high) & (pi < pi_max)
            x = np.clip(np.log(across[inside]) * scale - (2 * math.log(rp_min) * scale + 1), -1.0, 1.0)
            w = np.multiply(mine["_n"][block][:, None], theirs["_n"][chunk][None])[inside]
            before, now = w, w * x
            for k in range(n):
                sums[k] += before.sum()
                before, now = now, 2 * x * now - before

        return add, lambda: {"k": np.arange(n, dtype=np.int32), "s": sums}, sights.narrow(rp_max, pi_max)

    found = place_sums(a, b, math.hypot(rp_max, pi_max), work, "k int, s double", axes)
    rows = {r["k"]: r["s"] for r in found.groupBy("k").agg(F.sum("s").alias("s")).collect()}  # n rows
    return np.array([rows.get(k, 0.0) for k in range(n)])


def wp_chebyshev(data: DataFrame, randoms: DataFrame, rp_min: float, rp_max: float, pi_max: float, n: int = 4, axes: Sequence[str] = AXES) -> list[float]:
    """Coefficients of wp on Chebyshev polynomials of ln rp: Landy-Szalay sums against the Gram matrix of random pairs, times 2 pi_max.

    Products of two polynomials are halves of sums of two others: T_i T_j = (T_{i+j} + T_{|i-j|}) / 2.
    """
    nd, nr = data.count(), randoms.count()
    d, r = (cut(places(df, axes)) for df in (data, randoms))
    found = []
    for a, b, norm in ((d, None, nd * (nd - 1) / 2), (d, r, nd * nr), (r, None, nr * (nr - 1) / 2)):
        found.append(_chebyshev_sums(a, b, rp_min, rp_max, pi_max, 2 * n - 1 if a is r else n, axes) / max(norm, 1.0))
    dd, dr, rr = found
    gram = np.array([[(rr[i + j] + rr[abs(i - j)]) / 2 for j in range(n)] for i in range(n)])
    return [float(x) * 2 * pi_max for x in np.linalg.lstsq(gram, dd - 2 * dr + rr[:n], rcond=None)[0]]


def sigma2_data_only(data: DataFrame, radius: float, expected: float, kernel: str = "top_hat", axes: Sequence[str] = AXES, weight: str = "w") -> DataFrame:
    """(radius, sigma2): (sum_{i<j} w_i w_j K / W - expected) / expected with W = ((sum w)^2 - sum w^2) / 2; ``expected`` is the kernel's mean over random pairs."""
    of, top = ARRAY_KERNELS[kernel], (radius * SUPPORT[kernel]) ** 2

    def work(mine, theirs):
        sums = np.zeros(1)

        def add(block, chunk, at, d2):
            near = d2 < top
            k = of(np.sqrt(np.minimum(d2, top, out=d2), out=d2), radius)
            sums[0] += mine["_w"][block] @ np.multiply(k, near, out=k) @ theirs["_w"][chunk]

        return add, lambda: {"s": sums}

    held = cut(places(data, axes, weight))
    rows, _, products = inside_places(held)
    found = place_sums(held, None, radius * SUPPORT[kernel], work, "s double", axes).unionByName(rows.select((products * float(of(np.zeros(1), radius)[0])).alias("s")))
    s = found.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    t = data.agg(((F.sum(weight) * F.sum(weight) - F.sum(F.col(weight) * F.col(weight))) / 2).alias("pairs"))
    return s.crossJoin(t).select(F.lit(float(radius)).alias("radius"), ((F.col("s") / F.col("pairs") - expected) / expected).alias("sigma2"))
