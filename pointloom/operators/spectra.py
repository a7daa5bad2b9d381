"""Angular power spectra of sky maps: harmonic coefficients by rings, mask coupling, decoupled bins.

Pixels of one ring share their height, so a map is turned into coefficients in two groupings:
a Fourier transform of each ring (at most 4 nside pixels), and for each order m the sum over
the rings of the Legendre functions, which a recurrence gives for all degrees (at most
4 nside - 1 rings). Synthesis goes the same way back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.healpix import ring_place
from pointloom.operators.fields import overdensity_map
from pointloom.operators.neighbours import cut

ALM = "l int, m int, re double, im double"


def _ring(i: int | np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixels, longitude of the first in radians, height) of rings."""
    i = np.atleast_1d(i)
    k = np.minimum(np.minimum(i, 4 * nside - i), nside)
    cap = k < nside
    n = 4 * k
    first = np.where(cap | ((i - nside) % 2 == 0), math.pi / n, 0.0)
    height = np.where(cap, 1 - k * k / (3.0 * nside * nside), (2 * nside - i) * 2 / (3.0 * nside))
    return n, first, np.where(cap & (i > 2 * nside), -height, height)


def _legendre(m: int, lmax: int, z: np.ndarray) -> Iterator[np.ndarray]:
    """Normalised Legendre functions of order m at heights z, for the degrees m to lmax; scales are kept as logarithms, so that none is lost near the poles."""
    log = 0.5 * (math.log(2 * m + 1) - math.log(4 * math.pi) + math.lgamma(2 * m + 1)) - m * math.log(2) - math.lgamma(m + 1) + m * 0.5 * np.log1p(-z * z)
    now, before = np.full(len(z), -1.0 if m % 2 else 1.0), np.zeros(len(z))
    for deg in range(m, lmax + 1):
        yield now * np.exp(np.maximum(log, -745))
        a = math.sqrt((4 * (deg + 1) ** 2 - 1) / ((deg + 1) ** 2 - m * m))
        b = math.sqrt((deg * deg - m * m) / (4 * deg * deg - 1)) if deg > m else 0.0
        now, before = a * (z * now - b * before), now
        large = np.abs(now) > 1e100
        if large.any():
            now, before, log = np.where(large, now * 1e-100, now), np.where(large, before * 1e-100, before), np.where(large, log + math.log(1e100), log)


def harmonics(maps: DataFrame, nside: int, lmax: int, value: str = "value") -> DataFrame:
    """(l, m, re, im), 0 <= m <= l: harmonic coefficients of a real map (pix, ``value``) as plain sums over its pixels.

    Pixels that are missing or null count as 0; an empty map has no coefficient.
    """
    ring, place = ring_place(F.col("pix"), nside)
    rings = maps.where(F.col(value).isNotNull()).select(ring.alias("ring"), place.alias("place"), F.col(value).cast("double").alias("v")).groupBy("ring").agg(F.collect_list(F.struct("place", "v")).alias("pixels"))  # 4 nside at most

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.arange(lmax + 1)
        for b in batches:
            for k, r in enumerate(b.column("ring").to_pylist()):
                n, first, _ = (x[0] for x in _ring(r, nside))
                pixels, v = b.column("pixels").slice(k, 1).flatten(), np.zeros(n)
                v[pixels.field("place").to_numpy()] = pixels.field("v").to_numpy()
                f = np.fft.fft(v)[m % n] * np.exp(-1j * m * first)
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(np.full(lmax + 1, r, np.int32)), pa.array(f.real), pa.array(f.imag)], ["m", "ring", "re", "im"])

    by_order = rings.mapInArrow(transform, "m int, ring int, re double, im double").groupBy("m").agg(F.collect_list(F.struct("ring", "re", "im")).alias("rings"))  # 4 nside - 1 at most
    area = math.pi / (3 * nside * nside)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(b.column("m").to_pylist()):
                rows = b.column("rings").slice(k, 1).flatten()
                f = (rows.field("re").to_numpy() + 1j * rows.field("im").to_numpy()) * area
                a = np.array([lam @ f for lam in _legendre(m, lmax, _ring(rows.field("ring").to_numpy(), nside)[2])])
                deg = np.arange(m, lmax + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(deg), pa.array(np.full(len(deg), m, np.int32)), pa.array(a.real), pa.array(a.imag)], ["l", "m", "re", "im"])

    return by_order.mapInArrow(project, ALM)


def synthesis(alm: DataFrame, nside: int, lmax: int) -> DataFrame:
    """(pix, value) of all pixels: the real map with coefficients ``alm`` (0 <= m <= l)."""
    by_order = alm.where(F.col("l") <= lmax).groupBy("m").agg(F.collect_list(F.struct("l", "re", "im")).alias("degrees"))  # lmax + 1 at most

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = np.arange(1, 4 * nside)
        heights = _ring(rings, nside)[2]
        for b in batches:
            for k, m in enumerate(b.column("m").to_pylist()):
                rows = b.column("degrees").slice(k, 1).flatten()
                a = np.zeros(lmax + 1, complex)
                a[rows.field("l").to_numpy()] = rows.field("re").to_numpy() + 1j * rows.field("im").to_numpy()
                f = sum((lam * a[deg] for deg, lam in enumerate(_legendre(m, lmax, heights), m)), np.zeros(len(rings), complex))
                yield pa.RecordBatch.from_arrays([pa.array(rings.astype(np.int32)), pa.array(np.full(len(rings), m, np.int32)), pa.array(f.real), pa.array(f.imag)], ["ring", "m", "re", "im"])

    by_ring = by_order.mapInArrow(project, "ring int, m int, re double, im double").groupBy("ring").agg(F.collect_list(F.struct("m", "re", "im")).alias("orders"))  # lmax + 1 at most

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, r in enumerate(b.column("ring").to_pylist()):
                n, first, _ = (x[0] for x in _ring(r, nside))
                rows = b.column("orders").slice(k, 1).flatten()
                m = rows.field("m").to_numpy()
                f = (rows.field("re").to_numpy() + 1j * rows.field("im").to_numpy()) * np.exp(1j * m * first) * np.where(m > 0, 2, 1)
                h = np.zeros(n, complex)
                np.add.at(h, m % n, f)
                v = (np.fft.ifft(h) * n).real
                before = 2 * r * (r - 1) if r < nside else 2 * nside * (nside - 1) + (r - nside) * 4 * nside if r <= 3 * nside else 12 * nside**2 - 2 * (4 * nside - r) * (4 * nside - r + 1)
                yield pa.RecordBatch.from_arrays([pa.array(before + np.arange(n, dtype=np.int64)), pa.array(v)], ["pix", "value"])

    return by_ring.mapInArrow(transform, "pix long, value double")


def fitted_harmonics(maps: DataFrame, nside: int, lmax: int, value: str = "value", rounds: int = 3) -> DataFrame:
    """harmonics(), corrected ``rounds`` times by those of what the map has beyond its synthesis; a table."""
    alm = cut(harmonics(maps, nside, lmax, value))
    plain = maps.select("pix", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    for _ in range(rounds):
        made = synthesis(alm, nside, lmax).withColumnRenamed("value", "made")
        left = made.join(plain, "pix", "left").select("pix", (F.coalesce("value", F.lit(0.0)) - F.col("made")).alias("value"))
        more = harmonics(left, nside, lmax).select("l", "m", F.col("re").alias("dre"), F.col("im").alias("dim"))
        alm = cut(alm.join(more, ["l", "m"]).select("l", "m", (F.col("re") + F.col("dre")).alias("re"), (F.col("im") + F.col("dim")).alias("im")))
    return alm


def power(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(l, cl): mean product of the coefficients of one map, or of two, at each degree."""
    times = F.when(F.col("m") > 0, 2.0).otherwise(1.0)
    if b is None:
        product, rows = F.col("re") * F.col("re") + F.col("im") * F.col("im"), a
    else:
        rows = a.join(b.select("l", "m", F.col("re").alias("re2"), F.col("im").alias("im2")), ["l", "m"])
        product = F.col("re") * F.col("re2") + F.col("im") * F.col("im2")
    return rows.groupBy("l").agg((F.sum(times * product) / F.first(2 * F.col("l") + 1)).alias("cl"))


def degree_bins(nside: int, width: int) -> list[tuple[int, int]]:
    """Bins [lo, hi) of so many degrees each, from 2 on to 3 nside - 1; a last part is left out."""
    return [(lo, lo + width) for lo in range(2, 3 * nside - width + 1, width)]


def coupling(spectrum: list[float], bins: list[tuple[int, int]], spark) -> np.ndarray:
    """Matrix by bins of the pseudo power that a mask with power ``spectrum`` (by degree from 0) makes of constant power in a bin.

    The rows by degree, sums over squared 3j symbols, are made on the executors; what comes
    back has one entry for each two bins.
    """
    top = len(spectrum) - 1
    w = np.array(spectrum) * (2 * np.arange(top + 1) + 1)
    which = np.full(top + 1, -1)
    for b, (lo, hi) in enumerate(bins):
        which[lo:hi] = b

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 3 * top + 3)))])
        l3 = np.arange(top + 1)
        for batch in batches:
            for l1 in batch.column(0).to_pylist():
                found = np.zeros(len(bins))
                for l2 in np.flatnonzero(which >= 0):
                    near = l3[(l3 >= abs(l1 - l2)) & (l3 <= l1 + l2) & ((l1 + l2 + l3) % 2 == 0)]
                    g = (l1 + l2 + near) // 2
                    three_j = np.exp(logs[2 * g - 2 * l1] + logs[2 * g - 2 * l2] + logs[2 * g - 2 * near] - logs[2 * g + 1] + 2 * (logs[g] - logs[g - l1] - logs[g - l2] - logs[g - near]))
                    found[which[l2]] += (2 * l2 + 1) / (4 * math.pi) * (w[near] * three_j).sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), which[l1], np.int32)), pa.array(np.arange(len(bins), dtype=np.int32)), pa.array(found)], ["i", "j", "v"])

    degrees = spark.range(2, top + 1).where(F.col("id") < bins[-1][1]).repartition(max(1, top // 16), "id")
    out = np.zeros((len(bins), len(bins)))
    for r in degrees.mapInArrow(rows, "i int, j int, v double").groupBy("i", "j").agg(F.avg("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def _decoupled(pseudo: DataFrame, mask_power: DataFrame, nside: int, width: int) -> DataFrame:
    """(bin, ell, cl_coupled, cl_raw): mean pseudo power in bins, and the binned power that it is made of."""
    spark, bins = pseudo.sparkSession, degree_bins(nside, width)
    if not bins:
        raise ValueError("no bin of that width below 3 nside")
    by_degree = {r.l: r.cl for r in mask_power.collect()}  # 3 nside rows
    inverse = np.linalg.inv(coupling([by_degree.get(x, 0.0) for x in range(3 * nside)], bins, spark))
    grid = spark.createDataFrame([(b, x, (lo + hi - 1) / 2) for b, (lo, hi) in enumerate(bins) for x in range(lo, hi)], "bin int, l int, ell double")
    binned = grid.join(pseudo, "l", "left").groupBy("bin").agg(F.first("ell").alias("ell"), F.avg(F.coalesce("cl", F.lit(0.0))).alias("cl_coupled"))
    weights = spark.createDataFrame([(i, j, float(inverse[i, j])) for i in range(len(bins)) for j in range(len(bins))], "bin int, of int, weight double")
    solved = weights.join(binned.select(F.col("bin").alias("of"), F.col("cl_coupled").alias("c")), "of").groupBy("bin").agg(F.sum(F.col("weight") * F.col("c")).alias("cl_raw"))
    return binned.join(solved, "bin")


def auto_spectrum(points: DataFrame, mask: DataFrame, nside: int, width: int = 16, threshold: float = 1e-6, rounds: int = 3, ra: str = "ra", sin_dec: str = "u") -> DataFrame:
    """(bin, ell, cl_coupled, cl_raw, cl, n_shot, f_sky): power of the overdensity of points behind a mask (pix, completeness).

    The overdensity is weighted by the mask, its pseudo power binned from degree 2 on and
    decoupled from the mask; ``cl`` is less the shot noise, the area of a pixel times the sum of
    the squared mask over the number of points. Degrees go to 3 nside - 1. Without points there is no row.
    """
    lmax, area = 3 * nside - 1, math.pi / (3 * nside * nside)
    full = cut(mask.select("pix", F.coalesce(F.col("completeness").cast("double"), F.lit(0.0)).alias("completeness")))
    delta = overdensity_map(points, full, nside, threshold, ra=ra, sin_dec=sin_dec)
    alm = fitted_harmonics(delta.join(full, "pix").select("pix", (F.col("delta") * F.col("completeness")).alias("value")), nside, lmax, rounds=rounds)
    mask_power = power(fitted_harmonics(full, nside, lmax, "completeness", rounds))
    shot = full.agg(F.sum(F.col("completeness") * F.col("completeness")).alias("m2"), (F.sum("completeness") / (12 * nside * nside)).alias("f_sky")).crossJoin(points.agg(F.count("*").alias("n")))
    found = _decoupled(power(alm), mask_power, nside, width).crossJoin(F.broadcast(shot.where("n > 0")))  # one row
    return found.select("bin", "ell", "cl_coupled", "cl_raw", (F.col("cl_raw") - F.lit(area) * F.col("m2") / F.col("n")).alias("cl"), (F.lit(area) * F.col("m2") / F.col("n")).alias("n_shot"), "f_sky")


def cross_spectrum(points: DataFrame, mask: DataFrame, other: DataFrame, other_mask: DataFrame, nside: int, width: int = 16, threshold: float = 1e-6, rounds: int = 3, ra: str = "ra", sin_dec: str = "u") -> DataFrame:
    """(bin, ell, cl_coupled, cl, f_sky): power between the overdensity of points and a map (pix, value), both behind the product of their masks (pix, completeness)."""
    lmax = 3 * nside - 1
    delta = overdensity_map(points, mask, nside, threshold, ra=ra, sin_dec=sin_dec)
    joint = mask.select("pix", F.col("completeness").alias("m1")).join(other_mask.select("pix", F.col("completeness").alias("m2")), "pix").select("pix", F.coalesce(F.col("m1").cast("double") * F.col("m2"), F.lit(0.0)).alias("both"))
    rows = cut(joint.join(delta, "pix").join(other.select("pix", F.col("value").alias("other")), "pix", "left"))
    one, two = (fitted_harmonics(rows.select("pix", (F.col(c) * F.col("both")).alias("value")), nside, lmax, rounds=rounds) for c in ("delta", "other"))
    mask_power = power(fitted_harmonics(rows, nside, lmax, "both", rounds))
    sky = rows.agg((F.sum("both") / (12 * nside * nside)).alias("f_sky"))
    return _decoupled(power(one, two), mask_power, nside, width).crossJoin(F.broadcast(sky)).select("bin", "ell", "cl_coupled", F.col("cl_raw").alias("cl"), "f_sky")  # one row
