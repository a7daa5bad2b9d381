"""Made-up surveys and random catalogs of a selection map; all draws are hashes of ids, so they are the same for any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.coords import bin_of, chord, unit_vector
from pointloom.functions.healpix import centre, pixel
from pointloom.operators.rangejoin import pairs
from pointloom.sources.catalogs import galactic_latitude, sampled_redshifts

#: The mock's redshift density: middle, width and weight of its two humps.
HUMPS = ((1.05, 0.30, 1.0), (1.95, 0.45, 0.6))


def _uniform(seed: int, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _normal(seed: int, k: int) -> Column:
    return F.sqrt(-2 * F.ln(1 - _uniform(seed, k))) * F.cos(F.lit(2 * math.pi) * _uniform(seed, k + 1))


def two_hump_density(z: np.ndarray) -> np.ndarray:
    """The mock's redshift density, not normalised."""
    return sum(w * np.exp(-((np.asarray(z, float) - m) ** 2) / (2 * s * s)) for m, s, w in HUMPS)


def _redshift(seed: int, k: int, z_min: float, z_max: float, bins: int = 200) -> Column:
    """A redshift of the two humps: inverse of the cumulative density, straight within bins."""
    edges = np.linspace(z_min, z_max, bins + 1)
    top = np.concatenate([[0], np.cumsum(two_hump_density((edges[1:] + edges[:-1]) / 2))])
    top = F.array(*[F.lit(float(x)) for x in top / top[-1]])
    u = _uniform(seed, k)
    i = F.greatest(F.lit(1), F.least(F.lit(bins), F.size(F.filter(top, lambda t: t <= u))))
    return F.lit(z_min) + F.lit((z_max - z_min) / bins) * (i - 1 + (u - F.element_at(top, i)) / (F.element_at(top, i + 1) - F.element_at(top, i)))


def masked_sky(spark: SparkSession, n: int, b_min: float, seed: int) -> DataFrame:
    """(id, ra, dec): ``n`` uniform directions at galactic latitudes of b_min degrees and more."""
    tried = int(n / max(1e-3, 1 - math.sin(math.radians(b_min))) * 1.1) + 1000
    d = spark.range(tried).select("id", (_uniform(seed, 1) * 360.0).alias("ra"), F.degrees(F.asin(2 * _uniform(seed, 2) - 1)).alias("dec"))
    return d.where(F.abs(galactic_latitude(F.col("ra"), F.col("dec"))) >= b_min).orderBy("id").limit(n)


def quasar_mock(spark: SparkSession, n_data: int, n_random: int, b_min: float = 10.0, clusters: int = 600, sigma_deg: float = 0.8, sigma_z: float = 0.02, share: float = 0.15, z_min: float = 0.5, z_max: float = 4.5, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(data, randoms) as (id, ra, dec, z): both uniform off the galactic plane with two humps in redshift, and a share of the data in Gaussian clumps."""
    randoms = masked_sky(spark, n_random, b_min, seed).withColumn("z", _redshift(seed, 3, z_min, z_max))
    clumped = int(share * n_data) if clusters else 0
    data = masked_sky(spark, n_data - clumped, b_min, seed + 1).withColumn("z", _redshift(seed + 1, 3, z_min, z_max))
    if clumped:
        each = max(1, clumped // clusters)
        middles = masked_sky(spark, clusters, b_min, seed + 2).withColumn("z", _redshift(seed + 2, 3, z_min, z_max))
        members = middles.select("ra", "dec", "z", (F.col("id") * each).alias("first")).select("*", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k")).withColumn("id", F.col("first") + F.col("k"))
        moved = members.select(
            (F.col("id") + F.lit(1 << 40)).alias("id"), F.pmod(F.col("ra") + _normal(seed + 3, 1) * sigma_deg, F.lit(360.0)).alias("ra"),
            F.greatest(F.lit(-89.999), F.least(F.lit(89.999), F.col("dec") + _normal(seed + 3, 3) * sigma_deg)).alias("dec"), F.greatest(F.lit(z_min), F.least(F.lit(z_max), F.col("z") + _normal(seed + 3, 5) * sigma_z)).alias("z"),
        )
        data = data.unionByName(moved.where(F.abs(galactic_latitude(F.col("ra"), F.col("dec"))) >= b_min))
    return data, randoms


def selection_randoms(mask: DataFrame, nside: int, n: int, data: DataFrame, edges: Sequence[float], z: str = "z", seed: int = 11) -> DataFrame:
    """(id, ra, u, z): ``n`` directions spread as the completeness of (pix, completeness), with redshifts drawn from the data's histogram.

    Uniform directions are kept with the probability of their pixel.
    """
    top = mask.agg(F.max("completeness"), F.avg("completeness")).first()
    tried = int(n * top[0] / top[1] * 1.1) + 1000
    d = mask.sparkSession.range(tried).select("id", (_uniform(seed, 1) * 360.0).alias("ra"), (2 * _uniform(seed, 2) - 1).alias("u"), _uniform(seed, 3).alias("coin"))
    kept = d.withColumn("pix", pixel(F.col("ra"), F.col("u"), nside)).join(mask, "pix").where(F.col("coin") * F.lit(float(top[0])) < F.col("completeness"))
    return sampled_redshifts(kept.select("id", "ra", "u").orderBy("id").limit(n), data, edges, z, seed)


def region_randoms(masks: dict[str, DataFrame], nside: int, counts: dict[str, int], data: dict[str, DataFrame], edges: Sequence[float], z: str = "z", seed: int = 11) -> DataFrame:
    """selection_randoms() of several regions, each with its own mask, number and redshifts, and a column region."""
    out = None
    for k, name in enumerate(sorted(masks)):
        part = selection_randoms(masks[name], nside, counts[name], data[name], edges, z, seed + k).withColumn("region", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def windowed_cap_area(mask: DataFrame, nside: int, queries: DataFrame, thetas: Sequence[float], ra: str = "ra", u: str = "u") -> DataFrame:
    """(t, area): mean over queries of the completeness in caps, in steradians; caps smaller than a pixel have their pixel's completeness."""
    size = 4 * math.pi / (12 * nside * nside)
    x, y, z = unit_vector(F.col(ra), F.col(u))
    q = queries.select("id", x.alias("c0"), y.alias("c1"), z.alias("c2"), pixel(F.col(ra), F.col(u), nside).alias("pix"), F.lit(0.0).alias("m"))
    a, b = centre(F.col("pix"), nside)
    x, y, z = unit_vector(a, b)
    spots = mask.select(F.col("pix").alias("id"), x.alias("c0"), y.alias("c1"), z.alias("c2"), F.col("completeness").cast("double").alias("m"))
    met = pairs(q, spots, chord(thetas[-1]), keep=("id", "m"), closed=True)
    sums = [F.coalesce(F.sum(F.when(F.col("d2") <= F.lit(chord(t) ** 2), F.col("b_m"))), F.lit(0.0)) * F.lit(size) for t in thetas]
    inside = met.groupBy(F.col("a_id").alias("id")).agg(*[s.alias(f"s{t}") for t, s in enumerate(sums)])
    own = q.join(mask.select("pix", "completeness"), "pix", "left").select("id", F.coalesce("completeness", F.lit(0.0)).alias("own"))
    tiny = [math.radians(t) < math.sqrt(size / math.pi) for t in thetas]
    areas = [F.col("own") * F.lit(2 * math.pi * (1 - math.cos(math.radians(t)))) if small else F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k, (t, small) in enumerate(zip(thetas, tiny, strict=True))]
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("t"), a.alias("area")) for k, a in enumerate(areas)]))
    return own.join(inside, "id", "left").select(rows).groupBy("t").agg(F.avg("area").alias("area"))


def analytic_cap_sums(area: DataFrame, mask: DataFrame, data: DataFrame, sizes: DataFrame, n_random: int, n_edges: Sequence[float], z: str = "red") -> DataFrame:
    """(t, iq, jn, n_q, s1): expected random neighbours of ``sizes`` (iq, n_q) queries: n_random spread over the mask and over shells as the data are."""
    shells = data.select(bin_of(F.col(z), n_edges).alias("jn"))
    share = shells.where("jn is not null").groupBy("jn").agg(F.count("*").alias("c")).crossJoin(shells.agg(F.count("*").alias("all"))).select("jn", (F.col("c") / F.col("all")).alias("share"))
    whole = mask.agg((F.avg("completeness") * F.lit(4 * math.pi)).alias("sky"))
    return area.crossJoin(sizes).crossJoin(share).crossJoin(whole).select("t", "iq", "jn", "n_q", (F.col("n_q") * n_random * F.col("share") * F.col("area") / F.col("sky")).alias("s1"))  # caps, shells and one row
