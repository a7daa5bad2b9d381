"""Maps over sky pixels, systematics weights, jackknife regions, environment statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.coords import ACCURACY, chord, unit_vector
from pointloom.functions.cosmology import Cosmology
from pointloom.functions.healpix import centre, pixel
from pointloom.operators.cells import ratio
from pointloom.operators.rangejoin import pairs

#: Rows that a step on the driver takes at most: pixels of a coarse map, bins, templates.
DRIVER_ROWS = 1 << 20


def count_map(points: DataFrame, nside: int, ra: str = "ra", sin_dec: str = "u", weight: str | None = None) -> DataFrame:
    """(pix, n): counts or weights of all 12 nside^2 pixels, empty ones included."""
    spark = points.sparkSession
    value = F.sum(weight) if weight else F.count("*")
    seen = points.groupBy(pixel(F.col(ra), F.col(sin_dec), nside).alias("pix")).agg(value.cast("double").alias("n"))
    return spark.range(12 * nside * nside).select(F.col("id").alias("pix")).join(seen, "pix", "left").select("pix", F.coalesce("n", F.lit(0.0)).alias("n"))


def completeness_map(randoms: DataFrame, nside: int, weight: str | None = None, **columns: str) -> DataFrame:
    """(pix, completeness): weighted counts over the median of the populated pixels, at most 1."""
    m = count_map(randoms, nside, weight=weight, **columns)
    middle = m.where("n > 0").agg(F.percentile_approx("n", 0.5, ACCURACY).alias("middle"))
    return m.crossJoin(F.broadcast(middle)).select("pix", F.least(F.lit(1.0), F.coalesce(ratio(F.col("n"), F.col("middle")), F.lit(0.0))).alias("completeness"))


def overdensity_map(points: DataFrame, mask: DataFrame, nside: int, threshold: float = 0.5, **columns: str) -> DataFrame:
    """(pix, delta): counts over mean times completeness, less 1, where completeness reaches the threshold; 0 elsewhere."""
    j = count_map(points, nside, **columns).join(mask, "pix").withColumn("ok", F.col("completeness") >= threshold)
    mean = j.where("ok").agg(ratio(F.sum("n"), F.sum("completeness")).alias("mean"))
    return j.crossJoin(F.broadcast(mean)).select("pix", F.when(F.col("ok"), F.coalesce(ratio(F.col("n"), F.col("mean") * F.col("completeness")) - 1, F.lit(0.0))).otherwise(0.0).alias("delta"))


def latitude_templates(b: Column, l: Column) -> dict[str, Column]:  # noqa: E741
    """Templates of latitude and longitude in degrees."""
    s = F.sin(F.radians(b))
    return {"abs_sin_b": F.abs(s), "sin2_b": s * s, "cos_l": F.cos(F.radians(l)), "sin_l": F.sin(F.radians(l))}


def template_fit(pixels: DataFrame, templates: Sequence[str], value: str = "residual") -> list[float]:
    """Least-squares coefficients of a residual on templates less their means; the sums are made on the executors."""
    means = pixels.agg(*[F.avg(t).alias(t) for t in templates]).first()
    centred = [F.col(t) - F.lit(means[t]) for t in templates]
    k = len(templates)
    sums = pixels.agg(*[F.sum(centred[i] * centred[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(centred[i] * F.col(value)).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return [float(x) for x in np.linalg.lstsq(a, np.array([sums[f"b{i}"] for i in range(k)]), rcond=None)[0]]


def template_weights(points: DataFrame, pixels: DataFrame, templates: Sequence[str], floor: float = 0.1, on: str = "pix") -> DataFrame:
    """``points`` with weight 1 / max(1 + sum c t, floor), scaled to mean 1; pixels carry ``residual`` and the templates."""
    c = template_fit(pixels, templates)
    means = pixels.agg(*[F.avg(t).alias(t) for t in templates]).first()
    model = sum((F.col(t) - F.lit(means[t])) * F.lit(x) for t, x in zip(templates, c, strict=True))
    table = pixels.select(on, (1 / F.greatest(1 + model, F.lit(floor))).alias("_w"))
    j = points.join(table, on)
    mean = j.agg(F.avg("_w").alias("_m"))
    return j.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")


def jackknife_regions(points: DataFrame, n_regions: int, nside: int, **columns: str) -> DataFrame:
    """(pix, region): populated pixels dealt, fullest first, to the region with the fewest points; ties go to the lowest.

    One after the other by nature: the pixel counts of a coarse map come to the driver, at most DRIVER_ROWS.
    """
    if 12 * nside * nside > DRIVER_ROWS:
        raise ValueError("the map is too fine to be dealt on the driver")
    rows = count_map(points, nside, **columns).where("n > 0").orderBy(F.desc("n"), "pix").collect()
    load, out = [0.0] * n_regions, []
    for r in rows:
        k = min(range(n_regions), key=lambda i: (load[i], i))
        load[k] += r["n"]
        out.append((r["pix"], k))
    return points.sparkSession.createDataFrame(out, "pix long, region int")


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """(r, partial): correlation of x and y, and that of their residuals on z; null where a variance is 0."""
    c = df.agg(F.corr(x, y).alias("r"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    left = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return c.select("r", ratio(F.col("r") - F.col("xz") * F.col("yz"), left).alias("partial"))


def environment_means(df: DataFrame, by: str, labels: Sequence[str]) -> DataFrame:
    """Mean label of each environment class, with counts."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"mean_{x}") for x in labels])


def median_split(df: DataFrame, label: str) -> DataFrame:
    """``df`` with half: 1 above the median of a label (the lower of two in the middle), else 0; a null label has none."""
    return df.withColumn("half", F.when(F.col(label).isNotNull(), (F.col(label) > F.lit(_median(df, label))).cast("int")))


def _median(df: DataFrame, label: str):
    """The exact lower median; null without values. A sketch gives two bounds, and the values between them, a few in ACCURACY, are counted."""
    margin = 2 / ACCURACY
    bounds, n = df.agg(F.percentile_approx(label, [0.5 - margin, 0.5 + margin], ACCURACY), F.count(label)).first()
    if not n:
        return None
    low, high = (F.lit(b) for b in bounds)
    below = df.where(F.col(label) < low).count()
    between = df.where(F.col(label).between(low, high)).groupBy(F.col(label).alias("_v")).agg(F.count("*").alias("_n"))
    reached = between.select("_v", F.sum("_n").over(Window.orderBy("_v")).alias("_upto"))  # a few in ACCURACY of all rows
    return reached.where(F.col("_upto") >= (n + 1) // 2 - below).agg(F.min("_v")).first()[0]


def tidal_split(df: DataFrame) -> DataFrame:
    """Columns txx..tyz -> trace, and the norm of the traceless part."""
    trace = F.col("txx") + F.col("tyy") + F.col("tzz")
    diagonal = sum((F.col(c) - trace / 3) * (F.col(c) - trace / 3) for c in ("txx", "tyy", "tzz"))
    off = sum(F.col(c) * F.col(c) for c in ("txy", "txz", "tyz"))
    return df.withColumn("trace", trace).withColumn("shear", F.sqrt(diagonal + 2 * off))


def clustering_weights(df: DataFrame, bias: Column, growth: Column, density: Column, power: float) -> DataFrame:
    """``df`` with weight b D / (1 + n P), scaled to mean 1."""
    raw = df.withColumn("_w", bias * growth / (1 + density * F.lit(power)))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("_w").alias("_m")))).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")


def cap_centre_grid(mask: DataFrame, nside: int, nside_centres: int, theta_max: float, buffer: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """(id, ra, u, covered): pixel centres in the footprint whose disc of ``buffer`` * ``theta_max`` degrees has no mask pixel below the threshold, and the mean completeness of the disc.

    ``mask`` is (pix, completeness) of all pixels at ``nside``; a disc without a pixel centre keeps no centre.
    """
    ra, u = centre(F.col("pix"), nside)
    x, y, z = unit_vector(ra, u)
    spots = mask.select(F.col("pix").alias("id"), x.alias("c0"), y.alias("c1"), z.alias("c2"), "completeness")
    ra, u = centre(F.col("id"), nside_centres)
    x, y, z = unit_vector(F.col("ra"), F.col("u"))
    grid = mask.sparkSession.range(12 * nside_centres * nside_centres).select("id", ra.alias("ra"), u.alias("u")).select("*", pixel(F.col("ra"), F.col("u"), nside).alias("pix"), x.alias("c0"), y.alias("c1"), z.alias("c2"))
    inside = grid.join(mask.where(F.col("completeness") >= threshold).select("pix"), "pix", "left_semi").withColumn("completeness", F.lit(0.0))
    met = pairs(inside, spots, chord(buffer * theta_max), keep=("id", "completeness"), closed=True)
    kept = met.groupBy(F.col("a_id").alias("id")).agg(F.avg("b_completeness").alias("covered"), F.min("b_completeness").alias("least")).where(F.col("least") >= threshold)
    return inside.select("id", "ra", "u").join(kept.select("id", "covered"), "id")


def eigenvalues(df: DataFrame) -> DataFrame:
    """``df`` with e0 <= e1 <= e2, the eigenvalues of the symmetric 3 x 3 tensor in txx..tyz, by the trigonometric solution of the cubic."""
    c = lambda name: F.col(name).cast("double")
    q = (c("txx") + c("tyy") + c("tzz")) / 3
    off = c("txy") * c("txy") + c("txz") * c("txz") + c("tyz") * c("tyz")
    a, b, d = c("txx") - q, c("tyy") - q, c("tzz") - q
    p = F.sqrt((a * a + b * b + d * d + 2 * off) / 6)
    half_det = (a * b * d + 2 * c("txy") * c("tyz") * c("txz") - a * c("tyz") * c("tyz") - b * c("txz") * c("txz") - d * c("txy") * c("txy")) / 2
    angle = F.when(p > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_det / (p * p * p)))) / 3).otherwise(0.0)
    held = df.select("*", q.alias("mid"), p.alias("spread"), angle.alias("angle"))
    e2, e0 = F.col("mid") + 2 * F.col("spread") * F.cos("angle"), F.col("mid") + 2 * F.col("spread") * F.cos(F.col("angle") + F.lit(2 * math.pi / 3))
    return held.select(*df.columns, e0.alias("e0"), (3 * F.col("mid") - e0 - e2).alias("e1"), e2.alias("e2"))


def shape_class(df: DataFrame, eps: float = 0.02) -> DataFrame:
    """``df`` with shape, from eigenvalues() of a tensor without trace: isotropic, filament (one large, two alike below 0), sheet (one below 0, two alike above) or triaxial."""
    e0, e1, e2 = F.col("e0"), F.col("e1"), F.col("e2")
    apart = (e0 < 0) & (e2 > 0)
    shape = F.when(F.greatest(F.abs(e0), F.abs(e1), F.abs(e2)) < eps, "isotropic").when(apart & (e1 - e0 < eps), "filament").when(apart & (e2 - e1 < eps), "sheet").otherwise("triaxial")
    return df.withColumn("shape", shape)


def smoothed_map(pixels: DataFrame, nside: int, column: str, fwhm: float, reach: float = 4.0) -> DataFrame:
    """(pix, value): mean of a column under a Gaussian of a width in degrees, over pixels within ``reach`` deviations; null pixels count for nothing."""
    sigma = math.radians(fwhm) / math.sqrt(8 * math.log(2))
    ra, u = centre(F.col("pix"), nside)
    x, y, z = unit_vector(ra, u)
    spots = pixels.select(F.col("pix").alias("id"), x.alias("c0"), y.alias("c1"), z.alias("c2"), F.col(column).cast("double").alias("m"))
    met = pairs(spots, spots.where("m is not null"), chord(min(180.0, math.degrees(sigma) * reach)), keep=("id", "m"), closed=True)
    angle = 2 * F.asin(F.least(F.lit(1.0), F.sqrt("d2") / 2))
    weighed = met.select(F.col("a_id").alias("pix"), "b_m", F.exp(-angle * angle / (2 * sigma * sigma)).alias("k"))
    return weighed.groupBy("pix").agg((F.sum(F.col("k") * F.col("b_m")) / F.sum("k")).alias("value"))


def residual_weights(points: DataFrame, mask: DataFrame, nside: int, fwhm: float = 10.0, threshold: float = 1e-6, floor: float = 0.1, ra: str = "ra", u: str = "u") -> DataFrame:
    """``points`` with weight 1 / smoothed(counts over expected counts), at least ``floor`` below, scaled to mean 1; 1 outside the mask."""
    j = count_map(points, nside, ra, u).join(mask, "pix").withColumn("ok", F.col("completeness") >= threshold)
    mean = j.where("ok").agg(ratio(F.sum("n"), F.sum("completeness")).alias("mean"))
    held = j.crossJoin(F.broadcast(mean)).select("pix", F.when(F.col("ok"), F.col("n") / (F.col("mean") * F.col("completeness"))).alias("residual"))
    smooth = smoothed_map(held, nside, "residual", fwhm).select("pix", F.greatest(F.col("value"), F.lit(floor)).alias("level"))
    placed = points.withColumn("pix", pixel(F.col(ra), F.col(u), nside)).join(smooth, "pix", "left").withColumn("raw", 1 / F.coalesce("level", F.lit(1.0)))
    return placed.crossJoin(F.broadcast(placed.agg(F.avg("raw").alias("whole")))).withColumn("weight", F.col("raw") / F.col("whole")).drop("pix", "level", "raw", "whole")


def harmonic_templates(ra: Column, u: Column, l_max: int = 4) -> dict[str, Column]:
    """Real spherical harmonics of degrees 1 to l_max at (right ascension in degrees, sin dec): m = 0 as they are, others twice the cosine and minus twice the sine part."""
    across, out = F.sqrt(F.greatest(F.lit(0.0), 1 - u * u)), {}
    for m in range(l_max + 1):
        at = {m: F.lit(float((-1) ** m * math.prod(range(1, 2 * m, 2)))) * F.pow(across, m)}
        for n in range(m + 1, l_max + 1):
            at[n] = ((2 * n - 1) * u * at[n - 1] - (n + m - 1) * at.get(n - 2, F.lit(0.0))) / (n - m)
        for n in range(max(1, m), l_max + 1):
            norm = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - m) / math.factorial(n + m))
            if m == 0:
                out[f"y{n}_0"] = norm * at[n]
            else:
                out[f"y{n}_{m}_cos"] = 2 * norm * at[n] * F.cos(m * F.radians(ra))
                out[f"y{n}_{m}_sin"] = -2 * norm * at[n] * F.sin(m * F.radians(ra))
    return out


#: Tilt of the ecliptic in degrees.
OBLIQUITY = 23.4392911


def ecliptic_latitude(ra: Column, dec: Column) -> Column:
    e = math.radians(OBLIQUITY)
    s = F.sin(F.radians(dec)) * math.cos(e) - F.cos(F.radians(dec)) * math.sin(e) * F.sin(F.radians(ra))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def pair_redshifts(points: DataFrame, cosmology: Cosmology, pi_max: float = 200.0, bins: int = 80, fine: int = 2000, z: str = "z") -> tuple[np.ndarray, np.ndarray, float]:
    """(redshifts, density, pairs): mean redshifts of all pairs closer than pi_max in distance, from counts in ``fine`` steps of redshift; of unit integral."""
    low, high = points.agg(F.min(z), F.max(z)).first()
    if low is None or high <= low:
        raise ValueError("no pairs of different redshifts")
    step = (high - low) / fine
    at = F.least(F.floor((F.col(z) - F.lit(low)) / F.lit(step)), F.lit(fine - 1)).cast("int")
    counts = np.zeros(fine)
    for r in points.where(F.col(z).isNotNull()).groupBy(at.alias("k")).agg(F.count("*").alias("n")).collect():  # ``fine`` rows at most
        counts[r["k"]] = r["n"]
    mids = low + (np.arange(fine) + 0.5) * step
    chi = np.interp(mids, *cosmology.table())
    i, j = np.nonzero(np.abs(chi[:, None] - chi) < pi_max)
    weight = counts[i] * counts[j] - np.where(i == j, counts[i], 0.0)
    edges = np.linspace(low, high, bins + 1)
    density, _ = np.histogram((mids[i] + mids[j]) / 2, edges, weights=weight)
    centres = (edges[:-1] + edges[1:]) / 2
    return centres, density / np.trapezoid(density, centres), float(weight.sum() / 2)
