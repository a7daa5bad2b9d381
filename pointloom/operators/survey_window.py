"""Random pair counts from the survey window instead of a random catalog.

With a mask on the sky that does not depend on redshift, the expected pairs of randoms at
(rp, pi) are an integral over distance of the mask's angular correlation and the radial
density. The correlation is a histogram of pixel pairs, summed on the executors; the radial
density is a kernel estimate on a short grid. What comes to the driver has one row a bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.coords import bin_of, chord, root_reaches, unit_vector
from pointloom.functions.cosmology import Cosmology
from pointloom.functions.healpix import centre, pixel
from pointloom.operators.cells import cells, ratio, xi_of_cells
from pointloom.operators.pairs import rp_pi_counts
from pointloom.operators.rangejoin import AXES, self_pairs
from pointloom.operators.tiles import pair_sums


def mask_correlation(mask: DataFrame, nside: int, edges: Sequence[float]) -> DataFrame:
    """(bin, n, xi): pixel pairs and the mean product of their completeness by angle in degrees; a first bin from 0 on holds each pixel with itself."""
    ra, u = centre(F.col("pix"), nside)
    x, y, z = unit_vector(ra, u)
    spots = mask.select(F.col("pix").alias("id"), x.alias("c0"), y.alias("c1"), z.alias("c2"), F.col("completeness").cast("double").alias("m"))
    at = bin_of(F.col("d2"), [chord(e) ** 2 for e in edges])
    product = F.col("a_m") * F.col("b_m")
    apart = self_pairs(spots, chord(edges[-1]), keep=("id", "m")).select(F.coalesce(at, F.lit(-1)).alias("bin"), F.lit(2).alias("n"), (2 * product).alias("p"))
    if edges[0] == 0:
        apart = apart.unionByName(spots.select(F.lit(0).alias("bin"), F.lit(1).alias("n"), (F.col("m") * F.col("m")).alias("p")))
    sums = apart.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("bin").alias("last"))
    return sums.where("last >= 0").select("bin", "n", (F.col("p") / F.col("n")).alias("xi"))


def radial_density(points: DataFrame, cosmology: Cosmology = Cosmology(), n: int = 80, bandwidth: float = 0.05, z: str = "z") -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """(distance, density) on a grid between the extreme redshifts: Gaussian kernel sums over all points, of unit integral over distance."""
    low, high = points.agg(F.min(z), F.max(z)).first()
    edges = np.linspace(low, high, n + 1)
    mids = (edges[:-1] + edges[1:]) / 2
    kernel = lambda c: F.sum(F.exp(-F.pow((F.col(z) - F.lit(float(c))) / F.lit(bandwidth), 2) / 2))
    sums = np.array(points.agg(F.array(*[kernel(c) for c in mids])).first()[0])  # one row of n sums
    zs, ds = cosmology.table()
    chi = np.interp(mids, zs, ds)
    nz = sums / np.trapezoid(sums, mids)
    return chi, nz / np.maximum(np.gradient(chi, mids), 1e-12)


def rr_analytic(mask: DataFrame, nside: int, radial: tuple[np.ndarray, np.ndarray], rp_edges: Sequence[float], pi_edges: Sequence[float], n_r: float = 1.0, steps: int = 60, theta_max: float = 28.6, bins: int = 40, per_volume: bool = True) -> DataFrame:
    """(rp_bin, pi_bin, rr): expected pairs of ``n_r`` randoms at the middles of the bins, for the mask's correlation and the radial density.

    rr = n_r^2 rp drp dpi / (2 f^2 <chi^2>^2) times the integral over distance of chi^2
    xi(rp / chi) p(chi + pi / 2) p(chi - pi / 2), f the mean completeness: the published form,
    in which p is a density in volume. With ``per_volume`` false p is one in distance, as
    radial_density() gives it, and chi^2 / <chi^2>^2 becomes 1 / chi^2; in a thin shell both agree.
    """
    chi, p = radial
    edges = [theta_max * k / bins for k in range(bins + 1)]
    rows = sorted((r["bin"], r["xi"]) for r in mask_correlation(mask, nside, edges).collect())
    theta = np.radians([(edges[b] + edges[b + 1]) / 2 for b, _ in rows])
    xi = np.array([x for _, x in rows])
    f = mask.agg(F.avg("completeness")).first()[0]
    norm = n_r * n_r / (2 * f * f * (np.trapezoid(p * chi * chi, chi) ** 2 if per_volume else 1.0))
    out = []
    for i, (a, b) in enumerate(zip(rp_edges[:-1], rp_edges[1:], strict=True)):
        for j, (c, d) in enumerate(zip(pi_edges[:-1], pi_edges[1:], strict=True)):
            rp, pi = (a + b) / 2, (c + d) / 2
            value = 0.0
            if chi[-1] - chi[0] > pi:
                at = np.linspace(chi[0] + pi / 2, chi[-1] - pi / 2, steps)
                density = np.interp(at + pi / 2, chi, p, left=0, right=0) * np.interp(at - pi / 2, chi, p, left=0, right=0)
                value = rp * (b - a) * (d - c) * norm * np.trapezoid((at * at if per_volume else 1 / (at * at)) * np.interp(rp / at, theta, xi, right=0.0) * density, at)
            out.append((i, j, float(value)))
    return mask.sparkSession.createDataFrame(out, "rp_bin int, pi_bin int, rr double")


def calibration(analytic: DataFrame, counted: DataFrame) -> float:
    """The median ratio of counted to analytic rr over bins where both are positive; 1 if there is none. One row a bin."""
    j = analytic.select("rp_bin", "pi_bin", F.col("rr").alias("a")).join(counted.select("rp_bin", "pi_bin", F.col("rr").alias("c")), ["rp_bin", "pi_bin"]).where("a > 0 and c > 0")
    found = j.agg(F.median(F.col("c") / F.col("a"))).first()[0]
    return 1.0 if found is None else float(found)


def wp_analytic(data: DataFrame, rr: DataFrame, n_r: float, rp_edges: Sequence[float], pi_edges: Sequence[float], axes: Sequence[str] = AXES, weight: str | None = None, factor: float = 1.0, region: str | None = None) -> DataFrame:
    """(rp_bin[, region], wp): projected Landy-Szalay correlation from data pairs and analytic rr, with dr = 2 n_d rr / n_r.

    With ``region`` also without the points of each region (region null: with all): data pairs
    are counted once, by the regions of both ends. xi is 0 where rr is 0.
    """
    if region:
        n = data.groupBy(F.col(region).alias("region")).agg(F.count("*").cast("double").alias("n"))
        total = n.agg(F.sum("n").alias("all"))
        sizes = n.crossJoin(total).select("region", (F.col("all") - F.col("n")).alias("n_d")).unionByName(total.select(F.lit(None).cast(data.schema[region].dataType).alias("region"), F.col("all").alias("n_d")))
        counts = _by_regions(data, rp_edges, pi_edges, axes, weight, region)
        whole = counts.groupBy("rp_bin", "pi_bin").agg(F.sum("dd").alias("whole"))
        gone = counts.select("rp_bin", "pi_bin", F.explode(F.array_distinct(F.array("one", "two"))).alias("region"), "dd").groupBy("rp_bin", "pi_bin", "region").agg(F.sum("dd").alias("gone"))
        every = rr.crossJoin(sizes).join(whole, ["rp_bin", "pi_bin"], "left").join(gone, ["rp_bin", "pi_bin", "region"], "left")  # bins times regions
        j = every.withColumn("dd", F.coalesce("whole", F.lit(0.0)) - F.coalesce("gone", F.lit(0.0)))
    else:
        counts = rp_pi_counts(data, None, rp_edges, pi_edges, axes, weight).select("rp_bin", "pi_bin", F.col("wpairs").alias("dd"))
        j = rr.join(counts, ["rp_bin", "pi_bin"], "left").crossJoin(data.agg(F.count("*").cast("double").alias("n_d"))).na.fill(0.0, ["dd"])  # one row
    random = F.col("rr") * F.lit(factor)
    frr, fdr = random / F.lit(n_r * (n_r - 1) / 2), 2 * F.col("n_d") / F.lit(n_r) * random / (F.col("n_d") * F.lit(n_r))
    xi = F.coalesce(ratio(F.col("dd") / (F.col("n_d") * (F.col("n_d") - 1) / 2) - 2 * fdr + frr, frr), F.lit(0.0))
    widths = F.element_at(F.array(*[F.lit(float(b - a)) for a, b in zip(pi_edges[:-1], pi_edges[1:], strict=True)]), F.col("pi_bin") + 1)
    return j.groupBy("rp_bin", *(["region"] if region else [])).agg((2 * F.sum(xi * widths)).alias("wp"))


def _by_regions(data: DataFrame, rp_edges: Sequence[float], pi_edges: Sequence[float], axes: Sequence[str], weight: str | None, region: str) -> DataFrame:
    """(rp_bin, pi_bin, one, two, dd): data pairs by the regions of both ends, either way round; null weights count as 0.

    Points of one region at one place are one point with their weights' sum. With A and B the
    squared distances of the ends from the observer, pi is |B - A| / sqrt(2 A + 2 B - d2).
    """
    rp_at, pi_at, n_pi = [root_reaches(float(e)) for e in rp_edges], list(map(float, pi_edges)), len(pi_edges) - 1
    code = F.xxhash64(region)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = data.select("id", *[F.col(x).cast("double").alias(x) for x in axes], code.alias("_region"), w.alias("_w"), (F.count("*").over(Window.partitionBy("id")) > 1).alias("_again"))
    # an id that comes again meets all but itself, so it stays apart
    places = rows.groupBy(*axes, "_region", F.when(F.col("_again"), F.col("id")).alias("_apart")).agg(F.min("id").alias("id"), F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"), F.max("_again").alias("_again"))

    def work(mine, theirs):
        (ones, one), (twos, two) = (np.unique(v["_region"], return_inverse=True) for v in (mine, theirs))
        shape = (len(rp_edges) - 1, n_pi, len(ones), len(twos))
        sums, regions = np.zeros(math.prod(shape)), len(ones) * len(twos)
        other = theirs["_w"] * np.where(theirs["_own"], 0.5, 1.0)  # of its own tile a pair comes from both ends
        one = one * len(twos)

        def add(block, chunk, at, gaps, d2):
            a, b = (sum(x * x for x in v) for v in at)
            near = d2 < np.inf
            d2[~near] = 0.0
            sight = 2 * (a[:, None] + b[None]) - d2
            pi = np.divide(np.abs(b[None] - a[:, None]), np.sqrt(np.maximum(sight, 0.0, out=sight), out=sight), out=np.zeros_like(d2), where=sight > 0)
            across = d2 - pi * pi
            i, j = (sum((v >= e).view(np.int8) for e in edges) - 1 for v, edges in ((across, rp_at), (pi, pi_at)))
            near &= (i >= 0) & (i < shape[0]) & (j >= 0) & (j < n_pi)
            found = np.flatnonzero(near)
            p, q = block[found // len(chunk)], chunk[found % len(chunk)]
            places = (i.ravel()[found].astype(np.intp) * n_pi + j.ravel()[found]) * regions + one[p] + two[q]
            sums[:] += np.bincount(places, mine["_w"][p] * other[q], len(sums))

        def done():
            held = sums.reshape(shape)
            i, j, p, q = np.nonzero(held)
            return {"rp_bin": i.astype(np.int32), "pi_bin": j.astype(np.int32), "one": ones[p], "two": twos[q], "dd": held[i, j, p, q]}

        return add, done

    kept = ("_region", "_w")
    found = pair_sums(places, places, math.hypot(rp_edges[-1], pi_edges[-1]), work, "rp_bin int, pi_bin int, one long, two long, dd double", axes, kept, kept, same=True, once=True)
    if rp_edges[0] <= 0 <= rp_edges[-1] and pi_edges[0] <= 0 <= pi_edges[-1]:
        at = [F.lit(sum(e <= 0 for e in edges) - 1).alias(k) for k, edges in (("rp_bin", rp_edges), ("pi_bin", pi_edges))]
        inside = _finite_rows(places, axes).where("not _again").select(*at, F.col("_region").alias("one"), F.col("_region").alias("two"), ((F.col("_w") * F.col("_w") - F.col("_w2")) / 2).alias("dd"))
        found = found.unionByName(inside)
    sums = found.groupBy("rp_bin", "pi_bin", "one", "two").agg(F.sum("dd").alias("dd"))
    names = data.select(F.col(region).alias("name"), code.alias("code")).distinct()
    named = sums.join(names.select(F.col("code").alias("one"), F.col("name").alias("name_one")), "one").join(names.select(F.col("code").alias("two"), F.col("name").alias("name_two")), "two")
    return named.select("rp_bin", "pi_bin", F.col("name_one").alias("one"), F.col("name_two").alias("two"), "dd")


def _finite_rows(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    return df.where(" and ".join(f"abs(`{x}`) < double('inf')" for x in axes))


#: Steps of the table that a radial density is read from.
STEPS = 1024


def window_cells(spark, mask: DataFrame, nside: int, radial: tuple[np.ndarray, np.ndarray], origin: Sequence[float], side: float, level: int, bits: int = 16) -> DataFrame:
    """(c0, c1, c2, w): the survey's window as weighted cells of one level of a cube, in place of randoms; cells without weight are left out.

    The cube has its first corner at ``origin``, the observer at 0, and is ``side`` wide;
    coordinates are whole numbers of 2^-bits of it. A cell weighs the completeness of the sky
    (pix, completeness; missing pixels 0) in the direction of its middle, times the radial density
    there, which ``radial`` gives for distances as radial_density() does and which is 0
    beyond them, over the squared distance. 8^level cells are worked out on the executors.
    """
    n = 1 << level
    chi, density = (np.asarray(v, float) for v in radial)
    grid = np.linspace(chi[0], chi[-1], STEPS + 1)
    at_steps = np.interp(grid, chi, density)
    table = spark.createDataFrame([(i, float(at_steps[i]), float(at_steps[i + 1])) for i in range(STEPS)], "low int, p0 double, p1 double")  # STEPS rows
    step = (grid[-1] - grid[0]) / STEPS
    at = [F.pmod(F.shiftright("id", level * i), F.lit(n)).alias(f"k{i}") for i in range(3)]
    spots = [F.lit(float(o)) + (F.col(f"k{i}") + 0.5) * F.lit(side / n) for i, o in enumerate(origin)]
    middles = spark.range(n**3).select(*at).select("*", *[x.alias(c) for x, c in zip(spots, "xyz", strict=True)]).select("*", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("chi"))
    inside = middles.where((F.col("chi") >= F.lit(float(grid[0]))) & (F.col("chi") <= F.lit(float(grid[-1]))) & (F.col("chi") > 0))
    place = (F.col("chi") - F.lit(float(grid[0]))) / F.lit(step)
    low = F.least(F.floor(place), F.lit(STEPS - 1)).cast("int")
    # behind a generator each direction is worked out once, and not copied into the many places where pixel() needs it
    seen = inside.select(F.inline(F.array(F.struct("k0", "k1", "k2", "chi", F.degrees(F.atan2("y", "x")).alias("ra"), (F.col("z") / F.col("chi")).alias("u")))))
    found = seen.select("k0", "k1", "k2", "chi", pixel(F.col("ra"), F.col("u"), nside).alias("pix"), low.alias("low"), (place - low).alias("part"))
    p = F.col("p0") * (1 - F.col("part")) + F.col("p1") * F.col("part")
    met = found.join(F.broadcast(table), "low").join(mask.select("pix", F.col("completeness").cast("double").alias("m")), "pix").select("k0", "k1", "k2", (F.col("m") * p / (F.col("chi") * F.col("chi"))).alias("w"))
    width = 1 << (bits - level)
    return met.where("w > 0").select(*[(F.col(f"k{i}") * width + width // 2).cast("long").alias(f"c{i}") for i in range(3)], "w")


def xi_from_window(data: DataFrame, window: DataFrame, levels: Sequence[int], bits: int = 16, axes: Sequence[str] = AXES, weight: str | None = "w") -> DataFrame:
    """(level, dd, dr, rr, xi): xi_shells() with window_cells() in place of randoms.

    The window is a density, not points: its pairs include those inside its cells, so RR is
    W^2 / 2, the same on every run. ``levels`` end at the level of the window's cells or above;
    in the shell of the last one RR is that of a density even over a cell.
    """
    rows = data.select(*axes, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    c = cells(rows, window.select(*[F.col(x).alias(a) for x, a in zip(("c0", "c1", "c2"), axes, strict=True)], "w"), axes, bits, levels, "w")
    return xi_of_cells(c.withColumn("sw2_r", F.lit(0.0)), levels)
