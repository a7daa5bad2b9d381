"""Pair histograms, correlation estimators, projected correlations and per-point weights."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.coords import Sights, ap_rescale, bin_of, legendre_array, root_reaches, soft_bin
from pointloom.functions.kernels import ARRAY_KERNELS, KERNELS, SUPPORT, shell_volumes
from pointloom.operators.cells import ratio
from pointloom.operators.neighbours import cut
from pointloom.operators.rangejoin import AXES, pairs, self_pairs
from pointloom.operators.tiles import BLOCK, PAIRED, images, inside_places, near_counts, pair_sums, place_rows, place_sums, places, triangle_counts


def _numbers(spark, n: int, name: str = "bin") -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def _d2_bin(edges: Sequence[float]) -> Column:
    """Bin of the separation, decided on squares, so whole-number coordinates are exact."""
    return bin_of(F.col("d2"), [e * e for e in edges])


def binned_pairs(a: DataFrame, b: DataFrame | None, edges: Sequence[float], axes: Sequence[str] = AXES, weight: str | None = "w", box: float | None = None) -> DataFrame:
    """(a_id, b_id, a_w, b_w, axes.., d2, bin) of pairs in [e_0, e_n); of one catalog (b None) unordered. Coincident points are left out."""
    keep = ("id", weight) if weight else ("id",)
    found = self_pairs(a, edges[-1], axes, keep, box) if b is None else pairs(a, b, edges[-1], axes, keep, box)
    return found.where("d2 > 0").withColumn("bin", _d2_bin(edges)).where("bin is not null")


def _in_bins(a: DataFrame, b: DataFrame | None, edges: Sequence[float], axes: Sequence[str], weight: str | None, box: float | None = None) -> DataFrame:
    """near_counts() in space or in a periodic box, whose class k + 1 is bin k; class 0 is nearer than the bins, and holds coincident points."""
    tops = [max(e * e, np.nextafter(0.0, 1.0)) if i == 0 else e * e for i, e in enumerate(edges)]
    others = a if b is None else b
    return near_counts(a, others if box is None else images(others, edges[-1], box, axes), tops, axes, weight=weight, same=b is None, keep=[weight] if weight else [])


def pair_histogram(a: DataFrame, b: DataFrame | None, edges: Sequence[float], axes: Sequence[str] = AXES, weight: str | None = "w", box: float | None = None) -> DataFrame:
    """(bin, npairs, wpairs) for every bin; of one catalog pairs are ordered (each counts twice), of two single."""
    h = _in_bins(a, b, edges, axes, weight, box)
    bins = range(len(edges) - 1)
    sums = h.agg(*[F.coalesce(F.sum(f"n{k + 1}"), F.lit(0)).alias(f"n{k}") for k in bins], *[F.coalesce(F.sum(F.col(weight) * F.col(f"w{k + 1}") if weight else F.col(f"n{k + 1}")), F.lit(0)).cast("double").alias(f"w{k}") for k in bins])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"n{k}").alias("npairs"), F.col(f"w{k}").alias("wpairs")) for k in bins])))


def analytic_rr(n: int, edges: Sequence[float], box: float) -> list[float]:
    """Ordered random pairs of n points in a periodic box."""
    return [n * (n - 1) * v / box**3 for v in shell_volumes(edges)]


def xi_estimators(data: DataFrame, randoms: DataFrame, edges: Sequence[float], axes: Sequence[str] = AXES, box: float | None = None) -> DataFrame:
    """(bin, dd, dr, rr, xi_simple, xi_dp, xi_ls, xi_hamilton) from unweighted ordered counts.

    Counts are brought to one catalog size; Hamilton's ratio needs no sizes. Where a divisor is
    0 the estimate is 0 (simple, LS) or null (the others).
    """
    dd, dr, rr = (pair_histogram(a, b, edges, axes, None, box) for a, b in ((data, None), (data, randoms), (randoms, None)))
    return xi_from_counts(data, randoms, dd, dr, rr)


def xi_from_counts(data: DataFrame, randoms: DataFrame, dd: DataFrame, dr: DataFrame, rr: DataFrame) -> DataFrame:
    """xi_estimators() from counts (bin, npairs) that are there already, one row for every bin."""
    dd, dr, rr = (h.select("bin", F.col("npairs").alias(name)) for h, name in ((dd, "dd"), (dr, "dr"), (rr, "rr")))
    sizes = data.agg(F.count("*").cast("double").alias("nd")).crossJoin(randoms.agg(F.count("*").cast("double").alias("nr")))
    j = dd.join(dr, "bin").join(rr, "bin").crossJoin(F.broadcast(sizes))  # one row
    fdd, fdr, frr = F.col("dd") / (F.col("nd") * F.col("nd")), F.col("dr") / (F.col("nd") * F.col("nr")), F.col("rr") / (F.col("nr") * F.col("nr"))
    return j.select(
        "bin", "dd", "dr", "rr", F.coalesce(ratio(fdd, frr) - 1, F.lit(0.0)).alias("xi_simple"), (ratio(fdd, fdr) - 1).alias("xi_dp"), F.coalesce(ratio(fdd - 2 * fdr + frr, frr), F.lit(0.0)).alias("xi_ls"), (ratio(fdd * frr, fdr * fdr) - 1).alias("xi_hamilton")
    )


def per_point_counts(a: DataFrame, b: DataFrame | None, edges: Sequence[float], axes: Sequence[str] = AXES, box: float | None = None) -> DataFrame:
    """(id, bin, n): partners of each point of ``a`` in each bin that has some; of one catalog both ends count."""
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"n{k + 1}").alias("n")) for k in range(len(edges) - 1)]))
    return _in_bins(a, b, edges, axes, None, box).select("id", rows).where("n > 0")


def lisa_weights(data: DataFrame, randoms: DataFrame, edges: Sequence[float], axes: Sequence[str] = AXES, mode: str = "rr_xi", floor: float = 0.0, box: float | None = None) -> DataFrame:
    """(id, delta, weight): each point's overdensity of neighbours, bins weighted by a_j, and 1 + delta.

    a_j is RR |xi| where xi > ``floor`` (mode 'rr_xi'; plain RR if that is 0 throughout), RR
    ('rr') or 1 in the first bin alone ('smallest'). delta = (N_R / N_D) sum a b_DD / sum a b_DR - 1,
    and 0 for a point without random partners. Partners are counted once for each point, as a
    table, and those counts summed for the estimate.
    """
    mine, others = (cut(per_point_counts(data, b, edges, axes, box)) for b in (None, randoms))
    every = _numbers(data.sparkSession, len(edges) - 1)
    summed = lambda counts: every.join(counts.groupBy("bin").agg(F.sum("n").alias("npairs")), "bin", "left").na.fill(0, ["npairs"])
    est = xi_from_counts(data, randoms, summed(mine), summed(others), pair_histogram(randoms, None, edges, axes, None, box))
    a = {"rr_xi": F.when(F.col("xi_ls") > floor, F.col("rr") * F.abs("xi_ls")).otherwise(0.0), "rr": F.col("rr").cast("double"), "smallest": F.when(F.col("bin") == 0, 1.0).otherwise(0.0)}[mode]
    coefficients = est.select("bin", "rr", a.alias("a0"))
    total = coefficients.agg(F.sum("a0").alias("all_a"))
    coefficients = coefficients.crossJoin(F.broadcast(total)).select("bin", F.when(F.col("all_a") == 0, F.col("rr").cast("double")).otherwise(F.col("a0")).alias("a"))
    part = lambda counts, name: counts.join(F.broadcast(coefficients), "bin").groupBy("id").agg(F.sum(F.col("a") * F.col("n")).alias(name))  # noqa: E731  one row a bin
    sizes = data.agg(F.count("*").alias("nd")).crossJoin(randoms.agg(F.count("*").alias("nr")))
    j = data.select("id").join(part(mine, "bd"), "id", "left").join(part(others, "br"), "id", "left").crossJoin(F.broadcast(sizes))
    delta = F.coalesce(ratio(F.col("nr") * F.coalesce("bd", F.lit(0.0)), F.col("nd") * F.col("br")) - 1, F.lit(0.0))
    return j.select("id", delta.alias("delta")).withColumn("weight", 1 + F.col("delta"))


def multipole_sums(data: DataFrame, edges: Sequence[float], order: int, los: int = 2, axes: Sequence[str] = AXES) -> DataFrame:
    """(id, n, sum_p): partners of each point and the sum of P_L of the angle to one axis, over all bins."""
    low = edges[0] ** 2

    def work(mine, theirs):
        n, total = np.zeros(len(mine["id"]), np.int64), np.zeros(len(mine["id"]))

        def add(block, chunk, at, gaps, d2):
            inside = (d2 > 0) & (d2 >= low) & (d2 < np.inf)
            n[block] += np.count_nonzero(inside, axis=1)
            total[block] += np.where(inside, legendre_array(order, gaps[los] / np.sqrt(np.where(inside, d2, 1.0))), 0.0).sum(1)

        return add, lambda: {"id": mine["id"][n > 0], "n": n[n > 0], "sum_p": total[n > 0]}

    ident = dict(data.dtypes)["id"]
    found = pair_sums(data, data, edges[-1], work, f"id {ident}, n long, sum_p double", axes, same=True)
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("sum_p").alias("sum_p"))


def pair_tensor(data: DataFrame, edges: Sequence[float], axes: Sequence[str] = AXES) -> DataFrame:
    """(id, bin, n, txx, tyy, tzz, txy, txz, tyz): per point and bin the sum of n n^T over unit separations."""
    names = {"txx": (0, 0), "tyy": (1, 1), "tzz": (2, 2), "txy": (0, 1), "txz": (0, 2), "tyz": (1, 2)}
    squares, bins = [e * e for e in edges], len(edges) - 1
    far_apart = edges[0] > edges[-1] / 100  # so that sums of products of coordinates, less the point's own, keep their digits

    def work(mine, theirs):
        size = len(mine["id"])
        n, sums = np.zeros((size, bins), np.int64), np.zeros((size, bins, len(names)))

        def add(block, chunk, at, gaps, d2):
            if far_apart:
                here = at[0] - at[0].mean(1)[:, None]
                u = (at[1] - at[0].mean(1)[:, None]).T
                columns = np.concatenate([np.ones((len(u), 1)), u, np.stack([u[:, i] * u[:, j] for i, j in names.values()], 1)], 1)
            for k in range(bins):
                inside = (d2 > 0) & (d2 >= squares[k]) & (d2 < squares[k + 1])
                found = np.count_nonzero(inside, axis=1)
                if not found.any():
                    continue
                n[block, k] += found
                w = np.divide(1.0, d2, out=np.zeros_like(d2), where=inside)
                if far_apart:
                    g = w @ columns
                    for c, (i, j) in enumerate(names.values()):
                        sums[block, k, c] += g[:, 4 + c] - here[i] * g[:, 1 + j] - here[j] * g[:, 1 + i] + here[i] * here[j] * g[:, 0]
                else:
                    for c, (i, j) in enumerate(names.values()):
                        sums[block, k, c] += np.einsum("ij,ij,ij->i", w, gaps[i], gaps[j])

        def done():
            i, k = np.nonzero(n)
            return {"id": mine["id"][i], "bin": k.astype(np.int32), "n": n[i, k], **dict(zip(names, sums[i, k].T, strict=True))}

        return add, done

    ident = dict(data.dtypes)["id"]
    found = pair_sums(data, data, edges[-1], work, f"id {ident}, bin int, n long, " + ", ".join(f"{c} double" for c in names), axes, same=True)
    return found.groupBy("id", "bin").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])


def triangles(data: DataFrame, target: float, width: float, axes: Sequence[str] = AXES, box: float | None = None) -> DataFrame:
    """(id, n): triangles at each vertex all of whose sides lie within ``width`` of ``target``.

    They are counted by tiles. In a periodic box, where sides may be 0, and where an id repeats, so that its
    points are one vertex, the near pairs are a table and joined.
    """
    if box is None and target > width >= 0 and data.groupBy("id").count().where("count > 1").isEmpty():
        return triangle_counts(data, target - width, target + width, axes)
    low, high = (target - width) ** 2, (target + width) ** 2
    near = cut(self_pairs(data, target + width, axes, ("id",), box, closed=True).where((F.col("d2") >= F.lit(low)) & (F.col("d2") <= F.lit(high))).select("a_id", "b_id"))
    degree = near.select(F.explode(F.array("a_id", "b_id")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ends = near.join(degree.select(F.col("id").alias("a_id"), F.col("n").alias("a_n")), "a_id").join(degree.select(F.col("id").alias("b_id"), F.col("n").alias("b_n")), "b_id")
    # edges point to the end with more of them, ties by id, so that a hub's edges do not meet each other
    a, b = F.struct(F.col("a_n").alias("n"), F.col("a_id").alias("id")), F.struct(F.col("b_n").alias("n"), F.col("b_id").alias("id"))
    e = ends.select(F.least(a, b)["id"].alias("i"), F.greatest(a, b).alias("j"))
    wedges = e.join(e.select("i", F.col("j").alias("k")), "i").where("j < k")  # the order in which an edge would join the far ends
    found = wedges.select("i", F.col("j.id").alias("j"), F.col("k.id").alias("k")).join(e.select(F.col("i").alias("j"), F.col("j.id").alias("k")), ["j", "k"])
    return found.select(F.explode(F.array("i", "j", "k")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def rp_pi_counts(a: DataFrame, b: DataFrame | None, rp_edges: Sequence[float], pi_edges: Sequence[float], axes: Sequence[str] = AXES, weight: str | None = "w", z: str | None = None, z_edges: Sequence[float] | None = None) -> DataFrame:
    """(rp_bin, pi_bin[, z_bin], npairs, wpairs): unordered pairs by separation across and along the line of sight, occupied bins; null weights count as 0.

    Points at one place (and of one ``z``) are one point, and each pair of places comes once.
    """
    held = [None if c is None else cut(_sights(c, axes, weight, z)) for c in (a, b)]
    return _rp_pi(*held, rp_edges, pi_edges, axes, weight, z, z_edges)


def _sights(df: DataFrame, axes: Sequence[str], weight: str | None, z: str | None) -> DataFrame:
    """The places of a catalog, those of one redshift apart, for _rp_pi()."""
    return places(df.withColumn("_z", F.col(z).cast("double")) if z else df, axes, weight, ["_z"] if z else [])


def _rp_pi(a: DataFrame, b: DataFrame | None, rp_edges: Sequence[float], pi_edges: Sequence[float], axes: Sequence[str], weight: str | None, z: str | None = None, z_edges: Sequence[float] | None = None) -> DataFrame:
    """rp_pi_counts() of _sights()."""
    edges = [list(map(float, e)) for e in (rp_edges, pi_edges, *([z_edges] if z else []))]
    reached = [[root_reaches(e) for e in edges[0]], *edges[1:]]
    shape = [len(e) + 1 for e in edges]  # and what lies below and beyond
    by = ["rp_bin", "pi_bin", "z_bin"][: len(shape)]

    def work(mine, theirs):
        size = math.prod(shape)
        n, sums = np.zeros(size), np.zeros(size)

        kind = np.int8 if size < 128 else np.int16 if size < 32768 else np.int32
        sights, product = Sights(mine["_at"], theirs["_at"], BLOCK * PAIRED), np.empty(BLOCK * PAIRED)

        def add(block, chunk, at, d2):
            across, pi = sights(block, chunk, d2)
            values = [across, pi, *([(mine["_z"][block][:, None] + theirs["_z"][chunk][None]) / 2] if z else [])]
            code = np.zeros(d2.shape, kind)
            for i, (v, e, k) in enumerate(zip(values, reached, shape, strict=True)):
                if i:
                    code *= k
                for t in e:
                    np.add(code, (v >= t).view(np.int8), out=code)
            code = code.ravel().astype(np.intp)

            def count(w):
                p = product[: d2.size].reshape(d2.shape)
                return np.bincount(code, np.multiply(mine[w][block][:, None], theirs[w][chunk][None], out=p).ravel(), size)

            n[:] += count("_n")
            if weight:
                sums[:] += count("_w")

        def done():
            inner = tuple(slice(1, -1) for _ in shape)
            held, weights = n.reshape(shape)[inner], (sums if weight else n).reshape(shape)[inner]
            at_ = np.nonzero(held)
            return {**{k: v.astype(np.int32) for k, v in zip(by, at_, strict=True)}, "npairs": held[at_], "wpairs": weights[at_]}

        return add, done, sights.narrow(edges[0][-1], edges[1][-1])

    found = place_sums(a, b, math.hypot(rp_edges[-1], pi_edges[-1]), work, ", ".join(f"{k} int" for k in by) + ", npairs double, wpairs double", axes, ["_z"] if z else [])
    if b is None and all(e[0] <= 0 < e[-1] for e in edges[:2]):  # pairs of one place
        rows, pairs_, products = inside_places(a)
        at = [F.lit(sum(t <= 0 for t in e) - 1).alias(k) for k, e in zip(by, edges[:2])]  # noqa: B905
        inside = rows.select(*at, *([bin_of(F.col("_z"), edges[2]).cast("int").alias("z_bin")] if z else []), pairs_.alias("npairs"), (products if weight else pairs_).alias("wpairs"))
        found = found.unionByName(inside.where("z_bin is not null") if z else inside)
    return found.groupBy(*by).agg(F.round(F.sum("npairs")).cast("long").alias("npairs"), F.sum("wpairs").alias("wpairs"))


def _ls_grid(data: DataFrame, randoms: DataFrame, counts: Sequence[DataFrame], by: Sequence[str], every: DataFrame) -> DataFrame:
    """Landy-Szalay on a grid of bins from unordered counts; 0 where RR is 0. Norms by N."""
    sizes = data.agg(F.count("*").cast("double").alias("nd")).crossJoin(randoms.agg(F.count("*").cast("double").alias("nr")))
    j = every
    for c, name in zip(counts, ("dd", "dr", "rr"), strict=True):
        j = j.join(c.select(*by, F.col("wpairs").alias(name)), list(by), "left")
    j = j.na.fill(0.0, ["dd", "dr", "rr"]).crossJoin(F.broadcast(sizes))
    nd, nr = F.col("nd"), F.col("nr")
    fdd, fdr, frr = F.col("dd") / (nd * (nd - 1) / 2), F.col("dr") / (nd * nr), F.col("rr") / (nr * (nr - 1) / 2)
    return j.select(*by, "dd", "dr", "rr", F.coalesce(ratio(fdd - 2 * fdr + frr, frr), F.lit(0.0)).alias("xi"))


def xi_rp_pi(data: DataFrame, randoms: DataFrame, rp_edges: Sequence[float], pi_edges: Sequence[float], axes: Sequence[str] = AXES, weight: str | None = None) -> DataFrame:
    """(rp_bin, pi_bin, dd, dr, rr, xi) for every bin."""
    d, r = (cut(_sights(df, axes, weight, None)) for df in (data, randoms))
    counts = [_rp_pi(x, y, rp_edges, pi_edges, axes, weight) for x, y in ((d, None), (d, r), (r, None))]
    spark = data.sparkSession
    every = _numbers(spark, len(rp_edges) - 1, "rp_bin").crossJoin(_numbers(spark, len(pi_edges) - 1, "pi_bin"))
    return _ls_grid(data, randoms, counts, ("rp_bin", "pi_bin"), every)


def wp(xi: DataFrame, pi_edges: Sequence[float]) -> DataFrame:
    """(rp_bin, wp): twice the sum of xi over the line of sight."""
    widths = F.element_at(F.array(*[F.lit(b - a) for a, b in zip(pi_edges[:-1], pi_edges[1:], strict=True)]), F.col("pi_bin") + 1)
    return xi.groupBy("rp_bin").agg((2 * F.sum(F.col("xi") * widths)).alias("wp"))


def wp_kernel_z(data: DataFrame, randoms: DataFrame, rp_edges: Sequence[float], pi_edges: Sequence[float], z_edges: Sequence[float], z_eff: float, sigma: float, axes: Sequence[str] = AXES, z: str = "z") -> DataFrame:
    """(rp_bin, wp): projected correlation of pairs weighted by a Gaussian in their mean redshift about z_eff."""
    centre = F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip(z_edges[:-1], z_edges[1:], strict=True)]), F.col("z_bin") + 1)
    g = F.exp(-F.pow((centre - F.lit(z_eff)) / F.lit(sigma), 2) / 2)
    d, r = (cut(_sights(df, axes, None, z)) for df in (data, randoms))
    counts = [_rp_pi(x, y, rp_edges, pi_edges, axes, None, z, z_edges).groupBy("rp_bin", "pi_bin").agg(F.sum(g * F.col("wpairs")).alias("wpairs")) for x, y in ((d, None), (d, r), (r, None))]
    spark = data.sparkSession
    every = _numbers(spark, len(rp_edges) - 1, "rp_bin").crossJoin(_numbers(spark, len(pi_edges) - 1, "pi_bin"))
    return wp(_ls_grid(data, randoms, counts, ("rp_bin", "pi_bin"), every), pi_edges)


def kernel_sums(a: DataFrame, b: DataFrame | None, radius: float, kernel: str = "top_hat", axes: Sequence[str] = AXES) -> DataFrame:
    """(id, s): for each point of ``a`` the sum of a pair kernel over its partners; points without one are absent."""
    rows, key = place_rows(a, axes, None, same=b is None)
    held = cut(places(a, axes, same=b is None).withColumn("_place", F.monotonically_increasing_id()))
    found = _kernel_sums(held, None if b is None else cut(places(b, axes, same=False)), radius, kernel, axes)
    return rows.join(held.join(found, "_place").select(*[F.col(c).alias(f"_{c}") for c in key], "s"), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])).groupBy("id").agg(F.sum("s").alias("s"))


def _kernel_sums(a: DataFrame, b: DataFrame | None, radius: float, kernel: str, axes: Sequence[str]) -> DataFrame:
    """(_place, s): kernel_sums() for one point of each of places()."""
    of = ARRAY_KERNELS[kernel]
    top = (radius * SUPPORT[kernel]) ** 2

    def work(mine, theirs):
        n, sums = np.zeros(len(mine["id"])), np.zeros(len(mine["id"]))

        def add(block, chunk, at, d2):
            near = (d2 < top).astype(np.float64)
            k = of(np.sqrt(np.minimum(d2, top, out=d2), out=d2), radius)
            np.multiply(k, near, out=k)
            n[block] += near @ theirs["_n"][chunk]
            sums[block] += k @ theirs["_n"][chunk]

        return add, lambda: {"_place": mine["_place"][n > 0], "s": sums[n > 0]}

    found = place_sums(a, b, radius * SUPPORT[kernel], work, "_place long, s double", axes, mine=["_place"], once=False)
    if b is None:
        at_0 = float(of(np.zeros(1), radius)[0])
        found = found.unionByName(inside_places(a)[0].select("_place", ((F.col("_n") - 1) * at_0).alias("s")))
    return found.groupBy("_place").agg(F.sum("s").alias("s"))


def density_weights(data: DataFrame, randoms: DataFrame, radius: float, kernel: str = "top_hat", axes: Sequence[str] = AXES) -> DataFrame:
    """(id, weight): 1 + delta from kernel sums over data and randoms; 1 where no random is near."""
    sizes = data.agg(F.count("*").alias("nd")).crossJoin(randoms.agg(F.count("*").alias("nr")))
    j = data.select("id").join(kernel_sums(data, None, radius, kernel, axes).withColumnRenamed("s", "sd"), "id", "left").join(kernel_sums(data, randoms, radius, kernel, axes).withColumnRenamed("s", "sr"), "id", "left")
    return j.crossJoin(F.broadcast(sizes)).select("id", F.coalesce(ratio(F.coalesce("sd", F.lit(0.0)) * F.col("nr"), F.col("sr") * F.col("nd")), F.lit(1.0)).alias("weight"))


def neighbour_density(data: DataFrame, others: DataFrame, radius: float, axes: Sequence[str] = AXES, box: float | None = None) -> DataFrame:
    """(id, n, density): points of ``others`` within a radius of each point, the point's own id aside; 0 where there is none."""
    p = near_counts(data, others if box is None else images(others, radius, box, axes), [radius * radius], axes, same=True).groupBy("id").agg(F.sum("n0").alias("n"))
    volume = 4 / 3 * math.pi * radius**3
    return data.select("id").join(p, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).withColumn("density", F.col("n") / F.lit(volume))


def ap_histogram(data: DataFrame, randoms: DataFrame | None, edges: Sequence[float], alpha_par: float, alpha_perp: float, los: int = 2, soft: bool = False, axes: Sequence[str] = AXES, weight: str | None = "w") -> DataFrame:
    """(bin, wpairs): pairs re-binned after stretching along and across one axis; ordered for one catalog. ``soft`` splits a pair between bins."""
    reach = edges[-1] / min(alpha_par, alpha_perp, 1.0)
    if not soft:
        return _ap_sums(data, randoms, edges, alpha_par, alpha_perp, los, axes, weight, reach)
    keep = ("id", weight) if weight else ("id",)
    p = (self_pairs(data, reach, axes, keep) if randoms is None else pairs(data, randoms, reach, axes, keep)).where("d2 > 0")
    mu = (F.col(f"b_{axes[los]}") - F.col(f"a_{axes[los]}")) / F.sqrt("d2")
    new, _ = ap_rescale(F.sqrt("d2"), mu, alpha_par, alpha_perp)
    product = (F.col(f"a_{weight}") * F.col(f"b_{weight}") if weight else F.lit(1.0)) * (2.0 if randoms is None else 1.0)
    rows = p.select(product.alias("p"), new.alias("s"))
    return rows.select("p", F.inline(soft_bin(F.col("s"), edges))).groupBy("bin").agg(F.sum(F.col("p") * F.col("part")).alias("wpairs"))


def _ap_sums(data: DataFrame, randoms: DataFrame | None, edges: Sequence[float], alpha_par: float, alpha_perp: float, los: int, axes: Sequence[str], weight: str | None, reach: float) -> DataFrame:
    """ap_histogram() without split pairs; of one catalog each pair comes from both ends."""
    edges, bins = list(map(float, edges)), len(edges) - 1

    def work(mine, theirs):
        n, sums = np.zeros(bins, np.int64), np.zeros(bins)

        def add(block, chunk, at, gaps, d2):
            near = (d2 > 0) & (d2 < np.inf)
            d = np.sqrt(np.where(near, d2, 1.0))
            mu = gaps[los] / d
            along = alpha_par * d * mu
            s = np.sqrt(along * along + alpha_perp**2 * d * d * (1 - mu * mu))
            k = sum((s >= e).astype(np.int8) for e in edges) - 1
            near &= (k >= 0) & (s < edges[-1])
            found = k[near]
            n[:] += np.bincount(found, minlength=bins)
            if weight:
                sums[:] += np.bincount(found, (mine[weight][block][:, None] * theirs[weight][chunk][None])[near], bins)

        return add, lambda: {"bin": np.flatnonzero(n).astype(np.int32), "wpairs": (sums if weight else n)[n > 0].astype(float)}

    kept = [weight] if weight else []
    made = lambda df: df.select("id", *axes, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in kept])
    found = pair_sums(made(data), made(data if randoms is None else randoms), reach, work, "bin int, wpairs double", axes, kept, kept, same=randoms is None)
    return found.groupBy("bin").agg(F.sum("wpairs").alias("wpairs"))


def sigma2_from_counts(xi: DataFrame, edges: Sequence[float], radii: Sequence[float], kernel: str = "top_hat") -> DataFrame:
    """(radius, sigma2): (S_DD - 2 S_DR + S_RR) / S_RR with S = sum of f * K(bin centre), from columns fdd, fdr, frr by bin."""
    spark = xi.sparkSession
    grid = spark.createDataFrame([(float(r), i, 0.5 * (a + b)) for r in radii for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "radius double, bin int, r double")
    k = reduce(lambda other, r: F.when(F.col("radius") == F.lit(float(r)), KERNELS[kernel](F.col("r"), float(r))).otherwise(other), radii, F.lit(0.0))
    s = xi.join(F.broadcast(grid.withColumn("k", k)), "bin").groupBy("radius").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in ("fdd", "fdr", "frr")])
    return s.select("radius", ratio(F.col("fdd") - 2 * F.col("fdr") + F.col("frr"), F.col("frr")).alias("sigma2"))


def sigma2_from_xi(xi: DataFrame, radii: Sequence[float], kernel: str = "top_hat") -> DataFrame:
    """(radius, sigma2): integral of 4 pi r^2 xi(r) K(r; R) by trapezoids over (r, xi) rows."""
    spark = xi.sparkSession
    spread = xi.crossJoin(F.broadcast(spark.createDataFrame([(float(r),) for r in radii], "radius double")))  # the radii asked for
    k = reduce(lambda other, r: F.when(F.col("radius") == F.lit(float(r)), KERNELS[kernel](F.col("r"), float(r))).otherwise(other), radii, F.lit(0.0))
    rows = spread.select("radius", "r", (F.lit(4 * math.pi) * F.col("r") * F.col("r") * F.col("xi") * k).alias("f"))
    after = Window.partitionBy("radius").orderBy("r")  # as many rows as xi has bins
    parts = rows.select("radius", ((F.lead("f").over(after) + F.col("f")) / 2 * (F.lead("r").over(after) - F.col("r"))).alias("area"))
    return parts.groupBy("radius").agg(F.sum("area").alias("sigma2"))


def overdensity_windowed(data: DataFrame, randoms: DataFrame, edges: Sequence[float], axes: Sequence[str] = AXES, box: float | None = None) -> DataFrame:
    """(id, bin, delta): each point's partners over those among the randoms, brought to one catalog size, less 1; null in bins without a random partner."""
    sizes = data.agg(F.count("*").cast("double").alias("nd")).crossJoin(randoms.agg(F.count("*").cast("double").alias("nr")))
    every = data.select("id").crossJoin(F.broadcast(_numbers(data.sparkSession, len(edges) - 1)))  # the bins
    j = every.join(per_point_counts(data, None, edges, axes, box).withColumnRenamed("n", "b_d"), ["id", "bin"], "left").join(per_point_counts(data, randoms, edges, axes, box).withColumnRenamed("n", "b_r"), ["id", "bin"], "left")
    return j.crossJoin(F.broadcast(sizes)).select("id", "bin", (ratio(F.coalesce("b_d", F.lit(0)) * F.col("nr"), F.col("b_r") * F.col("nd")) - 1).alias("delta"))


def weighted_xi(points: DataFrame, edges: Sequence[float], box: float, axes: Sequence[str] = AXES, weight: str = "w") -> DataFrame:
    """(bin, xi): weighted pairs of a periodic box over those that as many random points would have, less 1; 0 for a bin without volume."""
    n = points.agg(F.count("*").cast("double").alias("n"))
    volume = F.element_at(F.array(*[F.lit(v) for v in shell_volumes(edges)]), F.col("bin") + 1)
    rr = F.col("n") * (F.col("n") - 1) * volume / F.lit(box**3)
    h = pair_histogram(points, None, edges, axes, weight, box).crossJoin(F.broadcast(n))  # one row
    return h.select("bin", F.when(rr > 0, F.col("wpairs") / rr - 1).otherwise(0.0).alias("xi"))


def recovery(found: DataFrame, target: DataFrame, rtol: float = 0.1) -> DataFrame:
    """(bin, error, ok): difference of two xi over the target's size, at least 0.001, and whether it stays within ``rtol``."""
    j = found.join(target.select("bin", F.col("xi").alias("target")), "bin")
    error = F.abs(F.col("xi") - F.col("target")) / F.greatest(F.abs(F.col("target")), F.lit(1e-3))
    return j.select("bin", error.alias("error")).withColumn("ok", F.col("error") <= rtol)


def sigma2_from_rp_pi(xi: DataFrame, rp_edges: Sequence[float], pi_edges: Sequence[float], radii: Sequence[float], kernel: str = "top_hat") -> DataFrame:
    """(radius, sigma2): as sigma2_from_counts() from columns fdd, fdr, frr by (rp_bin, pi_bin), each bin at the separation of its middle; 0 where the sum of RR is 0."""
    spark = xi.sparkSession
    mids = lambda edges: [(i, 0.5 * (a + b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    grid = spark.createDataFrame([(float(r), i, j, math.hypot(a, b)) for r in radii for i, a in mids(rp_edges) for j, b in mids(pi_edges)], "radius double, rp_bin int, pi_bin int, r double")
    k = reduce(lambda other, r: F.when(F.col("radius") == F.lit(float(r)), KERNELS[kernel](F.col("r"), float(r))).otherwise(other), radii, F.lit(0.0))
    s = xi.join(F.broadcast(grid.withColumn("k", k)), ["rp_bin", "pi_bin"]).groupBy("radius").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in ("fdd", "fdr", "frr")])
    return s.select("radius", F.coalesce(ratio(F.col("fdd") - 2 * F.col("fdr") + F.col("frr"), F.col("frr")), F.lit(0.0)).alias("sigma2"))
