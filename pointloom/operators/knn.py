"""Neighbour-count distributions in angular caps and redshift shells, and what follows from them.

Cubes are long tables: ladder (t, iq, jn[, region], k, h), the number of queries with at
least k neighbours, and moments (t, iq, jn[, region], n_q, s1..s4). Positions are unit
vectors x, y, z with redshift ``red``; caps are closed and decided on squared chords.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.coords import bin_of, chord
from pointloom.functions.cosmology import C_OVER_H100, Cosmology
from pointloom.operators.cells import ratio
from pointloom.operators.tiles import near_counts, pair_sums

XYZ = ("x", "y", "z")


def cap_counts(queries: DataFrame, neighbours: DataFrame, thetas: Sequence[float], q_edges: Sequence[float], n_edges: Sequence[float], same: bool, weight: str | None = None, region: str | None = None) -> DataFrame:
    """(id, iq[, region], t, jn, n): for each query with a shell, every cap and shell, the (weighted) neighbours; zeros included.

    ``same`` leaves out the neighbour with the query's own id.
    """
    chords2 = [chord(t) ** 2 for t in thetas]
    q = queries.select("id", *XYZ, bin_of(F.col("red"), q_edges).alias("iq"), *([region] if region else [])).where("iq is not null")
    kept = [weight] if weight else []
    n = neighbours.select("id", *XYZ, bin_of(F.col("red"), n_edges).alias("jn"), *kept).where("jn is not null")
    kind = "w" if weight else "n"
    near = near_counts(q, n, chords2, XYZ, "jn", weight, closed=True, same=same)
    caps = [sum((F.col(f"{kind}{s}") for s in range(1, t + 1)), F.col(f"{kind}0")).alias(f"n{t}") for t in range(len(thetas))]
    summed = near.select("id", F.col("label").cast("int").alias("jn"), *caps)
    shells = F.explode(F.array(*[F.lit(j) for j in range(len(n_edges) - 1)])).alias("jn")
    every = q.select("id", "iq", *([region] if region else []), shells)
    rows = F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.coalesce(F.col(f"n{t}"), F.lit(0)).alias("n")) for t in range(len(thetas))]))
    return every.join(summed, ["id", "jn"], "left").select("id", "iq", *([region] if region else []), "jn", rows)


def knn_moments(counts: DataFrame, region: str | None = None) -> DataFrame:
    """(t, iq, jn[, region], n_q, s1..s4): queries and power sums of their counts."""
    n = F.col("n").cast("double")
    return counts.groupBy("t", "iq", "jn", *([region] if region else [])).agg(F.count("*").alias("n_q"), *[F.sum(F.pow(n, k)).alias(f"s{k}") for k in (1, 2, 3, 4)])


def knn_ladder(counts: DataFrame, k_max: int, region: str | None = None) -> DataFrame:
    """(t, iq, jn[, region], k, h): queries with at least k = 1..k_max neighbours."""
    by = ["t", "iq", "jn", *([region] if region else [])]
    exact = counts.groupBy(*by, F.least(F.floor("n"), F.lit(k_max)).cast("int").alias("m")).agg(F.count("*").alias("c"))
    steps = exact.select(*by, "c", F.explode(F.when(F.col("m") > 0, F.sequence(F.lit(1), F.col("m")))).alias("k"))
    held = steps.groupBy(*by, "k").agg(F.sum("c").alias("h"))
    every = exact.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k_max))))
    return every.join(held, [*by, "k"], "left").select(*by, "k", F.coalesce("h", F.lit(0)).alias("h"))


def mean_count(m: DataFrame) -> DataFrame:
    return m.select("t", "iq", "jn", F.coalesce(ratio(F.col("s1"), F.col("n_q").cast("double")), F.lit(0.0)).alias("mean"))


def count_pmf(ladder: DataFrame, moments: DataFrame) -> DataFrame:
    """(t, iq, jn, k, p): P_0 .. P_{k_max - 1}, and P(N >= k_max) in the last row."""
    at = ladder.join(moments.select("t", "iq", "jn", "n_q"), ["t", "iq", "jn"]).select("t", "iq", "jn", "k", (F.col("h") / F.col("n_q")).alias("p"))
    zero = at.select("t", "iq", "jn").distinct().select("t", "iq", "jn", F.lit(0).alias("k"), F.lit(1.0).alias("p"))
    order = Window.partitionBy("t", "iq", "jn").orderBy("k")  # k_max + 1 rows
    return at.unionByName(zero).select("t", "iq", "jn", "k", (F.col("p") - F.lead("p", 1, 0.0).over(order)).alias("p"))


def pmf_moment(pmf: DataFrame, power: int) -> DataFrame:
    return pmf.groupBy("t", "iq", "jn").agg(F.sum(F.pow(F.col("k").cast("double"), power) * F.col("p")).alias("moment"))


def sigma2_clust(m: DataFrame, sample: bool = False) -> DataFrame:
    """(t, iq, jn, sigma2): (var - mean) / mean^2; the variance over all queries, or the sample's. Null where the mean is 0."""
    mean = F.col("s1") / F.col("n_q")
    var = F.col("s2") / F.col("n_q") - mean * mean
    if sample:
        var = F.when(F.col("n_q") > 1, var * F.col("n_q") / (F.col("n_q") - 1))
    return m.select("t", "iq", "jn", F.when(mean > 0, var / (mean * mean) - 1 / mean).alias("sigma2"))


def shape(m: DataFrame) -> DataFrame:
    """(t, iq, jn, skewness, kurtosis): standardised, excess; null where the variance is 0."""
    m1, m2, m3, m4 = (F.col(f"s{k}") / F.col("n_q") for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    third, fourth = m3 - 3 * m1 * m2 + 2 * F.pow(m1, 3), m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, 4)
    return m.select("t", "iq", "jn", F.when(var > 0, third / F.pow(var, 1.5)).alias("skewness"), F.when(var > 0, fourth / (var * var) - 3).alias("kurtosis"))


def shell_sizes(neighbours: DataFrame, n_edges: Sequence[float]) -> DataFrame:
    """(jn, size): points of a catalog in each shell."""
    return neighbours.select(bin_of(F.col("red"), n_edges).alias("jn")).where("jn is not null").groupBy("jn").agg(F.count("*").alias("size"))


def cap_means(m: DataFrame, sizes: DataFrame, name: str, power: int = 1) -> DataFrame:
    """(t, iq, jn, name): mean of N^power over the shell's size^power, so that catalogs of any density compare."""
    return m.join(F.broadcast(sizes), "jn").select("t", "iq", "jn", (F.col(f"s{power}") / F.col("n_q") / F.pow(F.col("size").cast("double"), power)).alias(name))  # one row a shell


def cap_moments(m: DataFrame, sizes: DataFrame, name: str, power: int) -> DataFrame:
    """(t, iq, jn, name): mean of N^power over the shell's size, the norm of the four-term moment estimates."""
    return m.join(F.broadcast(sizes), "jn").select("t", "iq", "jn", (F.col(f"s{power}") / F.col("n_q") / F.col("size")).alias(name))  # one row a shell


def _all_four(dd: DataFrame, dr: DataFrame, rd: DataFrame, rr: DataFrame) -> DataFrame:
    """Cap means or moments side by side; a cap or shell that one of them lacks raises no row."""
    return dd.join(dr, ["t", "iq", "jn"]).join(rd, ["t", "iq", "jn"]).join(rr, ["t", "iq", "jn"])


def moment_ls(dd: DataFrame, dr: DataFrame, rd: DataFrame, rr: DataFrame) -> DataFrame:
    """(t, iq, jn, moment): (dd - dr - rd + rr) / rr of cap_moments(), 0 where rr is 0."""
    four = F.col("dd") - F.col("dr") - F.col("rd") + F.col("rr")
    return _all_four(dd, dr, rd, rr).select("t", "iq", "jn", F.when(F.col("rr") > 0, four / F.col("rr")).otherwise(0.0).alias("moment"))


def moment_hamilton(dd: DataFrame, dr: DataFrame, rd: DataFrame, rr: DataFrame) -> DataFrame:
    """(t, iq, jn, moment): dd rr / (dr rd) - 1 of cap_moments(), -1 where the divisor is 0."""
    below = F.col("dr") * F.col("rd")
    return _all_four(dd, dr, rd, rr).select("t", "iq", "jn", (F.when(below > 0, F.col("dd") * F.col("rr") / below).otherwise(0.0) - 1).alias("moment"))


def sigma2_ls(first: DataFrame, second: DataFrame) -> DataFrame:
    """(t, iq, jn, sigma2): (m2 - m1^2) / m1^2 - 1 / m1 of moment_ls() for powers 1 and 2; null where m1 is not positive."""
    j = first.select("t", "iq", "jn", F.col("moment").alias("m1")).join(second.select("t", "iq", "jn", F.col("moment").alias("m2")), ["t", "iq", "jn"])
    m1, m2 = F.col("m1"), F.col("m2")
    return j.select("t", "iq", "jn", F.when(m1 > 0, (m2 - m1 * m1) / (m1 * m1) - 1 / m1).alias("sigma2"))


def xi_diag(xi: DataFrame) -> DataFrame:
    """The rows of equal query and neighbour shell."""
    return xi.where("iq = jn").drop("jn").withColumnRenamed("iq", "z_bin")


def xi_multipole(xi: DataFrame, thetas: Sequence[float], q_centres: Sequence[float], n_centres: Sequence[float], order: int, s_edges: Sequence[float], cosmology: Cosmology = Cosmology()) -> DataFrame:  # noqa: B008
    """(s_bin, xi): multipole of a (t, iq, jn, xi) cube, its cells put at (s, mu) by the mean redshift; sum of xi L over sum of L^2 in each bin of s.

    The geometry has one row a cell of the cube.
    """
    zs, ds = cosmology.table()
    rows = []
    for t, theta in enumerate(thetas):
        for i, a in enumerate(q_centres):
            for j, b in enumerate(n_centres):
                z = 0.5 * (a + b)
                across, along = float(np.interp(z, zs, ds)) * math.radians(theta), C_OVER_H100 * (b - a) / float(cosmology.e(z))
                s = math.hypot(across, along)
                mu = along / s if s > 0 else 0.0
                k = next((k for k, (low, high) in enumerate(zip(s_edges[:-1], s_edges[1:], strict=True)) if low <= s < high), None)
                if k is not None:
                    rows.append((t, i, j, k, {0: 1.0, 2: 1.5 * mu * mu - 0.5, 4: (35 * mu**4 - 30 * mu * mu + 3) / 8}[order]))
    at = xi.sparkSession.createDataFrame(rows, "t int, iq int, jn int, s_bin int, l double")
    joined = xi.select("t", "iq", "jn", "xi").join(F.broadcast(at), ["t", "iq", "jn"])
    return joined.groupBy("s_bin").agg(F.sum(F.col("xi") * F.col("l")).alias("a"), F.sum(F.col("l") * F.col("l")).alias("b")).select("s_bin", (ratio(F.col("a"), F.col("b"))).alias("xi"))


def xi_ls(dd: DataFrame, dr: DataFrame, rr: DataFrame) -> DataFrame:
    """Landy-Szalay of cap means (columns dd, dr, rr); null where rr is 0."""
    j = dd.join(dr, ["t", "iq", "jn"]).join(rr, ["t", "iq", "jn"])
    return j.select("t", "iq", "jn", ratio(F.col("dd") - 2 * F.col("dr") + F.col("rr"), F.col("rr")).alias("xi"))


def xi_cross(dd: DataFrame, dr: DataFrame, rd: DataFrame, rr: DataFrame) -> DataFrame:
    """Four-term Landy-Szalay of cap means (columns dd, dr, rd, rr); for power 1 the correlation of two catalogs."""
    j = dd.join(dr, ["t", "iq", "jn"]).join(rd, ["t", "iq", "jn"]).join(rr, ["t", "iq", "jn"])
    return j.select("t", "iq", "jn", ratio(F.col("dd") - F.col("dr") - F.col("rd") + F.col("rr"), F.col("rr")).alias("xi"))


def xi_hamilton(dd: DataFrame, dr: DataFrame, rd: DataFrame, rr: DataFrame) -> DataFrame:
    j = dd.join(dr, ["t", "iq", "jn"]).join(rd, ["t", "iq", "jn"]).join(rr, ["t", "iq", "jn"])
    return j.select("t", "iq", "jn", (ratio(F.col("dd") * F.col("rr"), F.col("dr") * F.col("rd")) - 1).alias("xi"))


def xi_dp(dd: DataFrame, rd: DataFrame) -> DataFrame:
    j = dd.join(rd, ["t", "iq", "jn"])
    return j.select("t", "iq", "jn", (ratio(F.col("dd"), F.col("rd")) - 1).alias("xi"))


def annular(means: DataFrame, name: str) -> DataFrame:
    """Cap means turned into those of the rings between caps; the first is the full cap."""
    order = Window.partitionBy("iq", "jn").orderBy("t")  # one row a cap
    return means.select("t", "iq", "jn", (F.col(name) - F.lag(name, 1, 0.0).over(order)).alias(name))


def differential(means: DataFrame, thetas: Sequence[float], name: str = "mean") -> DataFrame:
    """(t, iq, jn, slope): theta times the change of the mean count over the change of theta, from 0 on."""
    order = Window.partitionBy("iq", "jn").orderBy("t")
    theta = F.element_at(F.array(*[F.lit(float(t)) for t in thetas]), F.col("t") + 1)
    before = F.element_at(F.array(F.lit(0.0), *[F.lit(float(t)) for t in thetas]), F.col("t") + 1)
    return means.select("t", "iq", "jn", (theta * (F.col(name) - F.lag(name, 1, 0.0).over(order)) / (theta - before)).alias("slope"))


def first_moment(m: DataFrame, q_edges: Sequence[float], n_edges: Sequence[float]) -> DataFrame:
    """(t, iq, shift): mean redshift difference of neighbour and query, shells at their midpoints; null without neighbours."""
    mid = lambda edges, c: F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip(edges[:-1], edges[1:], strict=True)]), F.col(c) + 1)
    return m.groupBy("t", "iq").agg(ratio(F.sum(F.col("s1") * (mid(n_edges, "jn") - mid(q_edges, "iq"))), F.sum("s1")).alias("shift"))


def jackknife(by_region: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Leave-one-out sums: (t, iq, jn, region, sums..) with the region's own part taken from the total, for every region."""
    keys = ["t", "iq", "jn"]
    regions = by_region.select("region").distinct()
    total = by_region.groupBy(*keys).agg(*[F.sum(s).alias(f"all_{s}") for s in sums])
    every = total.crossJoin(F.broadcast(regions))  # regions are few by design
    j = every.join(by_region, [*keys, "region"], "left")
    return j.select(*keys, "region", *[(F.col(f"all_{s}") - F.coalesce(F.col(s), F.lit(0))).alias(s) for s in sums])


def jackknife_cov(samples: DataFrame, value: str = "value", hartlap: bool = False) -> DataFrame:
    """(a, b, cov, folds): (n - 1) / n times the sum of products of deviations over folds, from (bin, region, value).

    Null values are left out; fewer than two folds give null. ``hartlap`` scales the
    covariance to make its inverse unbiased, by (n - 1) / (n - bins - 2), null if that is not positive.
    """
    s = samples.where(F.col(value).isNotNull())
    mean = s.groupBy("bin").agg(F.avg(value).alias("mean"))
    d = s.join(mean, "bin").select("bin", "region", (F.col(value) - F.col("mean")).alias("d"))
    p = d.select(F.col("bin").alias("a"), "region", F.col("d").alias("da")).join(d.select(F.col("bin").alias("b"), "region", F.col("d").alias("db")), "region")
    out = p.groupBy("a", "b").agg(F.count("*").alias("folds"), F.sum(F.col("da") * F.col("db")).alias("s"))
    cov = F.when(F.col("folds") > 1, F.col("s") * (F.col("folds") - 1) / F.col("folds"))
    if hartlap:
        bins = s.agg(F.countDistinct("bin").alias("bins"))
        out = out.crossJoin(F.broadcast(bins))
        cov = F.when(F.col("folds") > F.col("bins") + 2, cov * (F.col("folds") - 1) / (F.col("folds") - F.col("bins") - 2))
    return out.select("a", "b", cov.alias("cov"), "folds")


def cone_counts(centres: DataFrame, points: DataFrame, thetas: Sequence[float], n_edges: Sequence[float], weight: str | None = None) -> DataFrame:
    """(id, t, jn, n): points in the caps around outside centres; centres without one have zeros."""
    c = centres.withColumn("red", F.lit(0.5))
    return cap_counts(c, points, thetas, [0.0, 1.0], n_edges, False, weight).drop("iq")


def sigma2_cone_shell(counts: DataFrame) -> DataFrame:
    """(t, jn, sigma2): sample variance over squared mean, less 1 / mean, across centres; null where the mean is 0."""
    s = counts.groupBy("t", "jn").agg(F.avg("n").alias("mean"), F.var_samp("n").alias("var"))
    return s.select("t", "jn", F.when(F.col("mean") > 0, F.col("var") / (F.col("mean") * F.col("mean")) - 1 / F.col("mean")).alias("sigma2"))


def cone_shell_jackknife(centres: DataFrame, points: DataFrame, thetas: Sequence[float], n_edges: Sequence[float], region: str = "region") -> DataFrame:
    """(t, jn, region, sigma2): sigma2_cone_shell() without the points and the centres of each region, and region null for all of them.

    Counts are made once, by centre and region of the points; what a fold lacks is taken off.
    A fold without two centres, or without a point in the caps, has null.
    """
    shells = range(len(n_edges) - 1)
    c = centres.select("id", *XYZ, F.col(region).alias("own"))
    kept = points.select("id", *XYZ, bin_of(F.col("red"), n_edges).alias("jn"), F.col(region).alias("of")).where("jn is not null")
    names = F.array(*[F.lit(r["of"]) for r in kept.select("of").where("of is not null").distinct().collect()])  # few by design
    number = F.coalesce(F.array_position(names, F.col("of")), F.lit(0)).cast("long")  # 0 without a region
    code = F.col("jn") * (F.size(names) + 1) + number
    near = near_counts(c, kept.withColumn("code", code), [chord(t) ** 2 for t in thetas], XYZ, "code", closed=True)
    caps = F.inline(F.array(*[F.struct(F.lit(t).alias("t"), sum((F.col(f"n{s}") for s in range(1, t + 1)), F.col("n0")).alias("m")) for t in range(len(thetas))]))
    spot = F.pmod("label", F.size(names) + 1).cast("int")
    of = F.get(names, spot - 1) if kept.schema["of"].dataType.typeName() != "void" else F.lit(None)
    part = near.select("id", F.floor(F.col("label") / (F.size(names) + 1)).cast("int").alias("jn"), of.alias("of"), caps).where("m > 0")
    whole = part.groupBy("id", "t", "jn").agg(F.sum("m").alias("n"))
    grid = F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(j).alias("jn")) for t in range(len(thetas)) for j in shells]))
    every = c.select("id", "own", grid).join(whole, ["id", "t", "jn"], "left").select("id", "own", "t", "jn", F.coalesce("n", F.lit(0)).alias("n"))
    regions = F.broadcast(c.select(F.col("own").alias("region")).union(kept.select("of")).where("region is not null").distinct())  # few by design
    # sums over all centres, less those of a fold's own centres, less what its points add to the others
    power = lambda x, k: F.sum(F.pow(x.cast("double"), k))
    total = every.groupBy("t", "jn").agg(F.count("*").alias("k0"), *[power(F.col("n"), k).alias(f"k{k}") for k in (1, 2)])
    mine = every.groupBy("t", "jn", F.col("own").alias("region")).agg(F.count("*").alias("o0"), *[power(F.col("n"), k).alias(f"o{k}") for k in (1, 2)])
    touched = part.join(every, ["id", "t", "jn"]).where(~F.col("own").eqNullSafe(F.col("of"))).groupBy("t", "jn", F.col("of").alias("region")).agg(
        F.sum("m").cast("double").alias("d1"), F.sum((2 * F.col("n") - F.col("m")) * F.col("m")).cast("double").alias("d2"))
    folds = total.crossJoin(regions).join(mine, ["t", "jn", "region"], "left").join(touched, ["t", "jn", "region"], "left").na.fill(0, ["o0", "o1", "o2", "d1", "d2"])
    left = folds.select("t", "jn", "region", (F.col("k0") - F.col("o0")).alias("k0"), (F.col("k1") - F.col("o1") - F.col("d1")).alias("k1"), (F.col("k2") - F.col("o2") - F.col("d2")).alias("k2"))
    rows = left.unionByName(total.select("t", "jn", F.lit(None).cast(regions.schema["region"].dataType).alias("region"), "k0", "k1", "k2"))
    mean = F.col("k1") / F.col("k0")
    var = (F.col("k2") - F.col("k0") * mean * mean) / (F.col("k0") - 1)
    return rows.select("t", "jn", "region", F.when((F.col("k0") > 1) & (F.col("k1") > 0), var / (mean * mean) - 1 / mean).alias("sigma2"))


def slope_between(sigma2: DataFrame, centres: Sequence[float], log: bool = True) -> DataFrame:
    """(t, jn, slope): change of sigma2 between the two neighbouring shells over that of ln(1 + z), or of z; inner shells only."""
    x = F.element_at(F.array(*[F.lit(math.log1p(c) if log else float(c)) for c in centres]), F.col("jn") + 1)
    order = Window.partitionBy("t").orderBy("jn")  # one row a shell
    rows = sigma2.select("t", "jn", x.alias("x"), "sigma2")
    at = rows.select("t", "jn", ((F.lead("sigma2").over(order) - F.lag("sigma2").over(order)) / (F.lead("x").over(order) - F.lag("x").over(order))).alias("slope"))
    return at.where((F.col("jn") > 0) & (F.col("jn") < len(centres) - 1))


def pip_counts(points: DataFrame, thetas: Sequence[float], q_edges: Sequence[float], n_edges: Sequence[float], realisations: int) -> DataFrame:
    """(t, iq, jn, s1, s2): as knn_moments, each pair weighted by realisations / common bits of the two ``bits`` arrays; pairs with none are dropped."""
    q = points.select("id", *XYZ, "bits", bin_of(F.col("red"), q_edges).alias("iq"), bin_of(F.col("red"), n_edges).alias("jn"))
    chords2, shells = [chord(t) ** 2 for t in thetas], len(n_edges) - 1

    def work(mine, theirs):
        one, other = (np.stack(list(side["bits"])) if len(side["bits"]) else np.zeros((0, 1), np.int64) for side in (mine, theirs))
        sums = np.zeros((len(one), shells, len(thetas)))
        spread = np.zeros((len(other), shells))
        spread[np.arange(len(other)), theirs["jn"]] = 1.0

        def add(block, chunk, at, gaps, d2):
            common = sum(np.bitwise_count(x[:, None] & y[None]) for x, y in zip(one[block].T, other[chunk].T, strict=True))
            paired = np.divide(float(realisations), common, out=np.zeros(d2.shape), where=(common > 0) & (d2 < np.inf))
            for t, top in enumerate(chords2):
                sums[block, :, t] += np.where(d2 <= top, paired, 0.0) @ spread[chunk]

        def done():
            i, j = np.nonzero(sums.any(2))
            return {"id": mine["id"][i], "iq": mine["iq"][i], "jn": j.astype(np.int32), **{f"n{t}": sums[i, j, t] for t in range(len(thetas))}}

        return add, done

    columns = [f"n{t}" for t in range(len(thetas))]
    met = pair_sums(q.where("iq is not null"), q.where("jn is not null"), chord(thetas[-1]), work, f"id {dict(points.dtypes)['id']}, iq int, jn int, " + ", ".join(f"{c} double" for c in columns), XYZ, ("bits", "iq"), ("bits", "jn"), closed=True, same=True)
    cap = met.groupBy("id", "iq", "jn").agg(*[F.sum(c).alias(c) for c in columns])
    rows = F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{t}").alias("n")) for t in range(len(thetas))]))
    return cap.select("id", "iq", "jn", rows).groupBy("t", "iq", "jn").agg(F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"))


def log_slope(sigma2: DataFrame, centres: Sequence[float]) -> DataFrame:
    """(t, jn, slope): d ln sigma2 / d ln(1 + z) over shells by centred differences, one-sided at the ends; null where sigma2 <= 0."""
    x = F.element_at(F.array(*[F.ln(F.lit(1.0 + c)) for c in centres]), F.col("jn") + 1)
    order = Window.partitionBy("t").orderBy("jn")
    rows = sigma2.select("t", "jn", x.alias("x"), F.when(F.col("sigma2") > 0, F.ln("sigma2")).alias("y"))
    up, down = F.lead("y").over(order), F.lag("y").over(order)
    xu, xd = F.lead("x").over(order), F.lag("x").over(order)
    return rows.select("t", "jn", F.when(xd.isNull(), (up - F.col("y")) / (xu - F.col("x"))).when(xu.isNull(), (F.col("y") - down) / (F.col("x") - xd)).otherwise((up - down) / (xu - xd)).alias("slope"))
