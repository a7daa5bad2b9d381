"""Gaussian random fields on catalogs: neighbour conditioning, likelihood, kernel fits, maxima of the posterior.

The field at a point is conditioned on its k nearest points of higher generations. A point's
generation is drawn from its id, each half as many as the one before; the few points of the
highest generations are conditioned on each other in full. The factors are rows of a table:
one of a point and its neighbours, and one of all the full points (``FULL`` at most).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.neighbours import cut, k_nearest_lists, table
from pointloom.operators.rangejoin import AXES

#: Most points of the highest generations that are conditioned on each other in full.
FULL = 128
#: Added to the variance at no distance, as a share of it.
JITTER = 1e-4
#: Distance of different points at one place.
TOUCHING = 1e-300
#: Mean number of points of a block of the inner solve; no block has more than twice as many.
BLOCK = 1024
#: Rows of factors worked on at once in a task.
ROWS = 512

#: r, parameters -> covariance, its first and its second derivatives by the parameters.
Kernel = Callable[[np.ndarray, Sequence[float]], tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]]


def rbf(r: np.ndarray, theta: Sequence[float]) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
    """exp(theta_0) exp(-r^2 / 2 s^2) with s = exp(theta_1), and the jitter where r = 0."""
    v, u = math.exp(theta[0]), (r / math.exp(theta[1])) ** 2
    smooth = v * np.exp(-u / 2)
    c = smooth + JITTER * v * (r == 0)
    by_scale = smooth * u
    return c, [c, by_scale], [[c, by_scale], [by_scale, smooth * (u * u - 2 * u)]]


def exponential(r: np.ndarray, theta: Sequence[float]) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
    """exp(theta_0) exp(-r / s) with s = exp(theta_1), and the jitter where r = 0."""
    v, u = math.exp(theta[0]), r / math.exp(theta[1])
    smooth = v * np.exp(-u)
    c = smooth + JITTER * v * (r == 0)
    by_scale = smooth * u
    return c, [c, by_scale], [[c, by_scale], [by_scale, smooth * (u * u - u)]]


def conditioning(points: DataFrame, k: int, axes: Sequence[str] = AXES, box: float | None = None, value: str = "value", seed: int = 17) -> DataFrame:
    """Factors of a catalog, a table: id, at, value and near, the structs (id, at, value) of what the point is conditioned on.

    The row of the full points has a null id; its ``near`` holds all of them. Points without
    coordinates have no row; ids are unique. An empty catalog gives no row. Any subset of
    points that come before is a valid choice, so the factors are those of one Gaussian
    whatever the neighbours; with FULL points or fewer it is the exact one.
    """
    h = F.xxhash64(F.lit(seed), F.col("id"))
    generation = F.least(F.expr("bit_count((_h & -_h) - 1)"), F.lit(62)).cast("int")
    finite = [F.col(x).isNotNull() & (F.abs(F.col(x).cast("double")) < float("inf")) for x in axes]
    kept = points
    for f in finite:
        kept = kept.where(f)
    x = [F.col(a).cast("double").alias(a) for a in axes]
    dealt = cut(kept.select("id", *x, F.col(value).cast("double").alias("value"), h.alias("_h")).select("id", *axes, "value", generation.alias("_class")))
    sizes = sorted((r["_class"], r["n"]) for r in dealt.groupBy("_class").agg(F.count("*").alias("n")).collect())  # 63 at most
    first, held = 63, 0
    for g, n in reversed(sizes):
        if held + n > FULL:
            break
        first, held = g, held + n
    if first == 63 and sizes:
        first = sizes[-1][0] + 1  # more than FULL points in the last generation: it is conditioned on nothing
    full = F.col("_class") >= first
    classes = F.explode(F.when(F.col("_class") > 0, F.sequence(F.lit(0), F.least(F.col("_class"), F.lit(first)) - 1)).otherwise(F.array().cast("array<int>")))
    before = dealt.select("id", *axes, "value", classes.alias("_of")).withColumnRenamed("_of", "_class")
    found = k_nearest_lists(dealt.where(~full), before, k, axes, ("id", "value"), box=box, by=["_class"])
    spot = lambda p: F.array(*[F.col(f"{p}{a}") for a in axes]).alias("at")
    near = found.select(F.col("a_id").alias("_id"), F.transform("near", lambda s: F.struct(s["b_id"].alias("id"), F.array(*[s[f"b_{a}"] for a in axes]).alias("at"), s["b_value"].alias("value"))).alias("near"))
    none = F.array().cast("array<struct<id:bigint,at:array<double>,value:double>>")
    rest = dealt.where(~full).join(near, F.col("id") == F.col("_id"), "left").select("id", spot(""), "value", F.coalesce("near", none).alias("near"))
    top = dealt.where(full).select(F.struct("id", spot(""), "value").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("near")).where(F.size("near") > 0)  # FULL points at most
    whole = top.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("at"), F.lit(None).cast("double").alias("value"), "near")
    return cut(rest.select(F.col("id").cast("long").alias("id"), "at", "value", "near").unionByName(whole))


class _Batch:
    """Factors of as many neighbours each: ids (n, m), places (n, m, d) and values (n, m), the point itself first; of the full points there is no self."""

    def __init__(self, ids, at, values, full):
        self.ids, self.at, self.values, self.full = ids, at, values, full


def _gaps(a: np.ndarray, b: np.ndarray, box: float | None) -> np.ndarray:
    g = a - b
    return g if box is None else g - box * np.round(g / box)


def _distances(at: np.ndarray, box: float | None) -> np.ndarray:
    """0 on the diagonal alone: two points at one place are told from a point and itself, or their matrix would be singular."""
    g = _gaps(at[:, :, None], at[:, None], box)
    r = np.sqrt((g * g).sum(-1))
    r[(r == 0) & ~np.eye(r.shape[-1], dtype=bool)] = TOUCHING
    return r


def _batches(rows: Iterator[pa.RecordBatch], d: int) -> Iterator[_Batch]:
    for batch in rows:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lists = part.column("near")
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
            ids, values = flat.field("id").to_numpy(), flat.field("value").to_numpy(zero_copy_only=False)
            at = flat.field("at").flatten().to_numpy().reshape(-1, d)
            ends = np.cumsum(sizes)
            own = part.column("id").is_valid().to_numpy(zero_copy_only=False)
            for m in np.unique(sizes[own]) if own.any() else []:
                of = np.flatnonzero(own & (sizes == m))
                take = (ends[of] - m)[:, None] + np.arange(m)
                some = part.take(pa.array(of))
                mine = some.column("at").flatten().to_numpy().reshape(-1, 1, d)
                yield _Batch(np.concatenate([some.column("id").to_numpy()[:, None], ids[take]], 1), np.concatenate([mine, at[take]], 1), np.concatenate([some.column("value").to_numpy(zero_copy_only=False)[:, None], values[take]], 1), False)
            for i in np.flatnonzero(~own):
                cutout = slice(ends[i] - sizes[i], ends[i])
                yield _Batch(ids[cutout][None], at[cutout][None], values[cutout][None], True)


def _likelihood(y: np.ndarray, c, c1, c2, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian of -log N(y; 0, C) without its constant, summed over a stack of matrices."""
    inverse = np.linalg.inv(c)
    a = (inverse @ y[..., None])[..., 0]
    value = 0.5 * (y * a).sum() + 0.5 * np.linalg.slogdet(c)[1].sum()
    by = [inverse @ d for d in c1]
    ya = [(d @ a[..., None])[..., 0] for d in c1]
    gradient = np.array([0.5 * np.trace(by[i], axis1=-2, axis2=-1).sum() - 0.5 * (a * ya[i]).sum() for i in range(p)])
    hessian = np.zeros((p, p))
    for i in range(p):
        for j in range(p):
            second = (a * (c2[i][j] @ a[..., None])[..., 0]).sum()
            hessian[i, j] = 0.5 * (inverse * np.swapaxes(c2[i][j], -1, -2)).sum() - 0.5 * (by[i] * np.swapaxes(by[j], -1, -2)).sum() - 0.5 * second + (ya[i] * (inverse @ ya[j][..., None])[..., 0]).sum()
    return value, gradient, hessian


def likelihood(factors: DataFrame, kernel: Kernel, theta: Sequence[float], box: float | None = None) -> DataFrame:
    """One row (loss, gradient, hessian, n): minus the log likelihood of the values, without its constant, with derivatives by ``theta``.

    A conditional is the joint of a point and its neighbours less that of the neighbours alone,
    so all comes from one pass of small matrices, summed on the executors. Null values count as 0.
    """
    p, theta = len(theta), list(map(float, theta))
    d = len(factors.where("size(near) > 0").select(F.element_at("near", 1)["at"].alias("at")).head(1)[0]["at"]) if not factors.isEmpty() else 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(rows, d):
            y = np.nan_to_num(b.values)
            c, c1, c2 = kernel(_distances(b.at, box), theta)
            total = np.concatenate([np.ravel(x) for x in _likelihood(y, c, c1, c2, p)])
            if not b.full and b.ids.shape[1] > 1:
                inner = lambda m: m[:, 1:, 1:]
                total -= np.concatenate([np.ravel(x) for x in _likelihood(y[:, 1:], inner(c), [inner(x) for x in c1], [[inner(x) for x in row] for row in c2], p)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), b.ids.shape[0] if not b.full else b.ids.shape[1]))], ["k", "v", "n"])

    sums = factors.mapInArrow(run, "k int, v double, n long").groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))  # 1 + p + p^2 rows
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"])
    return sums.agg(in_order.alias("all"), F.max("n").alias("n")).select(F.get("all", F.lit(0)).alias("loss"), F.slice("all", 2, p).alias("gradient"), F.slice("all", 2 + p, p * p).alias("hessian"), "n")


def fit_kernel(factors: DataFrame, kernel: Kernel, theta: Sequence[float], box: float | None = None, steps: int = 30, tolerance: float = 1e-8) -> tuple[list[float], np.ndarray, list[float]]:
    """(theta, Fisher matrix, losses): the parameters that make the values likeliest, by Newton steps.

    Each step is one pass over the factors. Where the Hessian is not positive its eigenvalues
    are taken by their size, a step is one at most in length, and halved as long as the loss
    does not fall. The Fisher matrix is the Hessian at the end; standard errors are the roots
    of its inverse's diagonal.
    """
    look = lambda t: likelihood(factors, kernel, t, box).first()
    at = look(theta)
    theta, losses = np.array(theta, float), [at.loss]
    p = len(theta)
    for _ in range(steps):
        g, h = np.array(at.gradient), np.array(at.hessian).reshape(p, p)
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        step = -vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-12))
        step *= min(1.0, 1.0 / max(np.linalg.norm(step), 1e-300))
        if abs(g @ step) <= tolerance * max(1.0, abs(losses[-1])):
            break
        for half in range(12):
            new = look(theta + step / 2**half)
            if new.loss < losses[-1]:
                break
        else:
            break
        theta, at = theta + step / 2**half, new
        losses.append(at.loss)
    return theta.tolist(), np.array(at.hessian).reshape(p, p), losses


def derivatives(factors: DataFrame, theta: Sequence[float], axes: Sequence[str] = AXES, box: float | None = None) -> DataFrame:
    """(id, mean, gradient, hessian, ...): the rbf() field's conditional mean at each point given what it is conditioned on, and its derivatives; see shapes().

    Full points are given all full points, themselves included. A point that is conditioned on
    nothing has mean and derivatives 0.
    """
    d, theta = len(axes), list(map(float, theta))
    s2 = math.exp(theta[1]) ** 2

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(rows, d):
            if b.full:
                n = b.ids.shape[1]
                ids, here, there, values = b.ids[0], b.at[0], np.broadcast_to(b.at, (n, n, d)), np.broadcast_to(b.values, (n, n))
            else:
                ids, here, there, values = b.ids[:, 0], b.at[:, 0], b.at[:, 1:], b.values[:, 1:]
            m = there.shape[1]
            if m:
                weights = np.linalg.solve(rbf(_distances(there, box), theta)[0], np.nan_to_num(values)[..., None])[..., 0]
                gap = _gaps(here[:, None], there, box)
                r = np.sqrt((gap * gap).sum(-1))
                r[(r == 0) & ~(np.eye(m, dtype=bool) if b.full else False)] = TOUCHING
                c = rbf(r, theta)[0]
                smooth = math.exp(theta[0]) * np.exp(-(gap * gap).sum(-1) / (2 * s2))
                mean = (c * weights).sum(-1)
                gradient = -(gap * (smooth * weights)[..., None]).sum(1) / s2
                hessian = np.einsum("nmi,nmj,nm->nij", gap, gap, smooth * weights) / s2**2 - np.eye(d) * ((smooth * weights).sum(-1) / s2)[:, None, None]
            else:
                mean, gradient, hessian = np.zeros(len(ids)), np.zeros((len(ids), d)), np.zeros((len(ids), d, d))
            yield shapes(ids, gradient, hessian, mean)

    return factors.mapInArrow(run, f"id long, mean double, {SHAPES}")


SHAPES = "gradient array<double>, hessian array<double>, eigenvalues array<double>, laplacian double, shear2 double, web string"
_WEB = np.array(["void", "sheet", "filament", "peak"])


def shapes(ids: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, mean: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows with gradient, Hessian by rows, its eigenvalues from the largest on, trace, squared traceless part, and the class by how many eigenvalues are negative."""
    n, d = gradient.shape
    eigenvalues = np.linalg.eigvalsh(hessian)[:, ::-1] if n else np.zeros((0, d))
    trace = np.trace(hessian, axis1=1, axis2=2)
    free = hessian - trace[:, None, None] / d * np.eye(d)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    web = _WEB[np.minimum((eigenvalues < 0).sum(1), 3)]
    columns = {"gradient": lists(gradient), "hessian": lists(hessian.reshape(n, d * d)), "eigenvalues": lists(np.ascontiguousarray(eigenvalues)), "laplacian": pa.array(trace), "shear2": pa.array((free * free).sum((1, 2))), "web": pa.array(web.tolist(), pa.string())}
    return pa.RecordBatch.from_pydict({"id": pa.array(ids)} | ({} if mean is None else {"mean": pa.array(mean)}) | columns)


def quadratic_fits(points: DataFrame, k: int = 20, axes: Sequence[str] = AXES, box: float | None = None, value: str = "value") -> DataFrame:
    """(id, gradient, hessian, eigenvalues, laplacian, shear2, web) of the quadratic that fits ``value`` around each point best; see shapes().

    The fit goes through the point and weighs its ``k`` nearest others by the inverse of the
    distance; with too few of them it is the smallest solution. A point without another has
    derivatives 0. Points without coordinates or value have no row and are no neighbours.
    """
    d = len(axes)
    finite = points.where(F.col(value).isNotNull()).select("id", *[F.col(a).cast("double").alias(a) for a in axes], F.col(value).cast("double").alias("value"))
    found = k_nearest_lists(finite, finite, k, axes, ("id", "value"), same=True, box=box)

    def gaps(p):
        g = [p[f"b_{a}"] - F.col(f"a_{a}") for a in axes]
        return g if box is None else [x - F.lit(box) * F.round(x / F.lit(box)) for x in g]

    near = found.select(F.col("a_id").alias("_id"), F.flatten(F.transform("near", lambda p: F.array(*gaps(p), p["b_value"] - F.col("a_value")))).alias("rows"))
    usable = finite
    for a in axes:
        usable = usable.where(F.abs(F.col(a)) < float("inf"))
    asked = usable.select(F.col("id").cast("long").alias("id")).join(near, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("rows", F.array().cast("array<double>")).alias("rows"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                sizes = part.column(1).value_lengths().to_numpy() // (d + 1)
                for m in np.unique(sizes):
                    some = part.take(pa.array(np.flatnonzero(sizes == m)))
                    rows = some.column(1).flatten().to_numpy().reshape(some.num_rows, m, d + 1)
                    dx, df = rows[..., :d], rows[..., d]
                    a = np.concatenate([dx, np.stack([dx[..., i] * dx[..., j] * (0.5 if i == j else 1.0) for i, j in pairs], -1)], -1)
                    w = 1 / (np.sqrt((dx * dx).sum(-1)) + 1e-10)
                    solved = (np.linalg.pinv(a * w[..., None], rcond=np.finfo(float).eps * max(m, a.shape[-1])) @ (df * w)[..., None])[..., 0] if m else np.zeros((some.num_rows, a.shape[-1]))
                    hessian = np.zeros((some.num_rows, d, d))
                    for (i, j), c in zip(pairs, solved[:, d:].T, strict=True):
                        hessian[:, i, j] = hessian[:, j, i] = c
                    yield shapes(some.column(0).to_numpy(), solved[:, :d], hessian)

    return asked.mapInArrow(run, f"id long, {SHAPES}")


# -- the posterior ----------------------------------------------------------------------


def precision(factors: DataFrame, kernel: Kernel, theta: Sequence[float], d: int = 3, box: float | None = None) -> DataFrame:
    """(i, j, q): the entries of the field's inverse covariance, a table."""
    theta = list(map(float, theta))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(rows, d):
            c = kernel(_distances(b.at, box), theta)[0]
            n, m = b.ids.shape
            if b.full:
                q = np.linalg.inv(c)
            else:
                one = np.ones((n, 1))
                if m > 1:
                    weights = np.linalg.solve(c[:, 1:, 1:], c[:, 1:, :1])[..., 0]
                    left, e = c[:, 0, 0] - (weights * c[:, 1:, 0]).sum(-1), np.concatenate([one, -weights], 1)
                else:
                    left, e = c[:, 0, 0], one
                q = e[:, :, None] * e[:, None] / left[:, None, None]
            i = np.broadcast_to(b.ids[:, :, None], q.shape).ravel()
            j = np.broadcast_to(b.ids[:, None], q.shape).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(q.ravel())], ["i", "j", "q"])

    return cut(factors.mapInArrow(run, "i long, j long, q double").groupBy("i", "j").agg(F.sum("q").alias("q")))


def _blocks(points: DataFrame, entries: DataFrame, axes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(blocks, members): the rows of the matrix for the points of a cell, and these points, ``own``, with all that the rows link them to.

    A cell with more than twice BLOCK points is dealt into parts by id.
    """
    ends = points.agg(*[F.min(a).alias(a) for a in axes], *[F.max(a).alias(f"_{a}") for a in axes], F.count("*").alias("n")).first()
    side = 1 << max(0, math.ceil(math.log2(max(1, ends.n) / BLOCK) / len(axes)))
    width = [max(ends[f"_{a}"] - ends[a], 1e-300) * 1.0000001 / side for a in axes]
    cell = F.concat_ws(":", *[F.floor((F.col(a) - F.lit(ends[a])) / F.lit(w)).cast("long") for a, w in zip(axes, width, strict=True)])
    placed = points.select("id", cell.alias("cell"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("parts"))
    home = cut(placed.join(parts, "cell").select("id", F.concat_ws("/", "cell", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")))
    rows = table(entries.join(home.withColumnRenamed("id", "i"), "i").groupBy("block").agg(F.collect_list(F.struct("i", "j", "q")).alias("entries")))  # of one block
    ring = rows.select("block", F.explode(F.array_distinct("entries.j")).alias("id"), F.lit(False).alias("own"))
    members = ring.unionByName(home.select("block", "id", F.lit(True).alias("own"))).groupBy("block", "id").agg(F.max("own").alias("own"))
    return rows, table(members)


def _in_blocks(blocks: DataFrame, members: DataFrame, state: DataFrame, column: str, times: bool) -> DataFrame:
    """(id, q, y): the matrix, with W added to its diagonal, times a column, or with ``times`` false the column itself; and the solution of that by the square pieces of the blocks' own points."""
    sent = members.join(state.select("id", F.col(column).alias("v"), "w"), "id").groupBy("block").agg(F.collect_list(F.struct("id", "own", "v", "w")).alias("held"))  # of one block

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                held, entries = batch.column("held").slice(k, 1).flatten(), batch.column("entries").slice(k, 1).flatten()
                order = np.argsort(held.field("id").to_numpy())
                ids, own = held.field("id").to_numpy()[order], held.field("own").to_numpy(zero_copy_only=False)[order]
                v, w = held.field("v").to_numpy()[order], held.field("w").to_numpy()[order][own]
                i, j, q = np.searchsorted(ids, entries.field("i").to_numpy()), np.searchsorted(ids, entries.field("j").to_numpy()), entries.field("q").to_numpy()
                out = np.bincount(i, q * v[j], len(ids))[own] + w * v[own] if times else v[own]
                at, inside = np.cumsum(own) - 1, own[j]
                dense = np.zeros((len(w), len(w)))
                dense[at[i[inside]], at[j[inside]]] = q[inside]
                dense[np.arange(len(w)), np.arange(len(w))] += w
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(out), pa.array(np.linalg.solve(dense, out))], ["id", "q", "y"])

    return blocks.join(sent, "block").mapInArrow(run, "id long, q double, y double")


def map_field(points: DataFrame, factors: DataFrame, kernel: Kernel, theta: Sequence[float], mean: float, form: str = "density", axes: Sequence[str] = AXES, box: float | None = None, steps: int = 20, inner: int = 40, tolerance: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """((id, field, delta), losses): the field that the posterior of a Poisson process has its maximum at.

    ``points`` has id, the axes and ``counted``: true for the points of the process, false for
    those spread over the volume by which its integral is taken (one in all); without any the integral is
    a constant. ``mean`` is the number expected in the volume. ``form`` 'density' has 1 + field
    as the density over the mean, 'log' its logarithm. ``factors`` are conditioning() of the
    same points. Newton steps, halved until the loss falls; the steps solve (Q + W) s = -g
    by conjugate gradients, preconditioned by the solutions of blocks side by side, with all
    vectors in a table. Losses leave out what does not depend on the field.
    """
    if form not in ("density", "log"):
        raise ValueError("form is density or log")
    d = len(axes)
    finite = points
    for a in axes:
        finite = finite.where(F.col(a).isNotNull() & (F.abs(F.col(a).cast("double")) < float("inf")))
    finite = finite.select(F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes], "counted")
    entries = precision(factors, kernel, theta, d, box)
    blocks, members = _blocks(finite, entries, axes)
    spread = finite.where(~F.col("counted")).count()
    share = mean / spread if spread else 0.0
    counted, x = F.col("counted"), F.col("x")

    def cost(v):
        if form == "log":
            return F.when(counted, -v).otherwise(F.lit(share) * F.exp(v))
        return F.when(counted, -F.log(F.greatest(1 + v, F.lit(1e-10)))).otherwise(F.lit(share) * F.greatest(1 + v, F.lit(0.0)))

    if form == "log":
        slope, bend = F.when(counted, -1.0).otherwise(F.lit(share) * F.exp(x)), F.when(counted, 0.0).otherwise(F.lit(share) * F.exp(x))
    else:
        open_ = 1 + x > 1e-10
        slope = F.when(counted, F.when(open_, -1 / (1 + x)).otherwise(0.0)).otherwise(F.when(1 + x > 0, share).otherwise(0.0))
        bend = F.when(counted & open_, 1 / ((1 + x) * (1 + x))).otherwise(0.0)
    state = table(finite.select("id", "counted", F.lit(0.0).alias("x"), F.lit(0.0).alias("qx")))
    losses = [state.agg(F.sum(cost(x))).first()[0] or 0.0]
    if state.isEmpty():
        return state.select("id", x.alias("field"), x.alias("delta")), losses
    halves = [0.5**t for t in range(12)]
    for k in range(steps):
        now = state.select("*", bend.alias("w"), (-slope - F.col("qx")).alias("r"), F.lit(0.0).alias("s"))
        now = table(_descend(now, blocks, members, inner, max(1e-3, 0.1 ** (k + 1))))
        qs = -slope - F.col("qx") - F.col("r") - F.col("w") * F.col("s")  # what the steps have left of -g tells Q s
        moved = now.select("id", "counted", "x", "qx", "s", qs.alias("qs"))
        tried = moved.agg(*[F.sum((x + h * F.col("s")) * (F.col("qx") + h * F.col("qs")) / 2 + cost(x + h * F.col("s"))).alias(f"h{t}") for t, h in enumerate(halves)]).first()
        best = next((t for t in range(len(halves)) if tried[t] is not None and tried[t] < losses[-1]), None)
        if best is None:
            break
        h, gain = halves[best], losses[-1] - tried[best]
        state = table(moved.select("id", "counted", (x + h * F.col("s")).alias("x"), (F.col("qx") + h * F.col("qs")).alias("qx")))
        losses.append(tried[best])
        if gain <= tolerance * max(1.0, abs(losses[-1])):
            break
    delta = F.exp(x) - 1 if form == "log" else x
    return state.select("id", x.alias("field"), delta.alias("delta")), losses


def _descend(now: DataFrame, blocks: DataFrame, members: DataFrame, inner: int, share: float) -> DataFrame:
    """Conjugate gradients for (Q + W) s = r from s = 0, until what is left has ``share`` of its first size: the state with s, and what is left in r.

    A round is one job and each block is met once in it: the matrix times p and the block's solution of that, then one row of sums.
    """
    met = lambda state, column, times: state.join(_in_blocks(blocks, members, state, column, times), "id", "left").na.fill(0.0, ["q", "y"])
    now = table(met(now, "r", False).drop("q").withColumnRenamed("y", "z").withColumn("p", F.col("z")))
    first = None
    for _ in range(inner):
        both = table(met(now, "p", True))
        dot = lambda a, b: F.sum(F.col(a) * F.col(b))
        rz, pq, ry, zq, qy = both.agg(dot("r", "z"), dot("p", "q"), dot("r", "y"), dot("z", "q"), dot("q", "y")).first()
        first = first or rz
        if not (pq and pq > 0 and rz > 0):
            return both.select("id", "counted", "x", "qx", "w", "s", "r")
        step = rz / pq
        left = max(0.0, rz - step * (ry + zq) + step * step * qy)
        moved = both.select("id", "counted", "x", "qx", "w", "p", *[(F.col(c) + F.lit(t) * F.col(d)).alias(c) for c, t, d in (("s", step, "p"), ("r", -step, "q"), ("z", -step, "y"))])
        if left <= share * share * first:
            return moved.select("id", "counted", "x", "qx", "w", "s", "r")
        now = moved.withColumn("p", F.col("z") + F.lit(left / rz) * F.col("p"))
    return now.select("id", "counted", "x", "qx", "w", "s", "r")


def clustering_by_label(points: DataFrame, label: str, k: int, kernel: Kernel, theta: Sequence[float], axes: Sequence[str] = AXES, box: float | None = None, steps: int = 20) -> DataFrame:
    """(half, n, theta, errors): kernels fitted to the fields of the points with at least the median label and of those below.

    Points without a label are in neither half; an empty half has no row. Two rows, made of the fits' parameters.
    """
    middle = points.agg(F.percentile_approx(label, 0.5, 100_000)).first()[0]
    rows = []
    for half, part in (("high", points.where(F.col(label) >= F.lit(middle))), ("low", points.where(F.col(label) < F.lit(middle)))):
        mine = cut(part.select("id", *axes, F.lit(True).alias("counted"), F.lit(0.0).alias("value")))
        n = mine.count()
        if not n:
            continue
        field, _ = map_field(mine, conditioning(mine, k, axes, box), kernel, theta, float(n), "density", axes, box, steps)
        valued = conditioning(mine.drop("value").join(field.select("id", F.col("field").alias("value")), "id"), k, axes, box)
        found, fisher, _ = fit_kernel(valued, kernel, theta, box, steps)
        with np.errstate(invalid="ignore"):
            errors = np.sqrt(np.abs(np.diag(np.linalg.pinv(fisher))))
        rows.append((half, n, found, errors.tolist()))
    return points.sparkSession.createDataFrame(rows, "half string, n long, theta array<double>, errors array<double>")
