"""Sums over all pairs of points within a radius, without a row for a pair.

Space is cut into tiles, at least as wide as the radius and wider where points are thin. A
tile's points of one catalog meet those of the other in and around it in one group, whose
points are halved along their longest axis down to small blocks. What is out of a block's
reach is dropped on the way, and for counts what lies in one distance class for all of a
block is added at once; only the rest is paired, as small matrices. Tiles with many points
are dealt over parts, so a group is bounded. Neither catalog is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.rangejoin import AXES, DENSE

#: Mean number of asking points of a tile that is aimed at.
MEAN = 2048
#: Most asking points and most others of a group, on average over a tile's parts.
MINE, THEIRS = 8_192, 262_144
#: Points of a block.
BLOCK = 64
#: Others paired with a block at once: for counts, which write into the same memory each time, and for other sums,
#: whose arrays stay small enough (98 kB) not to be mapped afresh each time.
COUNTED, SUMMED = 512, 192
#: The same for pairs of places, whose arrays are to stay in a core's cache.
PAIRED = 256

#: Mean number of asking points of a tile where triangles are counted, points of a piece of their neighbours, and the
#: largest whole coordinate whose squared distances a matrix product gives exactly.
CORNERS, PIECE, WHOLE = 256, 512, 2.0**22

#: The group's columns -> (add(block, chunk, at, gaps, d2), done()), see pair_sums().
Work = Callable[[dict, dict], tuple[Callable, Callable]]


def _finite(df: DataFrame, axes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    x = [F.col(a).cast("double") for a in axes]
    inside = reduce(lambda p, q: p & q, [c.isNotNull() & (F.abs(c) < float("inf")) for c in x])
    return df.where(inside).select(*[F.col(k).alias(k) for k in keep], *[c.alias(f"_x{i}") for i, c in enumerate(x)])


def _side(a: DataFrame, radius: float, d: int, mean: int) -> float:
    """The widest tile, the radius times a power of two, that holds ``mean`` points or fewer on average."""
    at = lambda k: F.xxhash64(*[F.floor(F.col(f"_x{i}") / F.lit(radius * 2.0**k)) for i in range(d)])
    n, *tiles = a.agg(F.count("*"), *[F.approx_count_distinct(at(k), 0.1) for k in range(20)]).first()
    return radius * 2.0 ** max([k for k, t in enumerate(tiles) if n <= mean * t], default=0)


def _groups(a: DataFrame, b: DataFrame, radius: float, d: int, once: bool = False, mean: int = MEAN, two: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both catalogs with the tile and the part that they meet in; ``b`` also in the tiles within the radius.

    With ``once`` only in those before its own, and ``_own`` tells whether it is its own. With ``two``
    any two parts of ``b`` meet in one group, ``_pb`` and ``_pc``, and ``_part`` tells a point's own.
    """
    side, reach = _side(a, radius, d, mean), radius * (1 + 1e-9)
    tile = [f"_t{i}" for i in range(d)]
    spark = a.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = lambda df: df.select("*", *[F.floor(F.col(f"_x{i}") / F.lit(side)).alias(t) for i, t in enumerate(tile)])
    left = own(a.repartition(tasks))
    right = b.repartition(tasks)  # a small file is one task, and would be spread over the tiles by that alone
    for i, t in enumerate(tile):
        low, high = (F.floor((F.col(f"_x{i}") + F.lit(s * reach)) / F.lit(side)) for s in (-1, 1))
        right = right.select("*", F.explode(F.sequence(low, high)).alias(t))
    if once:
        here = F.struct(*[F.floor(F.col(f"_x{i}") / F.lit(side)).alias(t) for i, t in enumerate(tile)])
        right = right.select("*", (F.struct(*tile) == here).alias("_own")).where(F.struct(*tile) <= here)

    mine = own(a).groupBy(*tile).agg(F.count("*").alias("_n"))
    around = own(b).groupBy(*tile).agg(F.count("*").alias("_n"))  # in and around a tile: at most what the tiles next to it hold
    for t in tile:
        around = around.select(*[c for c in tile if c != t], "_n", F.explode(F.sequence(F.col(t) - 1, F.col(t) + 1)).alias(t))
    around = around.groupBy(*tile).agg(F.sum("_n").alias("_n"))

    def dense(counts: DataFrame, most: int, name: str) -> DataFrame:
        limit = counts.agg(F.greatest(F.lit(most), F.sum("_n") / DENSE).alias("_most"))  # one row
        parts = counts.crossJoin(F.broadcast(limit)).select(*tile, F.ceil(F.col("_n") / F.col("_most")).cast("int").alias(name))
        return F.broadcast(parts.where(F.col(name) > 1))  # DENSE tiles at most

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(dense(mine, MINE, "_na"), tile, "left").join(dense(around, THEIRS, "_nb"), tile, "left").na.fill(1, ["_na", "_nb"])

    number = F.xxhash64(*[f"_x{i}" for i in range(d)], "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(number, F.col(n)).cast("int")
    if two:
        parts, both = lambda low: F.sequence(low, F.col("_nb") - 1), lambda p, q: F.struct(F.least(p, q).alias("_pb"), F.greatest(p, q).alias("_pc"))
        left = dealt(left).select("*", one("_na").alias("_pa"), F.inline(F.flatten(F.transform(parts(F.lit(0)), lambda p: F.transform(parts(p), lambda q: both(p, q)))))).drop("_na", "_nb")
        right = dealt(right).select("*", every("_na").alias("_pa"), one("_nb").alias("_part"))
        right = right.select("*", F.inline(F.transform(parts(F.lit(0)), lambda q: both(F.col("_part"), q)))).drop("_na", "_nb")
        return left, right, [*tile, "_pa", "_pb", "_pc"]
    left = dealt(left).select("*", one("_na").alias("_pa"), every("_nb").alias("_pb")).drop("_na", "_nb")
    right = dealt(right).select("*", every("_na").alias("_pa"), one("_nb").alias("_pb")).drop("_na", "_nb")
    return left, right, [*tile, "_pa", "_pb"]


def _columns(table: pa.Table, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in names}


def _classes(d2: np.ndarray, tops: Sequence[float], closed: bool) -> np.ndarray:
    return sum(((d2 > t) if closed else (d2 >= t)).view(np.int8) for t in tops)


def _walk(at: np.ndarray, there: np.ndarray, tops: Sequence[float], closed: bool, settle: Callable | None, meet: Callable, shared: np.ndarray | None, size: int, bare: bool = False, narrow: Callable | None = None) -> None:
    """Calls meet(block, chunk, gaps, d2) for what must be paired and settle(block, others, classes) for what lies in one class for all of a block.

    With ``bare`` it is meet(block, chunk), and no distance is worked out. narrow(block, others) gives those of the others that a block has to meet.
    """
    beyond = len(tops)
    room = None if bare else np.empty((len(at) + 2, BLOCK * size))  # written over for each chunk: fresh memory costs more than the sums

    def visit(mine: np.ndarray, others: np.ndarray) -> None:
        near, far = np.zeros(len(others)), np.zeros(len(others))
        for x, y in zip(at, there, strict=True):
            low, high, v = x[mine].min(), x[mine].max(), y[others]
            g = np.maximum(np.maximum(low - v, v - high), 0.0)
            near += g * g
            if settle:
                f = np.maximum(v - low, high - v)
                far += f * f
        least = _classes(near * (1 - 1e-12), tops, closed)
        left = least < beyond
        if settle:
            sure = left & (least == _classes(far * (1 + 1e-12), tops, closed))
            if shared is not None:
                sure &= ~shared[others]
            if sure.any():
                settle(mine, others[sure], least[sure])
            left &= ~sure
        others = others[left]
        if not len(others):
            return
        if len(mine) > BLOCK:
            axis = np.ptp(at[:, mine], axis=1).argmax()
            half = np.argpartition(at[axis, mine], len(mine) // 2)
            visit(mine[half[: len(mine) // 2]], others)
            visit(mine[half[len(mine) // 2 :]], others)
            return
        others = narrow(mine, others) if narrow else others
        for start in range(0, len(others), size):
            chunk = others[start : start + size]
            if bare:
                meet(mine, chunk)
                continue
            n, m = len(mine), len(chunk)
            gaps = [np.subtract(y[chunk][None], x[mine][:, None], out=g[: n * m].reshape(n, m)) for x, y, g in zip(at, there, room)]  # noqa: B905
            d2, square = (v[: n * m].reshape(n, m) for v in room[len(gaps) :])
            np.multiply(gaps[0], gaps[0], out=d2)
            for g in gaps[1:]:
                np.add(d2, np.multiply(g, g, out=square), out=d2)
            meet(mine, chunk, gaps, d2)

    visit(np.arange(at.shape[1]), np.arange(there.shape[1]))


def _apart(ids: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Which of the others have an id of this group, and a function that puts a point out of its own reach."""
    shared = np.isin(theirs, ids)

    def part(block, chunk, d2):
        doubted = np.flatnonzero(shared[chunk])
        if len(doubted):
            i, j = np.nonzero(ids[block][:, None] == theirs[chunk[doubted]][None])
            d2[i, doubted[j]] = np.inf

    return shared, part


def pair_sums(a: DataFrame, b: DataFrame, radius: float, work: Work, schema: str, axes: Sequence[str] = AXES, mine: Sequence[str] = (), theirs: Sequence[str] = (), closed: bool = False, same: bool = False, once: bool = False) -> DataFrame:
    """What ``work`` makes of the pairs of each group, rows of ``schema``, to be added up.

    ``work`` gets the columns ``mine`` and ``theirs`` and the ids of the group as arrays and gives
    add(block, chunk, at, gaps, d2), called with rows of both, the coordinates of both, their
    differences and squared distances, and done(), the group's columns. What lies beyond the
    radius has an infinite d2, and so has the own id if ``same``. Points without finite coordinates meet nothing.
    With ``once`` a and b are one catalog and a pair comes from one end only, but from both where
    the other's ``_own``, one more of its columns, is true.
    """
    d, top = len(axes), radius * radius
    mine, theirs = list(dict.fromkeys(["id", *mine])), list(dict.fromkeys(["id", *theirs]))
    left, right, by = _groups(_finite(a, axes, mine), _finite(b, axes, theirs), radius, d, once)
    x = [f"_x{i}" for i in range(d)]
    theirs += ["_own"] if once else []

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        at, there = (np.stack(list(_columns(t, x).values())) for t in (one, other))
        held, met = _columns(one, mine), _columns(other, theirs)
        add, done = work(held, met)
        _, part = _apart(held["id"], met["id"]) if same else (None, None)

        def meet(block, chunk, gaps, d2):
            if same:
                part(block, chunk, d2)
            d2[(d2 > top) if closed else (d2 >= top)] = np.inf
            add(block, chunk, (at[:, block], there[:, chunk]), gaps, d2)

        if one.num_rows and other.num_rows:
            _walk(at, there, [top], closed, None, meet, None, SUMMED)
        return pa.table(done())

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def images(df: DataFrame, radius: float, box: float, axes: Sequence[str] = AXES) -> DataFrame:
    """The points of a periodic box, whose axes lie in [0, box), with their images within the radius of it: pairs with them are those of shortest images."""
    if 2 * radius > box:
        raise ValueError("the radius is larger than half the box")
    reach = radius * (1 + 1e-9)
    for a in axes:
        x = F.col(a).cast("double")
        seen = F.array(x, F.when(x <= F.lit(reach), x + F.lit(box)), F.when(x >= F.lit(box - reach), x - F.lit(box)))
        df = df.select(*[c for c in df.columns if c != a], F.explode(F.filter(seen, lambda v: v.isNotNull())).alias(a))
    return df


def place_rows(df: DataFrame, axes: Sequence[str], weight: str | None = None, by: Sequence[str] = (), same: bool = True) -> tuple[DataFrame, list[str]]:
    """The points with finite coordinates as (id, axes, by.., _w, _again, ..) and the columns that tell a place.

    A place is one point of the axes and of ``by``. With ``same``, for catalogs that meet themselves, an id that
    comes again meets all but itself and a point without an id nothing: their places are their own.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    x = [F.col(a).cast("double").alias(a) for a in axes]
    rows = df.where(" and ".join(f"abs(double(`{a}`)) < double('inf')" for a in axes))
    again = (F.count("*").over(Window.partitionBy("id")) > 1) if same else F.lit(False)
    rows = rows.select("id", *x, *by, w.alias("_w"), again.alias("_again"))
    rows = rows.select("*", F.when(F.col("_again"), F.col("id")).alias("_apart"), (F.col("id").isNull() & F.lit(same)).alias("_nameless"))
    return rows, [*axes, *by, "_apart", "_nameless"]


def places(df: DataFrame, axes: Sequence[str], weight: str | None = None, by: Sequence[str] = (), same: bool = True) -> DataFrame:
    """(axes, by.., id, _n, _w, _w2, _again, ..): the places of place_rows() with one of their ids, their number of points and the sums of weights and of their squares."""
    rows, key = place_rows(df, axes, weight, by, same)
    return rows.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").cast("double").alias("_n"), F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"), F.max("_again").alias("_again"))


def inside_places(held: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The places whose points meet each other at no distance, their number of pairs and the sum of these pairs' products of weights."""
    return held.where("_n > 1 and not _again and not _nameless"), F.col("_n") * (F.col("_n") - 1) / 2, (F.col("_w") * F.col("_w") - F.col("_w2")) / 2


def place_sums(a: DataFrame, b: DataFrame | None, radius: float, work: Work, schema: str, axes: Sequence[str] = AXES, keep: Sequence[str] = (), mine: Sequence[str] = (), once: bool = True) -> DataFrame:
    """What ``work`` makes of the pairs of places() of two catalogs, or of one (b None) of different places, rows of ``schema``, to be added up.

    ``work`` gets the columns id, _n, _w and ``keep`` of both sides, of the first also ``mine``, and their coordinates _at, and
    gives add(block, chunk, at, d2), called with rows of both, the coordinates of both and their squared distances, infinite
    for a pair that is none, done() and, if it likes, narrow(block, others), the others that a block has to meet. Some pairs lie
    beyond the radius. Of one catalog with ``once`` each pair comes once, or twice with half of the other's _n and _w;
    without, once from each end. Squared distances of whole numbers are exact.
    """
    same, d = b is None, len(axes)
    x, columns = [f"_x{i}" for i in range(d)], list(dict.fromkeys(["id", "_n", "_w", *keep]))
    named = a.where("not _nameless") if same else a
    left, right, by = _groups(_finite(named, axes, [*columns, *mine]), _finite(named if same else b, axes, columns), radius, d, same and once)

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        at, there = (np.stack(list(_columns(t, x).values())) for t in (one, other))
        held, met = _columns(one, [*columns, *mine]), _columns(other, columns)
        if same and once:
            half = np.where(other.column("_own").to_numpy(), 0.5, 1.0)
            met |= {k: met[k] * half for k in ("_n", "_w")}
        add, done, *narrow = work(held | {"_at": at}, met | {"_at": there})
        shared, part = _apart(held["id"], met["id"]) if same else (None, None)
        whole = all((np.abs(v) <= WHOLE).all() and (v == np.rint(v)).all() for v in (at, there))
        if whole:
            rows = np.concatenate([-2 * at, np.ones((1, at.shape[1])), (at * at).sum(0)[None]]).T.copy()
            others = np.concatenate([there, (there * there).sum(0)[None], np.ones((1, there.shape[1]))])
        room, gap = np.empty(BLOCK * PAIRED), np.empty(BLOCK * PAIRED)

        def meet(block, chunk):
            n, m = len(block), len(chunk)
            d2 = room[: n * m].reshape(n, m)
            here, beside = at[:, block], there[:, chunk]
            if whole:
                np.matmul(rows[block], others[:, chunk], out=d2)
            else:
                g = gap[: n * m].reshape(n, m)
                d2[:] = 0.0
                for u, v in zip(here, beside, strict=True):
                    np.subtract(v[None], u[:, None], out=g)
                    np.multiply(g, g, out=g)
                    np.add(d2, g, out=d2)
            if same:
                part(block, chunk, d2)
            add(block, chunk, (here, beside), d2)

        if one.num_rows and other.num_rows:
            _walk(at, there, [radius * radius], True, None, meet, None, PAIRED, True, *narrow)
        return pa.table(done())

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def near_counts(a: DataFrame, b: DataFrame, tops: Sequence[float], axes: Sequence[str] = AXES, label: str | None = None, weight: str | None = None, closed: bool = False, same: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..[, label], n0, n1, ..[, w0, w1, ..]): for each point of ``a`` the points of ``b`` in each class of squared distance, and the sums of their weights.

    Class t lies from tops[t - 1] to tops[t], the top belonging to it if ``closed`` and else to
    the next. ``label`` is a column of ``b`` of whole numbers, counted apart; ``keep`` are columns
    of ``a`` that come along. ``same`` leaves out the point's own id. Points with nothing within
    the last top have no row; null weights count as 0.
    """
    d, tops = len(axes), list(map(float, tops))
    extra = {**({"_label": F.col(label).cast("long")} if label else {}), **({"_w": F.coalesce(F.col(weight).cast("double"), F.lit(0.0))} if weight else {})}
    mine = list(dict.fromkeys(["id", *keep]))
    left, right, by = _groups(_finite(a, axes, mine), _finite(b.select("id", *axes, *[c.alias(k) for k, c in extra.items()]), axes, ["id", *extra]), tops[-1] ** 0.5, d)
    x, size = [f"_x{i}" for i in range(d)], len(tops)
    names = [f"{kind}{t}" for kind in (("n", "w") if weight else ("n",)) for t in range(size)]

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        at, there = (np.stack(list(_columns(t, x).values())) for t in (one, other))
        n, m = at.shape[1], there.shape[1]
        labels, code = np.unique(other.column("_label").to_numpy(), return_inverse=True) if label else (np.zeros(1, np.int64), np.zeros(m, np.int64))
        w, k = other.column("_w").to_numpy() if weight else None, len(labels)
        # a column of ones for each label, and one of weights: a matrix product counts them; chunks are short, so single precision is exact
        spread = np.zeros((m, k * (2 if weight else 1)), np.float64 if weight else np.float32)
        spread[np.arange(m), code] = 1
        if weight:
            spread[np.arange(m), k + code] = w
        sums = np.zeros((n, spread.shape[1], size))
        room = np.empty(BLOCK * COUNTED, bool), np.empty(BLOCK * COUNTED, spread.dtype)
        shared, part = _apart(one.column("id").to_numpy(), other.column("id").to_numpy()) if same else (None, None)

        def settle(block, others, least):
            at_ = code[others] * size + least
            held = [np.bincount(at_, v, k * size).reshape(k, size) for v in ((None, w[others]) if weight else (None,))]
            sums[block] += np.concatenate(held)

        def meet(block, chunk, _, d2):
            if same:
                part(block, chunk, d2)
            within, ones = (v[: d2.size].reshape(d2.shape) for v in room)
            columns, below = spread[chunk], 0.0
            for t, top in enumerate(tops):
                np.copyto(ones, (np.less_equal if closed else np.less)(d2, top, out=within))
                up_to = ones @ columns
                sums[block, :, t] += up_to - below
                below = up_to

        if n and m:
            _walk(at, there, tops, closed, settle, meet, shared, COUNTED)
        i, j = np.nonzero(sums[:, :k].any(2))
        counts = [pa.array(np.rint(v).astype(np.int64)) for v in sums[i, j].T]
        weights = [pa.array(v) for v in sums[i, k + j].T] if weight else []
        own = {c: one.column(c).take(pa.array(i)) for c in mine}
        return pa.table({**own, **({"label": pa.array(labels[j])} if label else {}), **dict(zip(names, counts + weights, strict=True))})

    types = dict(_types(left, mine), **({"label": "bigint"} if label else {}), **{c: "bigint" if c[0] == "n" else "double" for c in names})
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in types.items()))
    return met.groupBy(*mine, *(["label"] if label else [])).agg(*[F.sum(c).alias(c) for c in names])  # a point's others lie in several parts of a dense tile


def _types(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    types = dict(df.dtypes)
    return {c: types[c] for c in names}


def _near_each_other(at: np.ndarray, size: int) -> np.ndarray:
    """An order of the points in which those of a run of ``size`` stand together."""
    out = []

    def halve(some: np.ndarray) -> None:
        if len(some) <= size:
            out.append(some)
            return
        axis = np.ptp(at[:, some], axis=1).argmax()
        cut_at = size * (-(-len(some) // size) // 2)  # whole runs
        parted = np.argpartition(at[axis, some], cut_at)
        halve(some[parted[:cut_at]])
        halve(some[parted[cut_at:]])

    halve(np.arange(at.shape[1]))
    return np.concatenate(out)


class _Shell:
    """Which points of two sets lie from ``low`` to ``high`` in squared distance, as ones and zeros."""

    def __init__(self, low: float, high: float, whole: bool):
        self.low, self.high, self.whole = low, high, whole

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.whole:  # all terms are whole numbers below 2^53
            middle = x.mean(1).round()[:, None]
            x, y = x - middle, y - middle
            ones = np.ones((1, x.shape[1])), np.ones((1, y.shape[1]))
            d2 = np.concatenate([-2 * x, ones[0], (x * x).sum(0)[None]]).T @ np.concatenate([y, (y * y).sum(0)[None], ones[1]])
        else:
            d2 = sum((b[None] - a[:, None]) ** 2 for a, b in zip(x, y, strict=True))
        inside = d2 >= self.low
        inside &= d2 <= self.high
        return inside.astype(np.float32)

    def all_or_none(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool | None:
        """Whether all points of two boxes (lows, highs) are apart so, or none; None if it depends on the points."""
        near = (np.maximum(np.maximum(x[0] - y[1], y[0] - x[1]), 0.0) ** 2).sum()
        far = (np.maximum(x[1] - y[0], y[1] - x[0]) ** 2).sum()
        if near * (1 - 1e-12) > self.high or far * (1 + 1e-12) < self.low:
            return False
        return True if near * (1 - 1e-12) >= self.low and far * (1 + 1e-12) <= self.high else None


def triangle_counts(points: DataFrame, low: float, high: float, axes: Sequence[str] = AXES) -> DataFrame:
    """(id, n): triangles at each vertex all of whose sides lie from ``low`` to ``high``, low above 0; ids are unique.

    A tile's points meet all points within the longest side in one group, no pair and no wedge has a row.
    For each block of points the sides to the others, ones and zeros, are multiplied with the
    sides among the others, piece by piece. In dense tiles any two parts of the others meet.
    """
    d, ident = len(axes), dict(points.dtypes)["id"]
    finite = lambda: _finite(points.where("id is not null"), axes, ["id"])  # noqa: E731  one for each side
    left, right, by = _groups(finite(), finite(), high, d, mean=CORNERS, two=True)
    x = [f"_x{i}" for i in range(d)]

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        here, there = (np.stack(list(_columns(t, x).values())) for t in (one, other))
        whole = all((np.abs(v) <= WHOLE).all() and (v == np.rint(v)).all() for v in (here, there))
        shell, top = _Shell(low * low, high * high, whole), high * high
        order = _near_each_other(here, BLOCK)
        here, n = here[:, order], np.zeros(len(order))
        part, pb, pc = (other.column(c).to_numpy() for c in ("_part", "_pb", "_pc"))
        same = not len(pb) or pb[0] == pc[0]
        sides = [there] if same else [there[:, part == pb], there[:, part == pc]]
        sides = [s[:, _near_each_other(s, PIECE)] for s in sides if s.shape[1]]
        if len(sides) < (1 if same else 2):
            return pa.table({"id": one.column("id").slice(0, 0), "n": pa.array([], pa.int64())})

        def pieces(block: np.ndarray, others: np.ndarray) -> list[tuple]:
            least, most = block.min(1)[:, None], block.max(1)[:, None]
            gap = np.maximum(np.maximum(least - others, others - most), 0.0)
            others = others[:, (gap * gap).sum(0) <= top * (1 + 1e-12)]
            met = shell(block, others)
            some = met.any(0)
            others, met = others[:, some], np.ascontiguousarray(met[:, some])
            cuts = [slice(k, k + PIECE) for k in range(0, others.shape[1], PIECE)]
            return [(others[:, c], met[:, c], (others[:, c].min(1), others[:, c].max(1))) for c in cuts]

        for start in range(0, len(order), BLOCK):
            block, total = here[:, start : start + BLOCK], n[start : start + BLOCK]
            held = [pieces(block, s) for s in sides]
            for i, (p, met_p, box_p) in enumerate(held[0]):
                for j, (q, met_q, box_q) in enumerate(held[0][i:] if same else held[1]):
                    among = shell.all_or_none(box_p, box_q)
                    if among is False:
                        continue
                    if among:
                        found = met_p.sum(1) * met_q.sum(1)
                    else:
                        found = np.einsum("ij,ij->i", met_p @ shell(p, q), met_q)  # at most PIECE squared: single precision is exact
                    total += found * 0.5 if same and j == 0 else found
        counts = np.rint(n).astype(np.int64)
        some = np.flatnonzero(counts)
        return pa.table({"id": one.column("id").take(pa.array(order[some])), "n": pa.array(counts[some])})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"id {ident}, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n"))
