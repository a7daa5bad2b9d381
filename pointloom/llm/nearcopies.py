"""Near-duplicate groups: SimHash links, completed by an exact join on shared word shingles.

Texts with a Jaccard similarity of 0.8 over five-word shingles have 64-bit fingerprints some
5 to 14 bits apart, so two such fingerprints need not share a byte and the positional index
of :mod:`simhash` can promise nothing for them. It finds the texts that are all but equal;
what it cannot promise comes from a prefix-filtered join of the shingle sets, without loss.

Two sets of n shingles with that similarity share one among the first n - ceil(0.8 n) + 1 of
each, in any order that is the same for all. The order here is by hash, with the shingles
that many texts share put last, so that a common passage fills no prefix unless it is nearly
the whole text. A pair is taken at a shingle only if the sizes, and what is left of both sets
from there on, still allow the similarity; at the first shingle a similar pair shares they do.
Members of a list meet its smallest key first. Only those that this leaves in different
components then meet each other, in blocks: pairs that are joined already change no
component. Candidates are verified on the whole sets, which travel once for a family of
candidates instead of once for a pair.

A large family of near copies shares nearly all of its shingles, so each member would meet
each other one. In a long list the members are therefore told apart by what they do not share
with one of them, the pivot: for the differences D = S ^ P from any one set P, |S ^ T| is
|D_S| + |D_T| - 2 |D_S & D_T|. Members so close to the pivot that this is small whatever
D_S & D_T is are similar to the pivot. All other similar pairs share an element of their
differences, which few members have, and the same bounds hold for these sets as for whole ones,
which are the differences from an empty pivot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import drop_stored, slices, small_batches, stored
from pointloom.llm.components import connected_components
from pointloom.llm.simhash import fingerprint, grouped, links, shingle_hashes

SHINGLE = 5
#: The least Jaccard similarity of a link, in percent, so that all bounds are whole numbers.
PERCENT = 80
#: Shingles in the counted parts of more texts than this come last in the order, the 2^18 most
#: common ones at most (2 MB in each worker). Lists with more members than this are long and have
#: a pivot. Neither changes a result.
HOT_LIST, HOT_SHINGLES = 64, 1 << 18
#: Members of a block of a long list.
BLOCK = 1024
#: Shingles of all pairs verified in one group, repeats included (8 bytes each).
GROUP = 1 << 18
#: Rows of an Arrow batch: texts, or one or two sets each.
BATCH = 500
#: Sets a task remembers, to send one of many copies only.
REMEMBERED = 1 << 16


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order; none for null and for a text without a word."""
    parts = [np.unique(p) for p in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


class _Seen:
    """Whether a task has met a key of late: the map side of a distinct, of bounded memory."""

    def __init__(self):
        self.keys: set[int] = set()

    def __call__(self, key: int) -> bool:
        if key in self.keys:
            return True
        if len(self.keys) >= REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return False


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Seen()
    for batch in slices(batches):
        prints, keys, low = [], [], []
        for text in batch.column(1):
            found = shingle_set(text.as_py())
            prints.append(fingerprint(text.as_py()))
            keys.append(_key(found))
            low.append(found[:0] if seen(keys[-1]) else found[: max(prefix_length(len(found)), 3 * len(found) // 10)])
        ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low).view(np.int64)) if low else pa.array([], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.int64()), lists], ["doc_id", "fp", "key", "low"])


def _prefixes(hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in slices(batches, 250):
            rows: list[tuple[np.ndarray, int, int]] = []
            for text in batch.column(0):
                found = shingle_set(text.as_py())
                key = _key(found)
                if not len(found) or seen(key):
                    continue
                late = hot[np.searchsorted(hot[:-1], found)] == found if len(hot) else np.zeros(len(found), bool)
                rows.append((np.concatenate([found[~late], found[late]])[: prefix_length(len(found))], key, len(found)))
            if rows:
                sizes = [len(p) for p, _, _ in rows]
                columns = [
                    np.concatenate([p for p, _, _ in rows]).view(np.int64),
                    np.repeat(np.array([k for _, k, _ in rows], np.int64), sizes),
                    np.repeat(np.array([n for _, _, n in rows], np.int32), sizes),
                    np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "key", "n", "pos"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 250):
        found = [shingle_set(t.as_py()) for t in batch.column(0)]  # 250 rows, so that few sets are held at once
        yield pa.RecordBatch.from_arrays([pa.array([_key(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["key", "members"])


def _verified(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    members = {k.as_py(): np.frombuffer(m.as_buffer(), np.uint64) for k, m in zip(sets.column("key"), sets.column("members"), strict=True)}
    us, vs = pairs.column("u").to_pylist(), pairs.column("v").to_pylist()
    kept = []
    for u, v in zip(us, vs, strict=True):
        a, b = members[u], members[v]
        shared = len(np.intersect1d(a, b, assume_unique=True))
        kept.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
    return pairs.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 250):
        sets, pivots = ([np.frombuffer(m.as_buffer(), np.uint64) for m in batch.column(c)] for c in ("members", "of_pivot"))
        apart = [np.setxor1d(a, b, assume_unique=True) for a, b in zip(sets, pivots, strict=True)]
        sizes = [pa.array([len(x) for x in v], pa.int32()) for v in (sets, pivots)]
        ends = np.cumsum([0, *map(len, apart)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("key"), *sizes, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(apart).view(np.int64)))], ["pivot", "key", "n", "n_pivot", "apart"])


#: Twice the size of two differences' intersection that a similar pair has, on the scale 100 + PERCENT, is at least what both sides' ``bound`` add up to.
_BOUND = f"{100 + PERCENT}L * d - {100 - PERCENT}L * n"
_ALLOWED = f"u < v and root_u <> root_v and 100L * least(n_u, n_v) >= {PERCENT} * greatest(n_u, n_v) and {2 * (100 + PERCENT)}L * least(d_u - pos_u, d_v - pos_v) >= {_BOUND.replace(' d', ' d_u').replace(' n', ' n_u')} + {_BOUND.replace(' d', ' d_v').replace(' n', ' n_v')}"


def _side(lists: DataFrame, name: str, *more) -> DataFrame:
    return lists.select("hash", *more, *[F.col(c).alias(name if c == "key" else f"{c}_{name}") for c in ("key", "n", "d", "pos", "root")])


def _lists(prefixes: DataFrame) -> DataFrame:
    """(hash, key, n, pos, size) of the shingles that more than one set has in its prefix and of how many have it, a table."""
    every = Window.partitionBy("hash")
    met = prefixes.select("*", F.min("key").over(every).alias("least"), F.max("key").over(every).alias("most")).where("least <> most")
    once = met.select("hash", "key", "n", "pos").distinct()
    return stored(once.select("*", F.count("*").over(every).alias("size")))


def _apart(long: DataFrame, docs: DataFrame, printed: DataFrame) -> DataFrame:
    """(hash, key) of long lists -> (pivot, key, n, n_pivot, apart): the differences of each member from the pivots of its lists, a table.

    The pivot of a list is the member that is in most long lists, so that the lists of a family have few.
    """
    often = long.groupBy("key").agg(F.count("*").alias("often"))
    pivots = long.join(often, "key").groupBy("hash").agg(F.max_by("key", F.struct("often", "key")).alias("pivot"))
    members = stored(long.join(pivots, "hash").select("pivot", "key").distinct())
    sets = stored(_sets_of(members.select("key").distinct(), docs, printed))  # a pivot is a member
    met = members.join(sets, "key").join(sets.select(F.col("key").alias("pivot"), F.col("members").alias("of_pivot")), "pivot")
    found = stored(met.mapInArrow(_differences, "pivot long, key long, n int, n_pivot int, apart array<long>"))
    for done in (members, sets):
        drop_stored(done)
    return found


def _lists_apart(apart: DataFrame) -> DataFrame:
    """(hash, key, n, d, pos): lists of what members differ in from a pivot, the rarest first, as far as a member of any ``bound`` can need them."""
    each = apart.select("pivot", "key", "n", "n_pivot", F.size("apart").alias("d"), F.explode("apart").alias("element"))
    sized = each.withColumn("size", F.count("*").over(Window.partitionBy("pivot", "element")))
    placed = sized.withColumn("pos", F.row_number().over(Window.partitionBy("pivot", "key").orderBy("size", "element")) - 1)
    near = placed.where(f"size > 1 and {2 * (100 + PERCENT)}L * (d - pos) >= {_BOUND} - {100 - PERCENT}L * n_pivot")  # no bound is below the pivot's
    return near.select(F.xxhash64("pivot", "element").alias("hash"), "key", "n", "d", "pos")


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of lists whose members (node, root) has in different components, with their root."""
    rooted = lists.join(roots.withColumnRenamed("node", "key"), "key", "left").select("hash", "key", "n", "d", "pos", F.coalesce("root", "key").alias("root"))
    every = Window.partitionBy("hash")
    return rooted.select("*", F.min("root").over(every).alias("least"), F.max("root").over(every).alias("most"), F.count("*").over(every).alias("size")).where("least <> most").drop("least", "most")


def _weighed(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v", (F.col("n_u").cast("long") + F.col("n_v")).alias("weight")).distinct()


def _stars(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(hash, key, n, d, pos) -> distinct (u, v, weight): each member of a list with the list's smallest key, as far as the bounds allow and (node, root) has them in different components."""
    rooted = stored(_rooted(lists, roots))
    centre = rooted.groupBy("hash").agg(F.min_by(F.struct("key", "n", "d", "pos", "root"), "key").alias("c")).select("hash", "c.*")
    return _weighed(_side(centre, "u").join(_side(rooted, "v"), "hash").where(_ALLOWED))


def _candidates(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(hash, key, n, d, pos) -> distinct (u, v, weight) with u < v, among them every pair of similar sets that share a list and that (node, root) has in different components."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = stored(_rooted(lists, roots).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = _side(placed, "u", F.col("own").alias("i"), others.alias("j"))
    right = _side(placed, "v", others.alias("i"), F.col("own").alias("j"))
    return _weighed(left.join(right, ["hash", "i", "j"]).where(_ALLOWED))


def _sets_of(keys: DataFrame, docs: DataFrame, printed: DataFrame) -> DataFrame:
    """(key, members): the whole sets of the keys."""
    # one row that has the set: its id is null-safe, other rows of that id bring sets nobody asks for
    asked = printed.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("asked"))
    ids = stored(asked.select("asked").distinct())
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = named.join(ids, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi").select("text")
    return rows.mapInArrow(_sets, "key long, members binary").dropDuplicates(["key"])


def _similar(candidates: DataFrame, docs: DataFrame, printed: DataFrame) -> DataFrame:
    """The candidates (u, v, weight) whose whole sets have the similarity: (u, v), a table."""
    pairs = stored(candidates)
    # candidates are verified in families: those that have the smallest neighbour of u in common
    ends = pairs.select(F.col("u").alias("key"), F.col("u").alias("least")).union(pairs.select("v", "u"))
    least = ends.groupBy("key").agg(F.min("least").alias("home"))
    homed = stored(pairs.join(least.withColumnRenamed("key", "u"), "u"))
    weights = homed.groupBy("home").agg(F.sum("weight").alias("weight"))
    total = homed.agg(F.sum("weight")).first()[0] or 0
    parts = weights.select("home", F.ceil(F.sqrt(F.col("weight") / GROUP)).cast("int").alias("parts"))
    joined = homed.drop("weight").join(parts, "home")
    alone = F.col("parts") > 1
    shared = F.pmod(F.xxhash64("home"), F.lit(total // GROUP + 1))
    placed = stored(
        joined.select(
            F.when(alone, F.col("home")).otherwise(shared).alias("home"),
            F.when(alone, F.pmod(F.xxhash64("u"), F.col("parts"))).otherwise(-1).alias("i"),
            F.when(alone, F.pmod(F.xxhash64("v"), F.col("parts"))).otherwise(-1).alias("j"),
            "u",
            "v",
        )
    )
    sets = _sets_of(least, docs, printed)
    ends = placed.select(F.col("home").alias("at"), F.col("i").alias("at_i"), F.col("j").alias("at_j"), F.explode(F.array("u", "v")).alias("key"))
    wanted = ends.distinct().join(sets, "key")
    found = stored(placed.groupBy("home", "i", "j").cogroup(wanted.groupBy("at", "at_i", "at_j")).applyInArrow(_verified, "u long, v long"))
    for done in (pairs, homed, placed):
        drop_stored(done)
    return found


def similar_pairs(docs: DataFrame, printed: DataFrame) -> DataFrame:
    """Pairs (u, v) of keys of different shingle sets with a Jaccard similarity of ``PERCENT`` or more, enough of them to join all.

    Every such pair is a row, or its ends are joined by a chain of rows. Members of a long list
    meet its pivot first and the others only over what they do not share with it; of those, and in short
    lists, members meet the list's smallest first, and what that joins need not meet in pairs
    any more. So a family of copies costs its members, not its pairs.
    """
    counted = printed.select(F.explode("low").alias("hash")).groupBy("hash").count().where(F.col("count") > HOT_LIST)
    hot = counted.orderBy(F.desc("count"), "hash").limit(HOT_SHINGLES).select("hash").toArrow().column("hash").to_numpy().view(np.uint64)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    every = _lists(texts.mapInArrow(_prefixes(np.sort(hot)), "hash long, key long, n int, pos int"))
    apart = _apart(every.where(F.col("size") > HOT_LIST), docs, printed)
    close = apart.where(f"key <> pivot and {100 + PERCENT}L * size(apart) <= {100 - PERCENT}L * (n + n_pivot)")
    known = stored(close.select(F.least("pivot", "key").alias("u"), F.greatest("pivot", "key").alias("v")).distinct())
    short = every.where(F.col("size") <= HOT_LIST).select("hash", "key", "n", F.col("n").alias("d"), "pos")
    lists = stored(short.union(_lists_apart(apart)))
    near = known.union(_similar(_stars(lists, stored(connected_components(known))), docs, printed))
    rest = _similar(_candidates(lists, stored(connected_components(near))), docs, printed)
    for done in (every, apart, lists):
        drop_stored(done)
    return near.union(rest)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable.

    A link joins two texts whose fingerprints differ in ``simhash.MAX_BITS`` or fewer bits, or
    whose sets of ``SHINGLE``-word shingles (lower-cased A-Z; fewer words: the whole sequence)
    have a Jaccard similarity of ``PERCENT`` / 100 or more. Null, empty and blank texts have one
    set, the empty one. Repeated rows give repeated rows; a null doc_id keeps its row. Of other
    columns, whatever their names, nothing is used. An empty table gives an empty result.
    Sets and shingles are told apart by 64-bit hashes.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession, BATCH):
        printed = stored(named.mapInArrow(_printed, "doc_id long, fp long, key long, low array<long>"))
        pairs = stored(similar_pairs(docs, printed))
    slim = stored(printed.select("doc_id", "fp", "key"))
    drop_stored(printed)
    prints = slim.select("key", "fp").distinct()
    first = prints.groupBy("key").agg(F.min("fp").alias("first"))
    same = prints.join(first, "key").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    of_u, of_v = first.select(F.col("key").alias("u"), F.col("first").alias("fp_u")), first.select(F.col("key").alias("v"), F.col("first").alias("fp_v"))
    near = pairs.join(of_u, "u").join(of_v, "v").select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"))
    return grouped(slim.select("doc_id", "fp"), links(slim.select("fp").distinct()).union(same).union(near))
