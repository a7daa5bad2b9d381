"""SimHash near-duplicate groups through an inverted index of positional bytes.

A fingerprint has eight bytes. Two fingerprints at ``MAX_BITS`` = 2 differing bits
differ in two bytes at most, so they share six positional bytes at least: that is the
guaranteed minimum of the count filter. Lists of single bytes would hold 1/256 of all
fingerprints each, so the index files a fingerprint under four bytes at a time: the
eight positions make four quarters, two of which any linked pair shares whole, hence
six lists for each fingerprint and about n / 2^32 chance members in a list.
Within a list the shared positional bytes of each pair are tallied, pairs that reach
six are retained and the bits compared; only true links leave the list.

A list longer than ``HOT_LIST`` (a large family of near copies) is not paired. Its
members go to an index of all fingerprints one bit away: two fingerprints are linked
exactly if such balls meet, and members of one meeting point are linked as a star.
That is 65 rows a member whatever the size of the family, and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import nested, slices, stored
from pointloom.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
HOT_LIST = 64
#: Shingles hashed and counted at once: bounds the memory for very long texts.
STRIDE = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, ``STRIDE`` at a time; nothing for null and for a text without a word."""
    words = [] if text is None else text.encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[max(min(shingle, len(words)) - 1, 0) :]
    h = xxhash.xxh64_intdigest
    for at in range(0, len(ends), STRIDE):
        yield np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : at + STRIDE], ends[at : at + STRIDE], strict=False)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text; 0 for null and for a text without a word."""
    count, ones = 0, np.zeros(64, np.int64)
    for part in shingle_hashes(text, shingle):
        count += len(part)
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _shared_bytes(a, b):
    apart = a.bitwiseXOR(b)
    return sum((apart.bitwiseAND(F.lit(0xFF << (8 * k) if k < 7 else -(1 << 56))) == 0).cast("int") for k in range(8))


def links(prints: DataFrame, hot_list: int = HOT_LIST) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that join all pairs within two bits.

    Every linked pair of fingerprints is either a row or joined by a star of rows that are
    links themselves.
    """
    quarters = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    lists = [F.struct(F.lit(i).alias("place"), (quarters[a] * 65536 + quarters[b]).alias("bytes")) for i, (a, b) in enumerate((a, b) for a in range(4) for b in range(a))]
    filed = prints.select("fp", F.inline(F.array(*lists)))
    sizes = filed.groupBy("place", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    sized = stored(filed.join(sizes, ["place", "bytes"]))
    short = sized.where(F.col("n") <= hot_list).groupBy("place", "bytes").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    one = short.select("fps", F.explode("fps").alias("u"))
    near = one.select(
        "u",
        F.explode(F.filter("fps", lambda x: (x > F.col("u")) & (_shared_bytes(x, F.col("u")) >= MIN_BYTES) & (F.bit_count(x.bitwiseXOR(F.col("u"))) <= MAX_BITS))).alias("v"),
    )
    hot = sized.where(F.col("n") > hot_list).select("fp").distinct()
    ball = hot.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63))) for k in range(64)]))).alias("meet"))
    centre = ball.groupBy("meet").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    star = ball.join(centre, "meet").where("fp <> u").select("u", F.col("fp").alias("v"))
    return near.union(star).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of two bits or fewer. Texts
    that are null, empty or white space have fingerprint zero and are linked like any
    other. Repeated rows give repeated rows. A null doc_id keeps its row; it takes the
    smallest id of its component, null if there is none. Of other columns, whatever their
    names, nothing is used. An empty table gives an empty result.
    """
    printed = stored(fingerprints(docs))
    return grouped(printed, links(printed.select("fp").distinct()))


def grouped(printed: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp) rows and links (u, v) of fingerprints -> (doc_id, fp, component_id)."""
    nodes = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(edges)
    rooted = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return printed.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Of each near-duplicate group the row with the smallest doc_id; the columns of ``docs``, whatever their names.

    Null, empty and blank texts are one group. An empty table gives an empty result.
    Rows that repeat the kept doc_id are kept once (the one with the smallest text, nulls
    first). Rows without a doc_id all stay: nothing names them as a copy. ``groups`` are those
    of simhash_groups() unless others are given.
    """
    kept = (simhash_groups(docs) if groups is None else groups).where("doc_id = component_id").select("doc_id").distinct()
    rows = nested(docs.where("doc_id is not null"), "doc_id", "text").join(kept, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    once = rows.select("row", F.row_number().over(first).alias("rank")).where("rank = 1").select("row.*")
    return once.unionByName(docs.where("doc_id is null"))
