"""Filter interaction audit: what each filter removes in each order of the filters.

A document's failures are one mask. Histograms of the masks by part, of all documents and of
those with a label, are stacked as rows of 2^k counts; one product with integer matrices of
2^k rows and k! * k columns (32 by 600 for five filters) gives what is kept, removed,
redundant and unique at each step of each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import own, stored

LETTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text: few words, few distinct words, many capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs``: bit i of the mask is set if the i-th filter of LETTERS fails.

    A null text counts as empty, a null lang is the part ''. E fails if the same text stands
    under a smaller doc_id anywhere in the table; rows that repeat id and text are equals, and
    a row without an id neither fails E nor makes others fail. Texts are compared by SHA-256.
    The first id of a text meets its rows by text and id together, so that a text with a
    third of all rows is no group of any join.
    """
    text = F.coalesce(own(docs, "text"), F.lit(""))
    rows = docs.select(own(docs, "doc_id").alias("doc_id"), F.coalesce(own(docs, "lang"), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text")))]
    marked = stored(rows.select("doc_id", "part", (bits[0] + bits[1] + bits[2] + bits[3]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "of")
    met = marked.join(firsts, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first_id")), "left")
    again = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    return met.select("doc_id", "part", (F.col("mask") + F.when(again, 1 << 4).otherwise(0)).alias("mask"))


def matrices(letters: str = LETTERS) -> dict[str, np.ndarray]:
    """Integer matrices of 2^k rows (masks) and k! * k columns (orders in lexicographic order, then steps).

    ``shapley`` sums the removals of a step's filter over all its columns.
    """
    k = len(letters)
    masks = np.arange(1 << k)[:, None]
    orders = np.array(list(permutations(range(k))))
    own_bit = (1 << orders).reshape(1, -1)
    upto = np.cumsum(1 << orders, axis=1).reshape(1, -1)
    earlier = (masks & (upto - own_bit)) != 0
    fails = (masks & own_bit) != 0
    found = {"kept": (masks & upto) == 0, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": masks == own_bit}
    out = {name: m.astype(np.int64) for name, m in found.items()}
    out["shapley"] = out["removed"] @ (orders.reshape(-1, 1) == orders.reshape(1, -1)).astype(np.int64)
    return out


def audit(failed: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step: counts of documents, see SCHEMA.

    ``failed`` has doc_id, part and mask; ``labels`` doc_id, quality and toxic. Rows of
    ``labels`` that repeat an id count once, label 1 if any says so; rows without an id label
    nothing, and a document without a label is neither good nor toxic. Other columns are
    ignored. Parts are those of ``failed``: an empty table gives no row. A part is one row of
    2^k counts before the product, so no task holds more than a batch of parts.
    """
    said = labels.where(own(labels, "doc_id").isNotNull()).groupBy(own(labels, "doc_id").alias("of")).agg(
        F.max(F.when(own(labels, "quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(own(labels, "toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    met = failed.join(said, F.col("doc_id") == F.col("of"), "left")
    counts = met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^k cells at most
    return stacked.mapInArrow(lambda batches: _products(batches, letters), SCHEMA)


def _products(batches: Iterator[pa.RecordBatch], letters: str) -> Iterator[pa.RecordBatch]:
    by_name = matrices(letters)
    k = len(letters)
    orders = ["".join(o) for o in permutations(letters)]
    for b in batches:
        for at in range(0, b.num_rows, 64):
            some = b.slice(at, 64)
            parts, cells = some["part"].to_pylist(), some["cells"].to_pylist()
            rows = np.zeros((3, len(parts), 1 << k), np.int64)
            for i, row in enumerate(cells):
                for c in row:
                    rows[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
            columns = {name: rows[0] @ m for name, m in by_name.items()}
            columns["good_lost"], columns["toxic_lost"] = rows[1] @ by_name["removed"], rows[2] @ by_name["removed"]
            out = {"part": [p for p in parts for _ in range(len(orders) * k)], "filter_order": [o for _ in parts for o in orders for _ in range(k)], "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * len(parts)))}
            out |= {name: columns[name].reshape(-1) for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
            yield pa.RecordBatch.from_pydict(out)
