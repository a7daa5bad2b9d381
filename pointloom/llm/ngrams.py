"""Character n-gram features scaled by naive Bayes log-count ratios, shared by the two classifiers.

Texts are folded (lower case, runs of white space to one space) and their byte n-grams of
the orders 3, 4 and 5 hashed to 2^BITS buckets. A feature is the presence of a bucket. Its
scale is the log ratio of its smoothed document counts in the two classes; the counts are
summed on the executors. The buckets that tell the classes apart best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import slices

BITS = 20
ORDERS = (3, 4, 5)
#: Labelled ids that a model is fitted on, about, if there are more.
SAMPLE = 12_000
#: Buckets kept, the labelled rows that one must be in, and the standard errors its shares must differ by.
FEATURES = 16_384
LEAST_ROWS = 3
LEAST_Z = 5.0
SMOOTHING = 1.0
STRIDE = 1 << 20


def hashes(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in slices, repeats included."""
    folded = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "
    raw = np.frombuffer(folded, np.uint8)
    for at in range(0, max(1, len(raw) - ORDERS[0] + 1), STRIDE):
        part = raw[at : at + STRIDE + ORDERS[-1] - 1].astype(np.uint64)
        key = part
        for order in range(2, ORDERS[-1] + 1):
            if len(part) < order:
                break
            key = key[:-1] << np.uint64(8) | part[order - 1 :]
            if order in ORDERS:
                yield (((key + np.uint64(order << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str | None, among: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, of those ``among`` marks if it is given."""
    found = [np.unique(h if among is None else h[among[h]]) for h in hashes(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass
class Scaled:
    """The kept buckets (sorted) and their log-count ratios."""

    buckets: np.ndarray
    ratios: np.ndarray

    def marks(self) -> np.ndarray:
        marks = np.zeros(1 << BITS, bool)
        marks[self.buckets] = True
        return marks


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(text, y) of labelled rows: all of them, or of more than ``sample`` ids about so many, those whose hash is below a share of all hashes.

    Rows without a label are left out; a doc_id has one label, the largest given; of equal
    texts with equal labels one is taken, lest copies be learnt by heart.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    labelled = docs.select("doc_id").distinct().join(known, "doc_id")
    below = int(min(1.0, sample / max(1, labelled.count())) * (1 << 31))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < below)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # ``sample`` ids, about
    return rows.select("text", (F.col("y") > 0).cast("int").alias("y")).distinct()


def counted(rows: DataFrame) -> tuple[Scaled, int, int]:
    """Kept buckets with ratios, and the number of rows of either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for b in slices(batches):
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                sums[y][present(text.as_py())] += 1
                n[y] += 1
        for y in (0, 1):
            ids = np.flatnonzero(sums[y])
            yield pa.RecordBatch.from_arrays([pa.array([y] * (len(ids) + 1), pa.int32()), pa.array([*ids.tolist(), -1], pa.int32()), pa.array([*sums[y][ids].tolist(), n[y]], pa.int64())], ["y", "bucket", "n"])

    summed = rows.mapInArrow(count, "y int, bucket int, n long").groupBy("bucket").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"))
    table = summed.where(f"bucket < 0 or n0 + n1 >= {LEAST_ROWS}").toArrow()  # 2^BITS rows at most
    bucket, n0, n1 = (table[c].to_numpy().astype(float) for c in ("bucket", "n0", "n1"))
    of = bucket < 0
    q, p = (float(n0[of].sum()), float(n1[of].sum()))
    bucket, n0, n1 = bucket[~of].astype(np.int64), n0[~of], n1[~of]
    if not p or not q:
        return Scaled(np.empty(0, np.int64), np.empty(0)), int(q), int(p)
    share = (n0 + n1) / (p + q)
    z = np.abs(n1 / p - n0 / q) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / p + 1 / q))
    order = np.lexsort((bucket, -z))[:FEATURES]
    kept = np.sort(order[z[order] >= LEAST_Z])
    by = np.argsort(bucket[kept])
    bucket, n0, n1 = bucket[kept][by], n0[kept][by], n1[kept][by]
    ratios = np.log((n1 + SMOOTHING) / (p + 2 * SMOOTHING)) - np.log((n0 + SMOOTHING) / (q + 2 * SMOOTHING))
    return Scaled(bucket, ratios), int(q), int(p)


def design(rows: DataFrame, scaled: Scaled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the sample on the driver: row starts, feature numbers, labels (0 or 1). SAMPLE * FEATURES numbers at most."""
    held = rows.sparkSession.sparkContext.broadcast(scaled)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, buckets = held.value.marks(), held.value.buckets
        for b in slices(batches):
            found = [np.searchsorted(buckets, present(t.as_py(), marks)).astype(np.int32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], ["y", "x"])

    table = rows.mapInArrow(featured, "y int, x array<int>").toArrow().combine_chunks()
    lists = table["x"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy(), table["y"].to_numpy().astype(float)


@dataclass
class Linear:
    """Weights on the scaled features, laid out by bucket, and the map from margin to score."""

    scaled: Scaled
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.scaled.buckets] = self.weights * self.scaled.ratios
        return out

    def score(self, text: str | None, marks: np.ndarray, dense: np.ndarray) -> float:
        if self.prior is not None:
            return self.prior
        margin = float(dense[present(text, marks)].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def scored(docs: DataFrame, model: Linear, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; null and empty texts have no features and get the bias' score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        marks, dense = model.scaled.marks(), model.dense()
        for b in slices(batches):
            scores = [model.score(t.as_py(), marks, dense) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, predicted int")


def fitted(docs: DataFrame, labels: DataFrame, label: str, fit, sample: int = SAMPLE) -> Linear:
    """Sample, count, select, and hand the features to ``fit(starts, columns, ratios, y)`` -> weights, bias, slope, shift.

    Without rows of both classes the model scores the only class seen, 0 if there is none.
    """
    rows = sampled(docs, labels, label, sample).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scaled, n0, n1 = counted(rows)
        if not n0 or not n1:
            return Linear(scaled, np.empty(0), 0.0, prior=float(n1 > 0))
        starts, columns, y = design(rows, scaled)
        weights, bias, slope, shift = fit(starts, columns, scaled.ratios, y)
        return Linear(scaled, weights, bias, slope, shift)
    finally:
        rows.unpersist()
