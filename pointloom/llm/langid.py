"""Language identification by multilingual mixture inference.

Each language is a multinomial over hashed byte trigrams of lower-cased letters, counted
from labelled rows. A document's trigrams are taken as draws from a mixture of languages;
expectation-maximisation estimates the proportions. The set of languages is chosen by
penalised likelihood: it starts with the best single language, and a language joins as
long as the gain in log-likelihood exceeds half the log of the number of trigrams times
``PENALTY``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import nested, slices

BITS = 15
#: Labelled rows of each language that are counted, about: the bound of the training sample.
SAMPLE = 1000
#: Languages the model holds at most; the driver keeps one vector of 2^BITS floats for each.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
PENALTY = 2.0
ROUNDS = 12
STRIDE = 1 << 20
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become spaces; bytes of other characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a text and their counts."""
    if text is None:
        return np.empty(0, np.int64), np.empty(0)
    folded = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    raw = np.frombuffer(folded, np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int64), np.empty(0)
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(raw) - 2, STRIDE):
        a = raw[at : at + STRIDE + 2].astype(np.uint32)
        key = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        counts += np.bincount(key, minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids].astype(float)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            ids, counts = grams(text.as_py())
            sums.setdefault(lang, np.zeros(1 << BITS))[ids] += counts
    for lang, s in sums.items():
        ids = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(s[ids].astype(np.int64))], ["lang", "gram", "n"])


class Model:
    """Languages in code point order and the log-probability of each trigram in each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32) if languages else np.empty((1 << BITS, 0), np.float32)

    def proportions(self, text: str | None) -> dict[str, float]:
        """Language -> share of the trigrams, of the chosen set; empty for null, no letter or no model."""
        if text is None or not self.languages or not _LETTER.search(text):
            return {}
        ids, n = grams(text)
        logp = self.logp[ids].astype(float)
        top = logp.max(axis=1)
        p = np.exp(logp - top[:, None])
        total = n.sum()
        cost = PENALTY * 0.5 * np.log(max(total, 2.0))
        alone = n @ logp
        chosen = [int(alone.argmax())]
        best, shares = float(alone[chosen[0]] - n @ top), np.ones(1)
        while len(chosen) < len(self.languages):
            rivals = [k for k in range(len(self.languages)) if k not in chosen]
            fits = [(*em(p[:, [*chosen, k]], n), k) for k in rivals]
            fit, pi, k = max(fits, key=lambda f: (f[0], -f[2]))
            if fit - best <= cost:
                break
            chosen, best, shares = [*chosen, k], fit, pi
        return {self.languages[k]: float(s) for k, s in zip(chosen, shares, strict=True)}

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the largest share, of equals the first by code point; 'und' and 0 if there is none."""
        shares = self.proportions(text)
        if not shares:
            return UNKNOWN, 0.0
        lang = min(shares, key=lambda k: (-shares[k], k))
        return lang, min(1.0, shares[lang])


def em(p: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions of a mixture with the columns of ``p``, for trigrams with counts ``n``."""
    pi = np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(ROUNDS):
        weight = n / np.maximum(p @ pi, 1e-300)
        pi = pi * (weight @ p)
        pi /= pi.sum()
    return float(n @ np.log(np.maximum(p @ pi, 1e-300))), pi


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from (doc_id, text, lang) rows: of each language about ``sample`` rows, those with hashed ids below a share of all hashes.

    Rows without an id are told apart by their texts. Rows without text or lang are left out.
    The counts are summed by language and trigram on the executors, so the driver gets 2^BITS
    rows a language at most.
    """
    known = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).limit(MAX_LANGUAGES + 1).collect()
    languages = sorted(r["lang"] for r in sizes)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)))
    below = pa.array([int(min(1.0, sample / r["rows"]) * (1 << 31)) for r in sizes], pa.int64())
    shares = known.sparkSession.createDataFrame(pa.table({"of": pa.array([r["lang"] for r in sizes], pa.string()), "below": below}))  # a list of rows would start Python workers of another kind
    named = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    picked = known.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(F.pmod(named, F.lit(1 << 31)) < F.col("below"))  # MAX_LANGUAGES rows
    texts = picked.select("text", "lang")
    rows = texts.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), 1 << BITS))
    place = {k: i for i, k in enumerate(languages)}
    counts[[place[k] for k in rows["lang"].to_pylist()], rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; other columns are ignored.

    Null texts and texts without a letter get 'und' and score 0. The score is the share of
    the predicted language in the mixture.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES * 2^BITS floats at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a known language of share ``least`` or more; the columns of ``docs``, whatever their names, order kept within batches.

    Null texts and texts without a letter go, as nothing tells their language; of repeated
    rows all stay or all go. An empty table, or a model without a language, gives no row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = nested(docs, "text").select("row", F.col("text").cast("string").alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.predict(t.as_py()) for t in batch.column(1)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return rows.mapInArrow(keep, rows.schema).select("row.*")
