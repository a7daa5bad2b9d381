"""Phrase collocation mining by suffix sorting.

Every word of a piece of text starts a suffix of at most ``max_n`` words. Suffixes are added up
where they arise, shuffled by language and first word, sorted in reverse lexicographic order,
and all their prefixes counted in one pass with one stack: when a prefix ends, its count is
complete and is added to the next shorter one. The parts of a phrase are joined afterwards.

A first word, or a pair of words, that starts more than a 1/SHARE of a sample's suffixes is
dealt out by one word more. Its own count is then in pieces, which are added up; the counts of
the longer phrases are whole as before.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import own, stored

MAX_N = 3
LEAST = 10
TOP = 2000
COVERED = 50
SHARE = 500
#: Documents of the sample that tells hot first words; it moves work between tasks and no count.
SAMPLE = 2000
#: Words whose suffixes a worker adds up at a time.
FLUSH = 1 << 21
SALTS = 32

_KIND = np.zeros(256, np.int8)  # 0: part of a word, 1: blank, 2: end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts in order, the row of each, and the number of its piece, which no other row shares."""
    rows = len(texts)
    binary = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + rows + 1]
    data = binary.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _KIND[raw]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    at_rows = ends[:-1][ends[:-1] < len(raw)]
    first[at_rows] = word[at_rows]  # a text starts a word whatever stands before it
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(ends, starts, "right") - 1
    breaks = np.flatnonzero(kind == 2)
    piece = np.searchsorted(breaks, starts) + row
    between = np.empty(2 * len(starts) + 1, np.int64)  # words and what lies between them, in turn
    between[:-1:2], between[1::2], between[-1] = starts, stops, len(raw)
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, 2 * len(starts)), [None, pa.py_buffer(between), pa.py_buffer(_LOWER[raw])])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2))).cast(pa.binary()), row, piece


def _counted(words: pa.Array, lang: np.ndarray, piece: np.ndarray, langs: list[str], n: int, max_n: int, hot: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Suffixes that start at the first ``n`` of ``words``, added up: (suffix, deal, count).

    A suffix is its language and words, each with a blank behind it; ``deal`` says by how many
    of its words it is dealt out.
    """
    encoded = words.dictionary_encode()
    vocabulary, ids = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(vocabulary) + 1
    if size ** max_n >= 1 << 62:  # too many different words for one number a suffix
        half = n // 2
        if not half:
            raise ValueError("max_n is too large for one number a suffix")
        for a, b in ((0, half), (half, n)):
            to = min(len(words), b + max_n - 1)
            yield from _counted(words.slice(a, to - a), lang[a:to], piece[a:to], langs, b - a, max_n, hot)
        return
    for code in np.unique(lang[:n]):
        at = np.flatnonzero(lang[:n] == code)
        key, cut = ids[at] + 1, np.zeros(len(at), bool)
        for k in range(1, max_n):
            after = np.minimum(at + k, len(words) - 1)
            cut |= (at + k >= len(words)) | (piece[after] != piece[at])
            key = key * size + np.where(cut, 0, ids[after] + 1)
        key, count = np.unique(key, return_counts=True)
        parts, rest = [], key
        for _ in range(max_n):
            parts.insert(0, rest % size)
            rest = rest // size
        name = quote(langs[code], safe="")
        deal = np.ones(len(key), np.int8)
        for prefix in (p for p in hot if p.partition(" ")[0] == name):
            of = [pc.index(vocabulary, pa.scalar(w.encode("utf-8", "surrogatepass"), pa.binary())).as_py() for w in prefix.split(" ")[1:]]
            if min(of) >= 0:
                lo = hi = 0
                for k in range(max_n):
                    lo, hi = lo * size + (of[k] + 1 if k < len(of) else 0), hi * size + (of[k] + 1 if k < len(of) else size - 1)
                inside = slice(np.searchsorted(key, lo), np.searchsorted(key, hi, "right"))
                deal[inside] = np.maximum(deal[inside], len(of) + 1)
        for a in range(0, len(key), 100_000):
            some = slice(a, a + 100_000)
            columns = [vocabulary.take(pa.array(p[some] - 1, mask=p[some] == 0)) for p in parts]
            suffix = pc.binary_join_element_wise(pa.scalar(name.encode(), pa.binary()), *columns, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()), null_handling="skip")
            yield pa.RecordBatch.from_arrays([suffix.cast(pa.string()), pa.array(deal[some]), pa.array(count[some])], names=["suffix", "deal", "count"])


def _suffixes(batches: Iterator[pa.RecordBatch], max_n: int, hot: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The suffixes of all texts; a flush takes whole texts, so memory is that of FLUSH words and one text."""
    held, size = [], 0

    def flush():
        texts = pa.Table.from_batches(held).combine_chunks()
        words, row, piece = _words(texts["text"].chunk(0) if texts.num_rows else pa.array([], pa.string()))
        encoded = texts["lang"].combine_chunks().dictionary_encode()
        lang = encoded.indices.to_numpy(zero_copy_only=False)[row]
        langs = encoded.dictionary.to_pylist()
        for a in range(0, len(words), FLUSH):
            b = min(a + FLUSH, len(words))
            to = min(len(words), b + max_n - 1)
            yield from _counted(words.slice(a, to - a), lang[a:to], piece[a:to], langs, b - a, max_n, hot)

    for b in batches:
        for at in range(0, b.num_rows, 200):
            some = b.slice(at, 200)
            held.append(some)
            size += pc.sum(pc.binary_length(some["text"])).as_py() or 0
            if size > 6 * FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


#: Bytes of a suffix that are compared for all rows at once.
WIDTH = 48


def _shared(raw: np.ndarray, ends: np.ndarray, last: bytes) -> np.ndarray:
    """How many first bytes each of the strings in ``raw`` has in common with the one before it, the first with ``last``."""
    sizes = np.diff(ends)
    width = int(min(max(sizes.max(initial=0), len(last)), WIDTH))
    at = ends[:-1, None] + np.arange(width)
    padded = np.zeros((len(sizes) + 1, width), np.uint8)
    padded[0, : len(last[:width])] = np.frombuffer(last[:width], np.uint8)
    padded[1:] = np.where(at < ends[1:, None], raw[np.minimum(at, len(raw) - 1)], 0)
    other = padded[1:] != padded[:-1]
    found = np.where(other.any(1), other.argmax(1), width) if width else np.zeros(len(sizes), np.int64)
    for i in np.flatnonzero((found == width) & (sizes > width)):
        one, two = (bytes(raw[ends[i - 1] : ends[i]]) if i else last), bytes(raw[ends[i] : ends[i + 1]])
        found[i] = next((k for k, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
    return found


def _stacked(batches: Iterator[pa.RecordBatch], max_n: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of sorted suffixes: (key, n_words, count), n_words 0 for a language.

    The stack holds the prefixes of the last suffix with what has been counted of each; one that
    the next suffix does not share is complete and leaves it. Prefixes that begin and end in one
    batch are summed as runs. Prefixes that are not dealt out further are whole and pass only
    from ``least`` on; the others pass as they are, to be added up.
    """
    stack: list[tuple[str, int, bool] | None] = [None] * (max_n + 1)  # prefix, count so far, whether it passes anyway
    last = b""
    for b in batches:
        for at in range(0, b.num_rows, 20_000):
            some = b.slice(at, 20_000)
            text = some["suffix"].cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            count, deal = some["count"].to_numpy(), some["deal"].to_numpy()
            blanks = np.flatnonzero(raw == 0x20)
            first = np.searchsorted(blanks, ends[:-1])
            levels = np.append(first[1:], len(blanks)) - first
            shared = _shared(raw, ends, last)
            last = bytes(raw[ends[-2] : ends[-1]])
            out: list[tuple[str, int, int]] = []
            for k in range(max_n + 1):
                has = np.flatnonzero(levels > k)
                if not len(has):
                    continue
                size = blanks[first[has] + k] - ends[has]  # of the prefix, without the blank behind it
                new = np.flatnonzero(shared[has] <= size)
                sums = np.add.reduceat(count[has], new) if len(new) else np.zeros(0, np.int64)
                before = int(count[has[: new[0]]].sum()) if len(new) else int(count[has].sum())
                held = stack[k]
                if held and before:
                    held = stack[k] = (held[0], held[1] + before, held[2])
                if not len(new):
                    continue
                if held and (held[1] >= least or held[2]):
                    out.append((held[0], k, held[1]))
                prefix = lambda g: bytes(raw[ends[has[new[g]]] : ends[has[new[g]]] + size[new[g]]]).decode()  # noqa: B023, E731
                done = (sums >= least) | (deal[has[new]] > k)
                out += [(prefix(g), k, int(sums[g])) for g in np.flatnonzero(done[:-1])]
                stack[k] = (prefix(-1), int(sums[-1]), bool(deal[has[new[-1]]] > k))
            if out:
                yield _phrases(out)
    rest = [(held[0], k, held[1]) for k, held in enumerate(stack) if held and (held[1] >= least or held[2])]
    if rest:
        yield _phrases(rest)


def _phrases(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "n_words", "count"])


def _hot(docs: DataFrame, rows: int, max_n: int) -> dict[str, int]:
    """Prefixes of fewer than max_n words that start more than a 1/SHARE of the suffixes of about SAMPLE documents: at most SHARE of each length."""
    sample = docs if rows <= SAMPLE else docs.where(F.rand(17) < SAMPLE / rows)
    suffixes = stored(sample.mapInArrow(lambda b: _suffixes(b, max_n, {}), "suffix string, deal byte, count long"))
    total = suffixes.agg(F.sum("count")).first()[0] or 0
    found = {}
    for k in range(1, max_n):
        prefix = F.substring_index("suffix", " ", k + 1)
        named = suffixes.where(F.size(F.split("suffix", " ")) > k + 1).groupBy(prefix.alias("prefix")).agg(F.sum("count").alias("n")).where(F.col("n") > total / SHARE)
        found |= {r.prefix: r.n for r in named.collect()}
    return found


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n_words, count) of every phrase of up to ``max_n`` words found ``least`` times or more in its language, as a table; with n_words 0 and phrase '' the number of all words of a language.

    ASCII capitals are lowered; pieces end at ``.,;:!?`` and line ends, words at blanks and
    tabs. A null text is empty, a null lang is ``und``. Other columns are ignored. An empty
    table gives no row. Overlapping occurrences count. A text is held whole by one worker.
    """
    texts = docs.select(F.coalesce(own(docs, "lang"), F.lit("und")).alias("lang"), F.coalesce(own(docs, "text"), F.lit("")).alias("text"))
    hot = _hot(texts, texts.count(), max_n)
    suffixes = texts.mapInArrow(lambda b: _suffixes(b, max_n, hot), "suffix string, deal byte, count long")
    dealt = suffixes.repartition(F.expr("substring_index(suffix, ' ', 1 + deal)")).sortWithinPartitions(F.col("suffix").desc())
    counted = dealt.mapInArrow(lambda b: _stacked(b, max_n, least), "key string, n_words int, count long")
    whole = counted.groupBy("key", "n_words").agg(F.sum("count").alias("count")).where((F.col("count") >= least) | (F.col("n_words") == 0))
    name = F.url_decode(F.replace(F.substring_index("key", " ", 1), F.lit("+"), F.lit("%2B")))
    phrase = F.when(F.col("n_words") == 0, "").otherwise(F.expr("substring(key, locate(' ', key) + 1)"))
    return stored(whole.select(name.alias("lang"), phrase.alias("phrase"), "n_words", "count"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two words and more of each language.

    A phrase found a times has for each cut into two parts, found l and r times, the score
    floor(10^6 a a / (l r)); its lowest counts, of equal ones the first cut's. Phrases inside a
    longer candidate found at least ``covered`` hundredths as often go. Ties in score and a go
    by the bytes of the phrase. Products are decimals of 38 digits. A part of a candidate is
    found as often as the candidate at least, so every part is in the table. See
    phrase_counts() for odd rows.
    """
    counts = phrase_counts(docs, max_n, least)
    whole = F.col("count")
    candidates = counts.where("n_words >= 2").select("lang", "phrase", "n_words", whole.alias("a"))
    words = F.split("phrase", " ")
    spans = [(at, k) for k in range(2, max_n) for at in range(max_n - k + 1)]
    inside = F.filter(F.array(*[F.when((F.col("n_words") > k) & (F.col("n_words") >= at + k), F.array_join(F.slice(words, at + 1, k), " ")) for at, k in spans]), lambda p: p.isNotNull()) if spans else F.array().cast("array<string>")
    longer = candidates.select(F.col("lang").alias("in_lang"), F.explode(inside).alias("part"), "a").groupBy("in_lang", "part").agg(F.max("a").alias("most"))
    kept = candidates.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")), "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * covered)).select("lang", "phrase", "n_words", "a")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")).select("*", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"), F.expr("array_join(slice(split(phrase, ' '), k + 1, n_words - k), ' ')").alias("right"))
    parts = counts.where(f"n_words between 1 and {max_n - 1}")
    of = lambda side, name: parts.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), whole.alias(name))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(of(side, name), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(side) == F.col(f"{name}_phrase")))
    wide = "decimal(38,0)"
    a = F.col("a").cast("decimal(15,0)")
    score = F.expr("(a2 * cast(1000000 as decimal(7,0))) div lr")
    scored = cuts.select("lang", "phrase", "a", "k", "l", "r", (a * a).alias("a2"), (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast(wide).alias("lr"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", score.alias("score")), F.struct(score, F.col("k"))).alias("best")).select("lang", "phrase", "best.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("n_words = 0").select(F.col("lang").alias("all_lang"), whole.alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("all_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
