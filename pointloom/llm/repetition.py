"""Quality rules on repetition, from suffix arrays over words.

The words of many texts are put into one sequence, each numbered apart by its document, so
no match leaves a text. Prefix doubling sorts the suffixes; only suffixes that are still
tied are sorted again. Longest common prefixes of neighbours come from the ranks of the
doubling rounds. Substrings are runs of whole words: the deepest longest-common-prefix
interval that holds a suffix has the larger of the two neighbouring prefixes as its value,
which is the length of the longest repeat that begins there; the spans so marked, of
``MIN_WORDS`` words and more, are those of the maximal repeated substrings. Their union
gives the covered share of characters, the largest value the longest repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import slices

MIN_WORDS = 5
MAX_COVERED = 0.2
#: Longest repeat that is let pass, in words. A share of the text may be let pass if that is more; none is by default,
#: as the base rule already bounds a repeat to half of MAX_REPEAT_PERCENT of the text.
MAX_LONGEST = 50
MAX_LONGEST_SHARE = 0.0
#: Rules on the text itself: fewest words, most percent of words in repeated windows.
LEAST_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words sorted at once; a longer text is sorted alone.
TOGETHER = 1 << 18

_SYMBOLS = re.compile(r"[#*$%&|<>]")


def suffix_repeats(symbols: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each place the length of the longest run that begins there and occurs twice within its document.

    ``symbols`` are whole numbers, ``docs`` ascending document numbers.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    _, first = np.unique(symbols, return_inverse=True)
    key = docs.astype(np.int64) * (int(first.max()) + 1) + first
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head  # rank: place of the first suffix of its tie
    rounds, width = [rank.astype(np.int32)], 1
    end = np.append(np.flatnonzero(docs[1:] != docs[:-1]) + 1, n)
    end_of = end[np.searchsorted(end, np.arange(n), side="right")]
    while True:
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        after = at + width
        second = np.where(after < end_of[at], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((second, head[tied]))
        order[tied] = at[by]
        group, second = head[tied][by], second[by]
        new = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
        fresh[tied] = new
        head[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = head[tied]
        rounds.append(rank.astype(np.int32))
        width *= 2
    # neighbours' common prefixes: from the widest round down, jump where both are tied
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    open_ = np.flatnonzero(rounds[0][a] == rounds[0][b])
    a, b, got = a[open_], b[open_], np.zeros(len(open_), np.int64)
    ea, eb = end_of[a], end_of[b]
    for k in range(len(rounds) - 1, -1, -1):
        x, y = a + got, b + got
        inside = (x < ea) & (y < eb)
        same = inside & (rounds[k][np.minimum(x, n - 1)] == rounds[k][np.minimum(y, n - 1)])
        got += same * (1 << k)
    common[open_] = got
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Places within the union of the spans of ``least`` words and more."""
    change = np.zeros(len(longest) + 1, np.int64)
    starts = np.flatnonzero(longest >= least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + longest[starts], -1)
    return np.cumsum(change[:-1]) > 0


def _windows(longest: np.ndarray, width: int) -> np.ndarray:
    """Places within windows of ``width`` words found twice or more."""
    change = np.zeros(len(longest) + width, np.int64)
    starts = np.flatnonzero(longest >= width)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[: len(longest)]) > 0


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered double, longest_repeat long"


def measured(texts: list[str | None]) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest_repeat of each text."""
    out: list[tuple] = [()] * len(texts)
    held: list[tuple[int, list[bytes]]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        numbers: dict[bytes, int] = {}
        for_all = [numbers.setdefault(w, len(numbers)) for _, words in held for w in words]
        lengths = [len(words) for _, words in held]
        docs = np.repeat(np.arange(len(held)), lengths)
        longest = suffix_repeats(np.array(for_all, np.int64), docs)
        at = 0
        for (k, words), n in zip(held, lengths, strict=True):
            own, at = longest[at : at + n], at + n
            chars = np.array([len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in words], np.int64)
            top = int(own.max()) if n else 0
            if top >= MIN_WORDS:
                share, repeats = float(chars[_covered(own, MIN_WORDS)].sum() / chars.sum()), int(_windows(own, 5).sum())
            else:
                share, repeats = 0.0, 0
            text = texts[k]
            out[k] = (n, int(chars.sum()), len(_SYMBOLS.findall(text)), _dup_lines(text), repeats, share, top)
        held, size = [], 0

    for k, text in enumerate(texts):
        if text is None:
            out[k] = (0, 0, 0, 0, 0, 0.0, 0)
            continue
        words = text.encode("utf-8", "replace").split()
        if held and size + len(words) > TOGETHER:
            flush()
        held.append((k, words))
        size += len(words)
    if held:
        flush()
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for b in slices(batches):
        found = measured(b.column(1).to_pylist())
        columns = list(zip(*found, strict=True)) if found else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)


def repetition(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, max_share: float = MAX_LONGEST_SHARE) -> DataFrame:
    """For every row of ``docs``: doc_id, the measures, base_failed and kept; other columns are ignored.

    covered is the share of word characters in repeats of MIN_WORDS words and more,
    longest_repeat the words of the longest repeat. A text is kept if it passes the base
    rules, covered is at most ``max_covered`` and longest_repeat at most ``max_longest``
    words, whatever the length of the text, or ``max_share`` of it if that is more. Null and empty texts have no words and fail.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, FIELDS)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = (F.col("covered") <= max_covered) & (F.col("longest_repeat") <= F.greatest(F.lit(float(max_longest)), F.col("n_words") * max_share))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"), "covered", "longest_repeat"
    )
