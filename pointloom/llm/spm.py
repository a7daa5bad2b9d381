"""SentencePiece encoding and decoding with byte pairs, with a max-plus parallel scan for giant documents.

The model file is only read. Its encoder joins neighbouring symbols, those whose joined piece
has the highest score first and of equals the leftmost, until no two neighbours join to a
piece. Two neighbours a, b of the result fit: encoded by themselves, a + b gives a and b
again, as joins within them never looked beyond. The other way round a row of pieces whose
neighbours all fit is the encoding: the first join across two of them would also come first
in those two by themselves. So in the lattice of all pieces in a text, where a path may go
from a piece to those that fit it, one path leads from end to end, and it is the encoding.

A giant document is split into chunks. The state at a boundary is the piece that ends there
or crosses it, told by its length and how far it reaches into the next chunk. A chunk's
transfer matrix holds, for each state on entry and each on exit, the largest sum of scores
of fitting pieces that begin in the chunk, and nothing where no path leads. Matrices are
combined in the max-plus semiring, which is associative: the states of all chunks follow
from a scan over the matrices, without any text. Each chunk then backtraces by itself from
its own two states. As the path is one, the ids are those of the whole text in one go.

Where no piece holds the two characters next to a position, every path passes through it,
so a matrix is a column and a row around the text between its first and last such cuts. A
boundary at a cut has one state. Parts between cuts are encoded by joining, words seen
before are looked up.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from weakref import WeakKeyDictionary, proxy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import slices, stored

SPACE = "▁"
#: Texts of more characters are encoded by the parallel scan, in chunks of so many.
GIANT = 1 << 16
CHUNK = 1 << 14
MEMO = 150_000
#: Characters of text whose words are looked up together.
TOGETHER = 1_000_000
#: Parts of up to so many characters are joined together and remembered.
SHORT = 64
#: The score of an unknown character lies so far below the smallest score.
UNKNOWN_BELOW = 10
#: The state of a boundary that is a cut; others are characters beyond the boundary * SPAN + length of the piece.
CUT = 0
SPAN = 1 << 12
#: Rank of a pair that joins to no piece, and the key of an empty place in the table of pairs.
NEVER = np.iinfo(np.int32).max
EMPTY = -(1 << 62)
PLACES = 20

State = int
Matrix = dict[State, dict[State, float]]


class _Words(dict):
    """Encoded words behind a given mark; when full, forgets those that the texts at hand don't use."""

    def __init__(self, vocabulary: Vocabulary, mark: str):
        super().__init__()
        self.vocabulary, self.mark = proxy(vocabulary), mark  # no cycle, so that both go at once

    def __missing__(self, word: str) -> bytes:
        found = self.vocabulary.joined_part(self.mark + word)
        if len(word) < SHORT:
            if len(self) > MEMO:
                self.clear()
            self[word] = found
        return found


class _Pairs:
    """Symbol pairs that join, in an open table: (left, right) -> the symbol of the joined piece, -1 if there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray, symbols: int):
        self.symbols = symbols
        bits = max(PLACES, int(len(left)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, EMPTY, np.int64), np.full(1 << bits, -1, np.int32)
        keys = left.astype(np.int64) * symbols + right
        at = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == EMPTY)
            _, one = np.unique(at[free], return_index=True)
            took = free[one]
            self.keys[at[took]], self.values[at[took]] = keys[took], joined[took]
            rest = np.setdiff1d(np.arange(len(keys)), took)
            keys, joined, at = keys[rest], joined[rest], (at[rest] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.symbols + right
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        far = np.flatnonzero((there != keys) & (there != EMPTY))
        keys, at = keys.ravel(), at.ravel()
        while len(far):
            at[far] = (at[far] + 1) & self.mask
            there = self.keys[at[far]]
            hit = far[there == keys[far]]
            out.ravel()[hit] = self.values[at[hit]]
            far = far[(there != keys[far]) & (there != EMPTY)]
        return out


class Vocabulary:
    """The pieces of a model file, how they join, and which neighbours no piece holds.

    The file must be of the byte-pair type, without user-defined pieces, and leave texts as
    they are but for spaces; others raise a ValueError.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or any(p.type == 4 for p in proto.pieces):
            raise ValueError("not a byte-pair model without user-defined pieces")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model changes texts before it encodes them")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]  # 1 normal, 2 unknown, 3 control, 6 byte
        self.numbers = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = [p.score for p in proto.pieces]
        self.ranks = {p: -self.scores[i] for p, i in self.numbers.items()}
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = min(self.scores[i] for i in self.numbers.values()) - UNKNOWN_BELOW
        self.longest = max(map(len, self.numbers))
        self.joined = {p[i : i + 2] for p in self.numbers for i in range(len(p) - 1)}
        self.prefix = spec.add_dummy_prefix
        #: Whether every change from another character to a space mark is a cut.
        self.word_cuts = not any(p[1] == SPACE and p[0] != SPACE for p in self.joined)
        #: A part lies between cuts: a word with the marks before it, marks alone, or one character that no piece holds.
        known = "".join(map(re.escape, sorted({c for p in self.numbers for c in p} - {SPACE})))
        self._part = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]", re.DOTALL) if self.word_cuts else None
        #: Whether a line end is a character that no piece holds, and so a part by itself.
        self.line_cuts = self.word_cuts and not any("\n" in p for p in self.numbers)
        self.memo: dict[str, bytes] = {}
        #: The score of each id; of an unknown character's bytes the first one's stands for all.
        self.score_of = np.array(self.scores)
        for b, i in self.bytes_.items():
            self.score_of[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        if not self.bytes_ and 2 in self.kinds:
            self.score_of[self.kinds.index(2)] = self.unknown
        self._words = (_Words(self, SPACE), _Words(self, ""))
        self._pairs: _Pairs | None = None
        self._fits: dict[tuple[str, str], bool] = {}
        code = lambda b: chr(b) if b < 128 else chr(0xDC00 + b)
        self.shown = np.array([p.piece if p.type == 1 else code(int(p.piece[3:5], 16)) if p.type == 6 else "" for p in proto.pieces], object)
        self._escaped = re.compile("[\udc80-\udcff]")

    def marked(self, text: str) -> str:
        marked = text.replace(" ", SPACE)
        return SPACE + marked if self.prefix and marked else marked

    # -- joining -------------------------------------------------------------------------

    def join(self, text: str) -> list[str]:
        """The pieces, and characters that are none, of a text: joins by score, of equals the leftmost, from a heap."""
        n, ranks, heap = len(text), self.ranks, []
        part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(a: int) -> None:
            if after[a] < n:
                rank = ranks.get(part[a] + part[after[a]])
                if rank is not None:
                    heappush(heap, (rank, a, part[a], part[after[a]]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, left, right = heappop(heap)
            b = after[a]
            if part[a] != left or b >= n or part[b] != right:
                continue  # one of them has joined another since
            part[a], part[b] = left + right, ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in part if p]

    def joined_part(self, text: str) -> bytes:
        """Ids (32-bit numbers) of a text, joined by itself."""
        return array("i", self.emit(self.join(text))).tobytes()

    def ids_of(self, parts: list[bytes]) -> tuple[np.ndarray, float]:
        """The ids of some parts, one after the other, and their score."""
        ids = np.frombuffer(b"".join(parts), "<i4")
        return ids, float(self.score_of[ids].sum())

    def emit(self, parts: list[str]) -> list[int]:
        """Ids of pieces; a character that is none becomes its bytes, or the unknown id."""
        out: list[int] = []
        for p in parts:
            i = self.numbers.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes_:
                out.extend(self.bytes_[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(self.kinds.index(2))
        return out

    def _layout(self) -> None:
        """Symbols as numbers: a piece's id, more for characters that only stand within pieces, -1 for all others."""
        size = len(self.pieces)
        symbols = dict(self.numbers)
        for c in sorted({c for p in self.numbers for c in p} - symbols.keys()):
            symbols[c] = size + len(symbols) - len(self.numbers)
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        splits = [(symbols[p[:k]], symbols[p[k:]], i) for p, i in self.numbers.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        left, right, joined = np.array(splits, np.int32).reshape(-1, 3).T
        order = {r: k for k, r in enumerate(sorted(set(self.ranks.values())))}
        self.rank_of = np.full(size, NEVER, np.int32)
        for p, i in self.numbers.items():
            self.rank_of[i] = order[self.ranks[p]]
        self._pairs = _Pairs(left, right, joined, size + len(symbols))

    def join_many(self, parts: list[str]) -> list[bytes]:
        """joined_part() of many parts: those of one length join together, one pair of each at a time."""
        if self._pairs is None:
            self._layout()
        out: list = [None] * len(parts)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            by_length.setdefault(len(p), []).append(k)
        for length, members in by_length.items():
            if not 0 < length <= SHORT:
                for k in members:
                    out[k] = self.joined_part(parts[k])
                continue
            raw = np.frombuffer("".join(parts[k] for k in members).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(members), length)
            symbols, rows = self.symbol[raw], np.array(members)
            joined, ranks = self._offers(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                every, width = np.arange(len(rows)), symbols.shape[1]
                at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
                going = ranks[every, at] < NEVER if width > 1 else np.zeros(len(rows), bool)
                done = np.flatnonzero(~going)
                if len(done):
                    self._finish(parts, rows[done], symbols[done], out)
                    rows, symbols, joined, ranks, at = rows[going], symbols[going], joined[going], ranks[going], at[going]
                    every = np.arange(len(rows))
                if not len(rows):
                    break
                new = joined[every, at]
                behind = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
                symbols = np.take_along_axis(symbols, behind, 1)
                symbols[every, at] = new
                joined, ranks = np.take_along_axis(joined, behind[:, : width - 2], 1), np.take_along_axis(ranks, behind[:, : width - 2], 1)
                for k in (at - 1, at):  # the two pairs that the new symbol is in
                    of = np.flatnonzero((k >= 0) & (k < width - 2))
                    joined[of, k[of]], ranks[of, k[of]] = self._offers(symbols[of, k[of]], symbols[of, k[of] + 1])
        return out

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self._pairs.find(left, right)
        return found, np.where(found >= 0, self.rank_of[found], NEVER)

    def _finish(self, parts: list[str], rows: np.ndarray, symbols: np.ndarray, out: list) -> None:
        """Ids of rows of as many symbols each, into ``out``."""
        strange = ((symbols < 0) | (symbols >= len(self.pieces))).any(axis=1)
        raw, step = symbols.astype("<i4").tobytes(), 4 * symbols.shape[1]
        for n, (k, odd) in enumerate(zip(rows.tolist(), strange.tolist(), strict=True)):
            out[k] = self.joined_part(parts[k]) if odd else raw[n * step : (n + 1) * step]

    # -- whole texts ---------------------------------------------------------------------

    def prepare(self, texts: list[str | None]) -> None:
        """Join all new words of some texts together."""
        if not self.line_cuts or not self.prefix:
            return
        met: tuple[set[str], set[str]] = (set(), set())
        for text in texts:
            for n, line in enumerate((text or "").split("\n")):
                words = line.split(" ")
                met[0].update(words[1:])
                met[min(n, 1)].add(words[0])
        for words, memo in zip(met, self._words, strict=True):
            words.discard("")
            new = [w for w in words if w not in memo]
            if len(memo) + len(new) > MEMO:
                used = {w: memo[w] for w in words if w in memo}  # what is common stays, words met once go
                memo.clear()
                memo.update(used)
            memo.update(zip(new, self.join_many([memo.mark + w for w in new]), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        """encode() of many texts; words are looked up for some millions of characters at a time."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > TOGETHER:
                self.prepare(held)
                out += map(self.encode, held)
                held, size = [], 0
        self.prepare(held)
        return [*out, *map(self.encode, held)]

    def best(self, part: str) -> bytes:
        """joined_part(), remembered if the part is short."""
        found = self.memo.get(part)
        if found is None:
            found = self.joined_part(part)
            if len(part) <= SHORT:
                if len(self.memo) > MEMO // 4:
                    self.memo.clear()
                self.memo[part] = found
        return found

    def paths(self, text: str) -> list[bytes]:
        """Ids of each part between cuts."""
        return list(map(self.best, self._part.findall(text) if self._part else [text]))

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        """Ids and score of a text in one go; none for null."""
        text = text or ""
        if not self.line_cuts or SPACE in text or not self.prefix:
            found = self.paths(self.marked(text))
        else:
            found, after = [], self._words[0]
            for n, line in enumerate(text.split("\n") if text else ()):
                if n:
                    found.append(self.best("\n"))
                if "  " in line or line[:1] == " " or line[-1:] == " ":
                    found += self.paths((SPACE if not n else "") + line.replace(" ", SPACE))
                    continue
                words = line.split(" ")
                if words[0]:
                    found.append(self._words[min(n, 1)][words[0]])
                elif not n:
                    found.append(self.best(SPACE))
                found += map(after.__getitem__, words[1:])
        return self.ids_of(found)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined, space marks become spaces, the dummy prefix goes."""
        # a byte above 127 stands as its surrogate until its neighbours are known
        text = "".join(self.shown[np.asarray(ids, np.int64)].tolist())
        if self._escaped.search(text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # -- the parallel scan ---------------------------------------------------------------

    def cut(self, text: str, at: int) -> bool:
        """Whether no piece holds the characters on both sides of a place, or there are none."""
        return at <= 0 or at >= len(text) or text[at - 1 : at + 1] not in self.joined

    def fit(self, left: str, right: str) -> bool:
        """Whether two pieces, encoded by themselves, stay as they are; a left one of '' asks for the right one alone."""
        found = self._fits.get((left, right))
        if found is None:
            found = self.join(left + right) == ([left, right] if left else [right])
            if len(self._fits) > MEMO:
                self._fits.clear()
            self._fits[left, right] = found
        return found

    def starts(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """(length, score) of the pieces, or of the lone character, that begin at a place."""
        for size in range(1, min(self.longest, len(text) - at) + 1):
            i = self.numbers.get(text[at : at + size])
            if i is not None:
                yield size, self.scores[i]
            elif size == 1:
                yield size, self.unknown

    def reach(self, text: str, start: int, before: int, end: int) -> dict[tuple[int, int], tuple[float, tuple[int, int] | None]]:
        """(place, length of the piece that ends there) -> (best score, the one before), over fitting paths from a place to ``end`` and beyond it.

        ``before`` is the length of the piece that ends at the start, 0 if any may follow.
        Pieces begin before ``end``.
        """
        found: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {(start, before): (0.0, None)}
        lengths = {start: [before]}
        for at in range(start, end):
            if at not in lengths:
                continue
            free = self.cut(text, at)
            for size, score in self.starts(text, at):
                piece, to = text[at : at + size], (at + size, size)
                if not self.fit("", piece):
                    continue
                for last in lengths[at]:
                    if free or not last or self.fit(text[at - last : at], piece):
                        total = found[at, last][0] + score
                        if to not in found:
                            lengths.setdefault(at + size, []).append(size)
                        if to not in found or total > found[to][0]:
                            found[to] = (total, (at, last))
        return found

    def entries(self, text: str, at: int) -> list[tuple[State, int, int]]:
        """The states of a boundary: (state, place where the piece ends, its length); a cut has one, of length 0."""
        if self.cut(text, at):
            return [(CUT, at, 0)]
        found = []
        for over in range(min(self.longest, len(text) - at + 1)):
            for size in range(over + 1, min(self.longest, at + over) + 1):
                piece = text[at + over - size : at + over]
                if (size == 1 or piece in self.numbers) and self.fit("", piece):
                    found.append((over * SPAN + size, at + over, size))
        return found

    def exits(self, text: str, end: int, found: dict) -> Iterator[tuple[State, float, tuple[int, int]]]:
        """(state, score, key) of what reach() found at a boundary or beyond it."""
        cut = self.cut(text, end)
        for (at, size), (score, _) in found.items():
            if at >= end and size > at - end and not (cut and at > end):
                yield CUT if cut else (at - end) * SPAN + size, score, (at, size)

    def inner(self, text: str, before: int, size: int) -> tuple[int | None, int]:
        """The first and the last cut within a chunk that begins at ``before``; None if there is none."""
        end = before + size
        first = next((at for at in range(before, end + 1) if self.cut(text, at)), None)
        return first, 0 if first is None else next(at for at in range(end, first - 1, -1) if self.cut(text, at))

    def transfer(self, text: str, before: int, size: int) -> Matrix:
        """Transfer matrix of a chunk: state on entry -> state on exit -> best score of fitting pieces that begin in the chunk.

        ``text`` is the chunk of ``size`` characters with ``before`` characters in front of it
        and some behind it: longest and longest - 1, or as many as there are.
        """
        end = before + size
        first, last = self.inner(text, before, size)
        if first is None:
            return {state: row for state, at, length in self.entries(text, before) if (row := {s: score for s, score, _ in self.exits(text, end, self.reach(text, at, length, end))})}
        middle = self.ids_of(self.paths(text[first:last]))[1]
        right = {s: middle + score for s, score, _ in self.exits(text, end, self.reach(text, last, 0, end))} if last < end else {CUT: middle}
        out = {}
        for state, at, length in self.entries(text, before):
            left = max((score for (to, _), (score, _) in self.reach(text, at, length, first).items() if to == first), default=None) if at < first else 0.0
            if left is not None:
                out[state] = {s: left + score for s, score in right.items()}
        return out

    def _trace(self, text: str, found: dict, key: tuple[int, int] | None) -> list[int]:
        """Ids along a path of reach(), but for the piece that it began behind."""
        parts = []
        while key is not None and found[key][1] is not None:
            at, size = key
            parts.append(text[at - size : at])
            key = found[key][1]
        return self.emit(parts[::-1])

    def backtrace(self, text: str, before: int, size: int, entry: State, exit_: State) -> list[int]:
        """Ids of a chunk's best path from one state to the other; ``text`` as for transfer()."""
        end = before + size
        first, last = self.inner(text, before, size)
        at, length = next((at, length) for state, at, length in self.entries(text, before) if state == entry)
        if first is None:
            found = self.reach(text, at, length, end)
            return self._trace(text, found, next(key for s, _, key in self.exits(text, end, found) if s == exit_))
        ids: list[int] = []
        if at < first:
            found = self.reach(text, at, length, first)
            ids = self._trace(text, found, max((k for k in found if k[0] == first), key=lambda k: found[k][0]))
        ids += self.ids_of(self.paths(text[first:last]))[0].tolist()
        if last < end:
            found = self.reach(text, last, 0, end)
            ids += self._trace(text, found, next(key for s, _, key in self.exits(text, end, found) if s == exit_))
        return ids


def max_plus(left: Matrix, right: Matrix) -> Matrix:
    """The product of two transfer matrices: best score over the state between them."""
    out: Matrix = {}
    for a, row in left.items():
        best: dict[State, float] = {}
        for k, score in row.items():
            for b, more in right.get(k, {}).items():
                best[b] = max(best.get(b, score + more), score + more)
        if best:
            out[a] = best
    return out


def states(matrices: list[Matrix], entry: State, exit_: State) -> list[State]:
    """The states at the boundaries of neighbouring chunks, both ends included, on a best path."""
    reach, back = {entry: 0.0}, []
    for m in matrices:
        after: dict[State, float] = {}
        came: dict[State, State] = {}
        for a, score in reach.items():
            for b, more in m.get(a, {}).items():
                if b not in after or score + more > after[b]:
                    after[b], came[b] = score + more, a
        reach, back = after, [*back, came]
    found = [exit_]
    for came in reversed(back):
        found.append(came[found[-1]])
    return found[::-1]


# -- on DataFrames -----------------------------------------------------------------------


def load(spark, path: str) -> bytes:
    """The bytes of a model file; the driver's own folders first, else through Spark's readers."""
    if os.path.isfile(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


_VOCABULARIES: WeakKeyDictionary = WeakKeyDictionary()


def _vocabulary(held) -> Vocabulary:
    """One vocabulary, and so one memo, for each worker and broadcast model; it goes with the broadcast, at the worker's first task without it."""
    if held not in _VOCABULARIES:
        _VOCABULARIES[held] = Vocabulary(held.value)
    return _VOCABULARIES[held]


def encode_giants(texts: DataFrame, model: bytes, chunk: int = CHUNK, block: int = 64) -> DataFrame:
    """(key, text) of distinct keys -> (key, ids array<int>, score double), by the parallel scan.

    Chunks become transfer matrices, blocks of ``block`` chunks are combined to one matrix,
    a scan over a document's blocks gives their states, and within each block those of its
    chunks; then every chunk backtraces by itself. No task holds more than one chunk's
    text at a time, one block's matrices or one document's block matrices.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(model)  # a vocabulary file, no larger than its model
    vocabulary = Vocabulary(model)
    longest = vocabulary.longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                marked = mark(text.as_py())
                starts = range(0, len(marked), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key.as_py()] * len(some), pa.string()), pa.array([s // chunk for s in some], pa.int64()), pa.array([marked[max(0, s - longest) : s + chunk + longest - 1] for s in some], pa.string()),
                            pa.array([min(s, longest) for s in some], pa.int32()), pa.array([min(chunk, len(marked) - s) for s in some], pa.int32()),
                        ],
                        ["key", "c", "t", "before", "size"],
                    )

    dummy = vocabulary.prefix
    mark = lambda text: (SPACE if dummy and text else "") + text.replace(" ", SPACE)
    pieces = stored(texts.select("key", "text").mapInArrow(cut, "key string, c long, t string, before int, size int").repartition("key", "c"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(held)
        for b in slices(batches):
            found = [pickle.dumps(v.transfer(*row)) for row in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["key", "c", "m"])

    chunks = stored(pieces.select("key", "c", "t", "before", "size").mapInArrow(matrices, "key string, c long, m binary"))

    def combined(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["c"].to_pylist(), table["m"].to_pylist(), strict=True))
        whole = reduce(max_plus, (pickle.loads(m) for _, m in rows))
        return pa.table({"key": table["key"][:1], "b": pa.array([rows[0][0] // block], pa.int64()), "m": pa.array([pickle.dumps(whole)], pa.binary())})

    blocks = chunks.withColumn("b", F.floor(F.col("c") / block)).groupBy("key", "b").applyInArrow(combined, "key string, b long, m binary")

    def over_blocks(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["b"].to_pylist(), table["m"].to_pylist(), strict=True))
        found = states([pickle.loads(m) for _, m in rows], CUT, CUT)
        return pa.table({"key": pa.array([table["key"][0].as_py()] * len(rows)), "b": pa.array([b for b, _ in rows], pa.int64()), "s": pa.array(found[:-1], pa.int32()), "e": pa.array(found[1:], pa.int32())})

    ends = blocks.groupBy("key").applyInArrow(over_blocks, "key string, b long, s int, e int")

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(left["c"].to_pylist(), left["m"].to_pylist(), strict=True))
        loaded = [pickle.loads(m) for _, m in rows]
        found = states(loaded, right["s"][0].as_py(), right["e"][0].as_py())
        score = [float(m[a][b]) for m, a, b in zip(loaded, found[:-1], found[1:], strict=True)]
        return pa.table({"key": pa.array([left["key"][0].as_py()] * len(rows)), "c": pa.array([c for c, _ in rows], pa.int64()), "s": pa.array(found[:-1], pa.int32()), "e": pa.array(found[1:], pa.int32()), "score": pa.array(score, pa.float64())})

    known = chunks.withColumn("b", F.floor(F.col("c") / block)).groupBy("key", "b").cogroup(ends.groupBy("key", "b")).applyInArrow(within, "key string, c long, s int, e int, score double")

    def backtraced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(held)
        for b in slices(batches):
            ids = [v.backtrace(*row) for row in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), b.column(7)], ["key", "c", "ids", "score"])

    traced = pieces.join(known, ["key", "c"]).select("key", "c", "t", "before", "size", "s", "e", "score").mapInArrow(backtraced, "key string, c long, ids array<int>, score double")
    whole = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts"), F.sum("score").alias("score"))
    return whole.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), "score")


def _whole(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, text, ids, score), each text in one go."""
    v = _vocabulary(held)
    for b in slices(batches):
        found = v.encode_all(b.column(1).to_pylist())
        ends = np.cumsum([0, *(len(f[0]) for f in found)], dtype=np.int32)
        flat = np.concatenate([f[0] for f in found]) if found else np.empty(0, "<i4")
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=b.column(1).is_null())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, pa.array([float(f[1]) for f in found], pa.float64())], ["doc_id", "text", "ids", "score"])


def _digested(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ids, score) -> the row of digests()."""
    v = _vocabulary(held)
    md5 = lambda raw: hashlib.md5(raw, usedforsecurity=False).hexdigest()
    for b in slices(batches):
        out = []
        for text, ids in zip(b.column(1), b.column(2), strict=True):
            if not ids.is_valid:
                out.append((0, None, None, None))
                continue
            row = ids.values.to_numpy()
            decoded = v.decode(row)
            out.append((len(row), md5(row.astype("<i4").tobytes()), md5(decoded.encode()), decoded == text.as_py()))
        n, i, d, r = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string()), pa.array(r, pa.bool_()), b.column(3)],
            ["doc_id", "n_tokens", "ids_md5", "decoded_md5", "round_trip", "score"],
        )


def _verified(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ids, score) -> the row of tokenised()."""
    v = _vocabulary(held)
    for b in slices(batches):
        coded = [(len(ids.values), v.decode(ids.values.to_numpy()) == text.as_py()) if ids.is_valid else (0, None) for text, ids in zip(b.column(1), b.column(2), strict=True)]
        n, r = zip(*coded, strict=True) if coded else ((), ())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(r, pa.bool_()), b.column(3)], ["doc_id", "ids", "n_tokens", "round_trip", "score"])


CODED = "doc_id long, text string, ids array<int>, score double"
DIGEST = "doc_id long, n_tokens long, ids_md5 string, decoded_md5 string, round_trip boolean, score double"
TOKENISED = "doc_id long, ids array<int>, n_tokens long, round_trip boolean, score double"


def _split(docs: DataFrame, giant: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where((F.length("text") <= giant) | F.col("text").isNull()), rows.where(F.length("text") > giant).withColumn("key", F.sha2("text", 256))


def _coded_giants(large: DataFrame, model: bytes, chunk: int) -> DataFrame:
    coded = encode_giants(large.select("key", "text").dropDuplicates(["key"]), model, chunk)
    return large.join(coded, "key").select("doc_id", "text", "ids", "score")


def encode(docs: DataFrame, model: bytes, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, ids array<int>, score double) for every row of ``docs``; other columns are ignored.

    Texts of more than ``giant`` characters take the parallel scan, each distinct text
    once. A null text has null ids, an empty one none; both score 0. The ids do not depend on
    ``giant`` or ``chunk``. Repeated rows and ids give repeated rows; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    small, large = _split(docs, giant)
    coded = small.mapInArrow(lambda batches: _whole(held, batches), CODED)
    return coded if large.isEmpty() else coded.unionByName(_coded_giants(large, model, chunk))


def decode(coded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids); null ids give a null text."""
    held = coded.sparkSession.sparkContext.broadcast(model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(held)
        for b in slices(batches):
            decoded = [v.decode(i.values.to_numpy()) if i.is_valid else None for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decoded, pa.string())], ["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, decoded string")


def digests(coded: DataFrame, model: bytes) -> DataFrame:
    """Of each row of encode(): doc_id, n_tokens, ids_md5 (of the ids as little-endian 32-bit numbers), decoded_md5, round_trip, score."""
    held = coded.sparkSession.sparkContext.broadcast(model)
    return coded.select("doc_id", "text", "ids", "score").mapInArrow(lambda batches: _digested(held, batches), DIGEST)


def _tripped(docs: DataFrame, model: bytes, giant: int, chunk: int, rows, schema: str) -> DataFrame:
    """``rows`` of encode(docs), with both steps in one worker so that texts needn't leave it."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    small, large = _split(docs, giant)
    found = small.mapInArrow(lambda batches: rows(held, _whole(held, batches)), schema)
    return found if large.isEmpty() else found.unionByName(_coded_giants(large, model, chunk).mapInArrow(lambda batches: rows(held, batches), schema))


def round_trips(docs: DataFrame, model: bytes, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """digests(encode(docs))."""
    return _tripped(docs, model, giant, chunk, _digested, DIGEST)


def tokenised(docs: DataFrame, model: bytes, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Of each row of encode(): doc_id, ids, n_tokens, round_trip (whether the decoded ids are the text) and score; a null text has null ids and round_trip."""
    return _tripped(docs, model, giant, chunk, _verified, TOKENISED)
