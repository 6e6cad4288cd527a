"""Periodic runs of words, by online dyadic square catching.

Words arrive in pieces of any size. Every completed block of 2**k words gets a catcher for a range
of periods q: it waits for its own words to come again q places later. A block that does so starts
a suffix comparison, to the left through what is there and to the right as further words arrive;
where it says that enough words equal those q places later, these are squares of period q, and all
squares of one stretch make one run. Blocks are as large as a qualifying run is sure to hold
whole, so a level of blocks of L words costs about a comparison for each word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import keyed_texts

MIN_LENGTH, MIN_EXPONENT = 24, 3
PIECE = 1 << 16
STREAM, SLICE_BYTES = 1 << 14, 1 << 20
_PRIME, _BASE = (1 << 31) - 1, 1_284_865_837
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


_POWERS = [np.ones(1, np.int64)]


def _powers(n: int) -> np.ndarray:
    """_BASE**0 .. _BASE**n modulo _PRIME, at least; the table grows by doubling and is kept."""
    while len(_POWERS[0]) <= n:
        _POWERS[0] = np.concatenate([_POWERS[0], _POWERS[0] * pow(_BASE, len(_POWERS[0]), _PRIME) % _PRIME])
    return _POWERS[0]


class SquareCatcher:
    """The runs of a growing sequence of word numbers (not negative): stretches of smallest period q, of at least ``min_length`` words and ``min_exponent`` (2 or more) periods; periods above ``max_period`` need not be looked for."""

    def __init__(self, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, max_period: int | None = None):
        if min_exponent < 2 or min_length < 1:
            raise ValueError("a run holds a square: min_exponent is 2 at least")
        self.min_length, self.min_exponent, self.max_period = min_length, min_exponent, max_period
        self.n = 0
        self._words = np.full(256, -1, np.int64)  # -1 beyond n, which equals no word
        self._sums = np.zeros(257, np.int64)  # prefix sums of word * base**place, for equality of blocks
        self._levels: list[list[int]] = []  # [block, smallest period, largest, words that it has seen]
        self._next_period = 1
        self._last: dict[int, list[int]] = {}  # period: [start, end] of its latest stretch of equal places
        self._open: set[int] = set()
        self._runs: list[tuple[int, int, int]] = []  # (period, start, end), closed

    def _needed(self, q: int) -> int:
        """Places in a row that equal those q later, in any run of period q that qualifies."""
        return max(self.min_length - q, (self.min_exponent - 1) * q)

    def _block(self, q: int) -> int:
        return 1 << (((self._needed(q) + 1) // 2).bit_length() - 1)

    def _grow(self, words: np.ndarray) -> None:
        n, size = self.n + len(words), len(self._words)
        if n > size:
            size = max(n, 2 * size)
            self._words = np.concatenate([self._words[: self.n], np.full(size - self.n, -1, np.int64)])
            self._sums = np.concatenate([self._sums[: self.n + 1], np.zeros(size - self.n, np.int64)])
        self._words[self.n : n] = words
        terms = (words % _PRIME + 1) * _powers(n)[self.n : n] % _PRIME
        self._sums[self.n + 1 : n + 1] = (self._sums[self.n] + np.cumsum(terms)) % _PRIME
        self.n = n
        while self._next_period * self.min_exponent <= n and self._next_period <= (self.max_period or n):  # levels whose runs fit by now
            q = self._next_period
            block, high = self._block(q), q
            if q >= self.min_length:
                high = max(q, -(-(4 * block - 1) // (self.min_exponent - 1)) - 1)
            while high + 1 < self.min_length and self._block(high + 1) == block:
                high += 1
            self._levels.append([block, q, high, 0])
            self._next_period = high + 1

    def append(self, words: np.ndarray) -> None:
        self._grow(np.asarray(words, np.int64))
        for q in sorted(self._open):
            self._advance(q)
        for level in self._levels:
            block, low, high, seen = level
            b, q = self._caught(block, low, high, seen)
            level[3] = self.n
            if len(b):
                self._follow(block, b, q)

    def _caught(self, block: int, low: int, high: int, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """(start of a block, period) for the blocks that come again, where the second copy ended after the first ``seen`` words."""
        n, w = self.n, self._words
        first = max(0, -(-(seen - block + 1 - high) // block) * block)
        starts = np.arange(first, n - block - low + 1, block)
        if not len(starts):
            return starts, starts
        if len(starts) <= 4:
            parts = []
            for b in starts:
                a, z = max(low, seen - block - b + 1), min(high, n - block - b)
                parts.append(np.flatnonzero(w[b + a : b + z + 1] == w[b]) + a)
            b, q = np.repeat(starts, [len(p) for p in parts]), np.concatenate(parts)
        else:
            ahead = w[:n] if starts[-1] + high < n else np.concatenate([w[:n], np.full(high + 1, -1)])
            rows = np.lib.stride_tricks.as_strided(ahead[first + low :], (len(starts), high - low + 1), (8 * block, 8), writeable=False)
            row, col = np.nonzero(rows == w[starts][:, None])
            b, q = starts[row], col + low
            new = (b + q + block <= n) & (b + q + block > seen)
            b, q = b[new], q[new]
        if block > 1 and len(b):
            same = w[b + 1] == w[b + q + 1]
            b, q = b[same], q[same]
        if len(b):
            one = (self._sums[b + block] - self._sums[b]) % _PRIME * _powers(self.n)[q] % _PRIME
            same = one == (self._sums[b + q + block] - self._sums[b + q]) % _PRIME
            b, q = b[same], q[same]
        return b, q

    def _follow(self, block: int, b: np.ndarray, q: np.ndarray) -> None:
        """Compare onwards from the blocks caught, the smaller periods first; what lies in a run of a period that divides q is no run of its own."""
        order = np.argsort(b, kind="stable")
        b, q = b[order], q[order]
        keep = np.ones(len(b), bool)
        for p, start, end in self._known(block + int(q.min())):
            i, j = np.searchsorted(b, (start, end - block + 1))
            part = slice(i, j)
            keep[part] &= ~((q[part] > p) & (q[part] % p == 0) & (b[part] + q[part] + block <= end))
        b, q = b[keep], q[keep]
        order = np.lexsort((b, q))
        b, q = b[order], q[order]
        cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1), len(q)]
        found: list[tuple[int, int, int]] = []
        for i, j in zip(cuts[:-1], cuts[1:]) if len(b) else ():
            period, at = int(q[i]), i
            while at < j:
                start = int(b[at])
                if not any(period % p == 0 and s <= start and start + period + block <= e for p, s, e in found):
                    last = self._last.get(period)
                    if last is None or not last[0] <= start < last[1]:
                        self._begin(period, start)
                        last = self._last[period]
                        if last[1] - last[0] >= self._needed(period):
                            found.append((period, last[0], last[1] + period))
                    start = last[1] - 1
                at = max(at + 1, i + int(np.searchsorted(b[i:j], start, side="right")))

    def _known(self, least: int) -> list[tuple[int, int, int]]:
        still = [(q, s, e + q) for q in self._open for s, e in [self._last[q]] if e - s >= self._needed(q)]
        return [x for x in self._runs + still if x[2] - x[1] >= least]

    def _begin(self, q: int, at: int) -> None:
        """A new stretch of period q through ``at``: to the left now, to the right as far as the words go."""
        if q in self._open:
            self._close(q)
        w, start, step = self._words, at, 32
        while start:
            a = max(0, start - step)
            same = w[a:start] == w[a + q : start + q]
            if not same.all():
                start = a + int(np.flatnonzero(~same)[-1]) + 1
                break
            start, step = a, 2 * step
        self._last[q] = [start, at]
        self._open.add(q)
        self._advance(q)

    def _advance(self, q: int) -> None:
        w, stretch, limit, step = self._words, self._last[q], self.n - q, 32
        while stretch[1] < limit:
            z = min(limit, stretch[1] + step)
            same = w[stretch[1] : z] == w[stretch[1] + q : z + q]
            if not same.all():
                stretch[1] += int(np.argmin(same))
                self._close(q)
                return
            stretch[1], step = z, 2 * step

    def _close(self, q: int) -> None:
        start, end = self._last[q]
        self._open.discard(q)
        if end - start >= self._needed(q):
            self._runs.append((q, start, end + q))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs in the words so far, by start and period. A multiple of a period may have been followed before the period's own run was long enough; it has the same ends."""
        least: dict[tuple[int, int], int] = {}
        for q, s, e in sorted(self._known(0), reverse=True):
            least[s, e] = q
        return sorted((s, e - s, q) for (s, e), q in least.items())


def stream_runs(texts: list[list], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, piece: int = PIECE) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every list of words. The lists follow one another in one stream, a word of its own after each, and catchers get ``piece`` words of it at a time."""
    numbers = defaultdict(count().__next__)
    arrays = []
    for k, words in enumerate(texts):
        arrays += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([numbers[k]])]  # no word is an int
    stream = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    catcher = SquareCatcher(min_length, min_exponent, max(1, max(map(len, texts), default=0) // min_exponent))
    for at in range(0, len(stream), piece):
        catcher.append(stream[at : at + piece])
    starts = np.cumsum([0, *(len(words) + 1 for words in texts)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catcher.runs():
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[k].append((start - int(starts[k]), length, period))
    return out


def all_runs(texts: list[list], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs of every list of words; short lists share a stream of up to STREAM words, a longer one has its own."""
    out: list[list[tuple[int, int, int]]] = []
    first = size = 0
    for k, words in enumerate(texts):
        if size and size + len(words) > STREAM:
            out += stream_runs(texts[first:k], min_length, min_exponent)
            first, size = k, 0
        size += len(words) + 1
    return out + stream_runs(texts[first:], min_length, min_exponent)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Rows in a row with the words of their texts, about SLICE_BYTES of text at a time, so that few words are held at once."""
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                yield b.slice(i, j - i), [t.as_py().split() for t in texts.slice(i, j - i)]


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, text): every row's runs as an array of (start, length, period), counted in words, and its words without the repeats, joined by one space.

    Words are what is between the white space characters of ASCII. Null, empty and blank texts have
    no runs and an empty text; texts of any length are read whole; repeated rows and null doc_ids
    stay as they are; an empty table gives none; other columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _slices(batches):
            runs = all_runs(words, min_length, min_exponent)
            found = [[{"start": s, "length": n, "period": q} for s, n, q in each] for each in runs]
            texts = [b" ".join(collapsed(w, each)) for w, each in zip(words, runs)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "text"])

    return keyed_texts(docs).mapInArrow(find, "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")


def planted(words: list, doc_id: int | None) -> list:
    """The query's own rewriting of a tenth of the documents, which repeats a stretch of them to the end; a null doc_id counts as the empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(words: list, runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of the query after doc_id, of one document's words and runs."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    text = b" ".join(collapsed(words, runs))
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def op13(docs: DataFrame) -> DataFrame:
    """A digest of the runs of every whole text, a tenth of them rewritten first (``planted``); odd rows as in ``detect``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for b, words in _slices(batches):
            ids = b.column("doc_id").to_pylist()
            words = [planted(w, d) for d, w in zip(ids, words)]
            out = [(d, *digest(w, runs)) for d, w, runs in zip(ids, words, all_runs(words))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return keyed_texts(docs).mapInArrow(rows, SCHEMA)
