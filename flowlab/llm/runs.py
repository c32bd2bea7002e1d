"""Periodic runs in texts' words, found by online dyadic square catching.

Words arrive one after another. A square of period p, 2s <= p < 4s for a power of two s, has a whole aligned block of s words in its
first half, which comes again p words later. So every completed block of s words is a catcher: as long as it is 2s to 4s words old,
the suffix of s words that ends at an appended word is compared with it. At each level two catchers are of that age, whatever the
appended word (at s = 1 a third one has period 1), so a word costs two comparisons of hashes a level, and hashes of 2s words are made
of two hashes of s words. An equal suffix is a square in the making; those of consecutive blocks with the same period merge, and once
a comparison fails the merged stretch is compared word by word, which also refutes equal hashes of unlike words, and becomes a run if
it is long enough.

Comparisons of the words of a piece are made at once in numpy; the result does not depend on how a text is cut into pieces. Between
pieces a level keeps the hashes of its last few blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlab.llm.common import release_tables, slices, text_or_empty

PERIODS = 4  # a run's least length, in periods
LEAST = 6  # and in words
PIECE = 1 << 14  # words appended at once at the least


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93))
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


class _Level:
    """The catchers of blocks of ``1 << k`` words: hashes of the windows from ``base`` on, and (period, first block, last block) of what is being merged."""

    def __init__(self, k: int) -> None:
        self.k, self.size, self.base = k, 1 << k, 0
        self.ages = (1, 2, 3) if k == 0 else (2, 3)
        self.hashes = np.empty(0, np.uint64)
        self.open = [np.empty(0, np.int64)] * 3

    def compare(self, first: int, n: int) -> None:
        """The windows from ``first`` on against the blocks of the ages, after the stream has grown to ``n`` words."""
        blocks = np.repeat(self.hashes[:: self.size], self.size)
        found = [self.open]
        for age in self.ages:
            begin = max(first, age * self.size) - self.base
            back = begin - age * self.size
            hit = np.flatnonzero(self.hashes[begin:] == blocks[back : back + max(0, len(self.hashes) - begin)]) + begin + self.base
            block = (hit >> self.k) - age
            found.append([hit - (block << self.k), block, block])
        period, head, last = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(period):
            order = np.lexsort((head, period))
            period, head, last = period[order], head[order], last[order]
            new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (head[1:] != last[:-1] + 1)]))
            self.open = [period[new], head[new], last[np.concatenate([new[1:], [len(period)]]) - 1]]

    def closed(self, n: int | None) -> list[np.ndarray]:
        """Takes out what cannot grow: the next block's comparison was made and failed, or the stream has ended (None)."""
        period, head, last = self.open
        over = np.ones(len(period), bool) if n is None else ((last + 2) << self.k) + period <= n
        self.open = [x[~over] for x in (period, head, last)]
        return [x[over] for x in (period, head, last)]


class Catchers:
    """The runs of a stream of words (numbers). ``longest``: no run is longer than this; levels beyond it are not kept."""

    def __init__(self, longest: int) -> None:
        self.longest, self.n = longest, 0
        self.words = np.empty(0, np.int64)
        self.owner = np.empty(0, np.int32)  # the last run that was found over each word
        self.levels: list[_Level] = []
        self.spans: list[tuple[int, int, int]] = []
        self.runs: dict[tuple[int, int], int] = {}  # (start, end): least period

    def append(self, words: np.ndarray) -> None:
        at = 0
        while at < len(words):  # pieces grow with the stream, so that what a level keeps is moved few times
            piece = words[at : at + max(PIECE, self.n // 2)]
            at += len(piece)
            self._grow(piece)

    def _grow(self, piece: np.ndarray) -> None:
        if self.n + len(piece) > len(self.words):
            room = max(self.n + len(piece), 2 * len(self.words)) - self.n
            self.words = np.concatenate([self.words[: self.n], np.empty(room, np.int64)])
            self.owner = np.concatenate([self.owner[: self.n], np.full(room, -1, np.int32)])
        self.words[self.n : self.n + len(piece)] = piece
        self.n += len(piece)
        k = 0
        while 1 << k <= self.n and (k == 0 or (2 * PERIODS << k) <= self.longest):
            if k == len(self.levels):
                self.levels.append(_Level(k))
            level = self.levels[k]
            first = level.base + len(level.hashes)
            if k == 0:
                new = self.words[first : self.n].astype(np.uint64)
                new = _mixed(new, new)
            else:
                below = self.levels[k - 1]
                end, half = self.n - level.size + 1 - below.base, level.size // 2
                new = _mixed(below.hashes[first - below.base : end], below.hashes[first - below.base + half : end + half])
            level.hashes = np.concatenate([level.hashes, new])
            level.compare(first, self.n)
            self._settle(level, level.closed(self.n))
            k += 1
        for level in self.levels:
            base = max(0, (self.n - 5 * level.size) >> level.k << level.k)
            if base > level.base:
                level.hashes, level.base = level.hashes[base - level.base :].copy(), base

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start, then period. Nothing may be appended any more."""
        for level in self.levels:
            self._settle(level, level.closed(None))
        return sorted((a, e - a, p) for (a, e), p in self.runs.items())

    def _settle(self, level: _Level, merged: list[np.ndarray]) -> None:
        """Merged squares become runs. Their stretch of words equal to those a period later ends within a block of where they end."""
        period, head, last = merged
        size = level.size
        need = np.maximum((PERIODS - 1) * period, LEAST - period)
        for i in np.flatnonzero(((last - head + 3) << level.k) - 2 >= need):
            p, begin, end = int(period[i]), int(head[i]) * size, int(last[i] + 1) * size
            over = self.owner[(begin + end + p) // 2]
            if over >= 0:
                a, e, q = self.spans[over]
                if p % q == 0 and a <= begin and end + p <= e:
                    continue  # several periods of a run that is known
            lo, hi = max(0, begin - size + 1), min(self.n - p, end + size - 1)
            same = np.zeros(hi - lo + 2, np.int8)
            same[1:-1] = self.words[lo:hi] == self.words[lo + p : hi + p]
            edge = np.flatnonzero(np.diff(same))
            for a, e in zip(edge[::2], edge[1::2], strict=True):
                if e - a >= need[i]:
                    self._record(lo + int(a), lo + int(e) + p, p)

    def _record(self, start: int, end: int, period: int) -> None:
        """Two periods of one stretch of words are multiples of its least one."""
        if period < self.runs.get((start, end), end):
            self.runs[start, end] = period
            self.owner[start:end] = len(self.spans)
            self.spans.append((start, end, period))


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words. The texts go through one stream, each followed by a word that comes nowhere else."""
    number = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
    lengths = np.array([len(words) for words in texts], np.int64)
    stream = Catchers(int(lengths.max(initial=0)))
    ends = np.cumsum(lengths + 1)
    numbers = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for k, (words, end) in enumerate(zip(texts, ends, strict=True)):
        numbers[end - 1 - len(words) : end - 1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        numbers[end - 1] = -1 - k
    stream.append(numbers)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in stream.finish():
        k = int(np.searchsorted(ends, start, "right"))
        out[k].append((start - (int(ends[k - 1]) if k else 0), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that any run repeats: of every run its first period stays unless another run repeats it."""
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) of every row. runs: start, length and period, in words ``[^\\x20\\x09-\\x0D]+`` from 0, of every stretch of words
    with least period q and length of at least max(6, 4 q) that no neighbouring word extends; by start, then period. collapsed: the
    text without the words that a run repeats after its first period.

    Null and empty texts have no words, no runs and an empty collapsed text; null ids and repeated rows stay, other columns are not
    read. One pass without shuffle. A task holds about 500 KB of texts, or one longer text, at some hundred bytes a word."""
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in (part for b in batches for part in slices(b, 1)):
            texts = [t.encode().split() for t in batch.column(1).to_pylist()]  # of bytes, split() knows these six characters only
            runs = text_runs(texts)
            upto = np.cumsum([0, *map(len, runs)])
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(span))
            shown = pa.array([collapsed(w, r).decode() for w, r in zip(texts, runs, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), spans), shown], names=names)

    schema = StructType.fromDDL(f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    names = schema.names
    return rows.mapInArrow(run, schema)
