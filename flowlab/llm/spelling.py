"""Spelling variants: pairs of words one edit apart, by composing the vocabulary's minimal acceptor with a one-edit transducer and the acceptor again.

A path of the composition goes through the acceptor twice: side by side until the edit, then from two states that must spell the same rest. A part of it is
what lies between an initial state, where a prefix leads both sides, and a final one, from where both spell the same suffix. For a pair of lengths
c and c or c + 1 the edit is before or behind the middle of the shorter word, so the words of a length (and the next) are partitioned by their first halves and
again by their second halves. A partition of more than ``LIMIT`` words is cut again, its open middle in two, until few enough words
are left or one place is open (at most one word for each letter there, and one for each two letters). So every pair is found in one partition, and the
number of rounds is logarithmic in the longest word.

In a partition the open middles make a minimal acceptor (sorted words, one after another; equal states are registered once). It numbers its words by
counts on the arcs, and its states come in the order of their ends, so pairs are enumerated per state, as offsets, from the last state to the initial one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlab.llm.common import release_tables, slices, text_or_empty, written

LIMIT = 20_000
#: Latin-1 bytes: letters are a-z and U+00C0 to U+00FF, A-Z are lower-cased, all others end a word.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
Slip = Callable[[bytes, int], bytes]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: Slip | None = None) -> DataFrame:
    """(word, n): how often each maximal run of letters ``[A-Za-z\\u00C0-\\u00FF]`` occurs, A-Z lower-cased.

    ``slip`` may replace a word (Latin-1), given the CRC-32 of ``<id>:``; rows with a null id go without. Null texts have no words, repeated rows count
    each time, other columns are not read. Counts are added up in each slice of texts before the shuffle."""
    key = F.crc32(F.concat(F.col(id_col).cast("string"), F.lit(":")).cast("binary"))
    rows = docs.select(key.alias("key"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in (part for b in batches for part in slices(b, 1, 2_000_000)):
            texts = [t.encode("latin-1", "replace").translate(LETTERS).split() for t in batch.column(1).to_pylist()]
            total = Counter(w for words in texts for w in words)
            for words, begun in zip(texts, batch.column(0).to_pylist(), strict=True):
                if slip and begun is not None:
                    changed = {w: s for w in set(words) if (s := slip(w, begun)) is not w}
                    for w, n in Counter(w for w in words if w in changed).items() if changed else ():
                        total[w] -= n
                        total[changed[w]] += n
            kept = {w: n for w, n in total.items() if n and w}
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hashed_slip(word: bytes, begun: int, modulus: int = 97) -> bytes:
    """The word without its letter at h % length where h, the CRC-32 of what ``begun`` is of and the word in UTF-8, is a multiple of ``modulus``."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
    return word if h % modulus else word[: (at := h % len(word))] + word[at + 1 :]


class Acceptor:
    """The minimal acceptor of sorted words without repeats. States are numbers, an arc leads to a lower one. ``arcs[p]``: letter to (state, number of the
    state's words that come before this arc's); ``final[p]``; ``count[p]``: words from the state on."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        register: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        before = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                (arcs, final), letter = path.pop(), before[len(path) - 1]
                path[-1][0][letter] = self._state(arcs, final[0], register)

        for word in words:
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            close(k)
            path += [({}, [False]) for _ in word[k:]]
            path[-1][1][0] = True
            before = word
        close(0)
        self.initial = self._state(path[0][0], path[0][1][0], register)

    def _state(self, arcs: dict[str, int], final: bool, register: dict[tuple, int]) -> int:
        key = (final, *arcs.items())
        if key not in register:
            register[key] = len(self.arcs)
            at, own = int(final), {}
            for letter, state in arcs.items():
                own[letter] = (state, at)
                at += self.count[state]
            self.arcs.append(own)
            self.final.append(final)
            self.count.append(at)
        return register[key]

    def same(self, p: int, q: int, at: tuple[int, int], out: list) -> None:
        """To ``out``, the pairs of numbers, counted from ``at``, of all words that both states spell."""
        arcs, final, todo, left, right = self.arcs, self.final, [(p, q, *at)], [], []
        while todo:
            p, q, i, j = todo.pop()
            if p == q:
                own = np.arange(self.count[p])
                out.append((own + i, own + j))
                continue
            if final[p] and final[q]:
                left.append(i)
                right.append(j)
            a, b = arcs[p], arcs[q]
            if len(a) > len(b):
                todo += [(a[x][0], s, i + a[x][1], j + n) for x, (s, n) in b.items() if x in a]
            else:
                todo += [(s, b[x][0], i + n, j + b[x][1]) for x, (s, n) in a.items() if x in b]
        if left:
            out.append((np.array(left), np.array(right)))

    def pairs(self, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pairs of words one edit apart: of equal length, the lesser first, or the shorter first. A letter counts as inserted as far right
        as it can, so a pair comes once; ``ends``: also those with a letter inserted at the end."""
        none = np.empty(0, np.int64)
        per: list[tuple[np.ndarray, np.ndarray]] = []
        for p, arcs in enumerate(self.arcs):
            out = []
            items = list(arcs.items())
            for k, (x, (s, n)) in enumerate(items):
                i, j = per[s]
                if len(i):
                    out.append((i + n, j + n))
                for _, (t, m) in items[k + 1 :]:  # the letter x replaced
                    self.same(s, t, (n, m), out)
                if ends and self.final[p] and self.final[s]:  # x inserted at the end
                    out.append((np.array([0]), np.array([n])))
                after = self.arcs[s]
                for y, (t, m) in items:  # x inserted before y, which is another letter
                    if y != x and y in after:
                        self.same(t, after[y][0], (m, n + after[y][1]), out)
            per.append((np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (none, none))
        return per[self.initial]


def partition_nears(words: list[str], counts: list[int], middles: list[str], ends: bool) -> list[tuple[str, int, int, str]]:
    """(word, number of near words, n of the most frequent near word, that word; ties: the least) of the words of a partition that have any in it.
    Pairs of two longer words are of the next length's partitions."""
    order = sorted(range(len(words)), key=middles.__getitem__)
    length = np.array([len(middles[k]) for k in order], np.int64)
    i, j = Acceptor([middles[k] for k in order]).pairs(ends)
    own = length[i] == length.min()
    i, j = i[own], j[own]
    if not len(i):
        return []
    n = np.array([counts[k] for k in order], np.int64)
    place = np.empty(len(order), np.int64)
    place[sorted(range(len(order)), key=lambda k: words[order[k]])] = np.arange(len(order))
    at, near = np.concatenate([i, j]), np.concatenate([j, i])
    best = np.lexsort((place[near], -n[near], at))
    at, near = at[best], near[best]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    number = np.diff(np.concatenate([first, [len(at)]]))
    return [(words[order[a]], int(m), int(n[b]), words[order[b]]) for a, b, m in zip(at[first], near[first], number, strict=True)]


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of each row's open places ``lo`` to ``hi`` of the ``c`` of its class. ``key``: the class, the open places and what is spelt around them."""
    cut = F.expr("lo + (hi - lo) div 2")
    parts = rows.withColumn("part", F.explode(F.array(F.struct("lo", cut.alias("hi")), F.struct(cut.alias("lo"), "hi"))))
    own = parts.select("word", "n", "c", "part.lo", "part.hi")
    around = F.concat_ws(" ", "c", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, c - hi)"))
    return own.withColumn("key", around)


def partitions(vocabulary: DataFrame, limit: int = LIMIT) -> Iterator[DataFrame]:
    """Tables of (word, n, c, lo, hi, key), in which each key has ``limit`` words at most or one open place, by rounds of counting and cutting.
    Keys with one word are left out: nothing is near it there."""
    m = F.char_length("word")
    rows = _halves(vocabulary.select("word", "n", F.explode(F.array(m, m - 1)).alias("c"), F.lit(0).alias("lo")).withColumn("hi", F.col("c")))
    while True:
        rows = written(rows, "spelt")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.char_length("word") - F.col("c")).alias("least")).where("members > 1 and least = 0").select("key", "members")
        sized = written(rows.join(sizes, "key"), "spelt")
        large = (F.col("members") > limit) & (F.col("hi") - F.col("lo") > 1)
        yield sized.where(~large).drop("members")
        left = sized.where(large)
        if left.isEmpty():
            return
        rows = _halves(left)


def near_words(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best: (-n, word) of the near word of largest n) of the words that have near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        key, own, out = None, [], []

        def flush() -> None:
            if len(own) > 1:
                c, lo, hi = own[0][2:]
                tail = c - hi
                out.extend(partition_nears([r[0] for r in own], [r[1] for r in own], [r[0][lo : len(r[0]) - tail] for r in own], hi == c))
            own.clear()

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "near", "near_n", "near_word"])

        for batch in batches:
            for its, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if its != key:
                    flush()
                    key = its
                own.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        flush()
        yield batch_of(out)

    found = None
    for part in partitions(vocabulary, limit):
        ordered = part.select("key", "word", "n", "c", "lo", "hi").repartition("key").sortWithinPartitions("key")
        one = written(ordered.mapInArrow(run, "word string, near long, near_n long, near_word string"), "nears")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("word"))).alias("best"))


def variants(counts: DataFrame, least_length: int = 5, least_n: int = 3, times: int = 2, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``counts`` (word, n; once each) with at least ``least_length`` code points and ``least_n`` occurrences.

    form: the most frequent word one edit away (one code point inserted, deleted or replaced; ties: the least in code-point order) if it occurs at least ``times``
    as often, else null; root: the last of the forms' forms, the word itself without any. Null words are none; no words give no rows."""
    vocabulary = written(counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_n)).select("word", "n"), "vocabulary")
    near = near_words(vocabulary, limit)
    form = F.when(-F.col("best.n") >= times * F.col("n"), F.col("best.word"))
    formed = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n"))
    formed = written(formed, "formed")
    up = written(formed.where("form is not null").select("word", F.col("form").alias("up")), "roots")
    if times < 2:
        raise ValueError("forms of equal counts could go in circles")
    while True:  # forms at least double the count, so their chains are short; a round doubles the reach
        above = up.select(F.col("word").alias("up"), F.col("up").alias("top"))
        further = up.join(above, "up", "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        further = written(further, "roots")
        up = further.select("word", "up")
        if further.where("moved").isEmpty():
            break
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
