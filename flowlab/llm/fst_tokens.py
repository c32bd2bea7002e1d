"""Token counts by a finite-state tokenizer that is compiled from the vocabulary file.

The tokenizer is a cascade of two deterministic transducers.

* The *splitter* reads code-point classes and marks where words begin. It has seven states, so a chunk of text is
  a map from seven states to seven states; the maps of all chunks compose by a parallel prefix scan, after which
  every chunk knows its entry state and marks its words on its own.
* The *merger* reads the bytes of a word. Its state holds, for every suffix of what has been read that begins some
  vocabulary entry, the token that ends before that suffix. Two tokens may stand side by side in a byte-pair encoding
  exactly if encoding their concatenation gives these two back, so the next state follows from state and byte
  alone. Each transition is annotated with the change of the number of emitted tokens, each final transition with the
  change at a word's end. States are determinised on first use and kept for later batches; beyond ``max_states`` a run goes on
  with those alone that some word is in. Every word begins in the first state, so a chunk's map is constant from its first
  word on, and the words of all chunks run side by side.

The result equals the library's for vocabulary files of this kind (byte-level alphabet, end-of-word suffix, NFC and lower case). Two things go to the
library itself: words of more than ``LONG_WORD`` bytes, whose states hardly recur, so that compiling them costs a state a byte; and texts with characters that
Unicode has got since version 3.2, over whose classes and lower case the library's tables and Python's may differ.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame

from flowlab.llm.common import keeps_tables, map_texts

# Splitter: classes of code points and states.
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, LET_R, LET_E, LET_V, LET_L = range(10)
FRESH, IN_LETTERS, IN_OTHER, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
N_STATES, N_CLASSES = 7, 10
CHUNK = 256
LONG_WORD = 256
#: Characters whose lower case depends on their neighbours in Python but not in the library.
SIGMA = str.maketrans({"Σ": "σ"})


def _splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, word begins here, word began one character earlier) by state and class.

    The words are those of ``'s|'t|'re|'ve|'m|'ll|'d|L+|N|[^\\sLN]+``. After a quote and r, v or l it takes one more
    character to know whether a word began at that letter, hence the second mark.
    """
    to = np.zeros((N_STATES, N_CLASSES), np.uint8)
    here = np.zeros((N_STATES, N_CLASSES), bool)
    back = np.zeros((N_STATES, N_CLASSES), bool)
    letters = (LETTER, STMD, LET_R, LET_E, LET_V, LET_L)
    pending = {QUOTE_R: LET_E, QUOTE_V: LET_E, QUOTE_L: LET_L}
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            if s in pending and c == pending[s]:
                continue  # the contraction is complete: fresh again
            if s == AFTER_QUOTE and c == STMD:
                continue
            if s == AFTER_QUOTE and c in (LET_R, LET_V, LET_L):
                to[s, c] = {LET_R: QUOTE_R, LET_V: QUOTE_V, LET_L: QUOTE_L}[c]
                continue
            back[s, c] = s in pending
            if c == SPACE:
                to[s, c] = FRESH
            elif c in letters:
                to[s, c], here[s, c] = IN_LETTERS, s not in (IN_LETTERS, *pending)
            elif c == NUMBER:
                to[s, c], here[s, c] = FRESH, True
            elif s in (IN_OTHER, AFTER_QUOTE):
                to[s, c] = IN_OTHER
            else:
                to[s, c], here[s, c] = (AFTER_QUOTE if c == QUOTE else IN_OTHER), True
    return to, here, back


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == m.end() - m.start() - 1:
                out[a : b + 1] = c
            else:
                out[[ord(x) for x in m[0]]] = c
    for x, c in {"'": QUOTE, "s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": LET_R, "e": LET_E, "v": LET_V, "l": LET_L}.items():
        out[ord(x)] = c
    return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, in log2(n) vectorised steps: row i becomes maps[i] o ... o maps[0]."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


@lru_cache(maxsize=1)
def _by_fours() -> tuple[np.ndarray, np.ndarray]:
    """The splitter over four characters at once: (next state, marks: bit k for a word at character k, bit 4 + k for one before it)."""
    to, here, back = _splitter()
    quads = np.stack(np.unravel_index(np.arange(N_CLASSES**4), (N_CLASSES,) * 4))
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], N_CLASSES**4, axis=1)
    marks = np.zeros(state.shape, np.uint8)
    for k in range(4):
        marks |= here[state, quads[k]].astype(np.uint8) << k | back[state, quads[k]].astype(np.uint8) << (4 + k)
        state = to[state, quads[k]]
    return state, marks


def word_starts(cls: np.ndarray) -> np.ndarray:
    """Marks of the word beginnings in a text of these classes, by chunk maps and a prefix scan."""
    to, marked = _by_fours()
    n = -(-len(cls) // CHUNK)
    grid = np.zeros((n, CHUNK // 4, 4), np.int32)
    grid.reshape(-1)[: len(cls)] = cls
    grid = np.ascontiguousarray((((grid[..., 0] * N_CLASSES + grid[..., 1]) * N_CLASSES + grid[..., 2]) * N_CLASSES + grid[..., 3]).T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (n, 1))
    for quad in grid:
        maps = to[maps, quad[:, None]]
    state = np.zeros(n, np.uint8)
    if n > 1:
        state[1:] = scan_maps(maps)[:-1, FRESH]
    got = np.empty(grid.shape, np.uint8)
    for j, quad in enumerate(grid):
        got[j], state = marked[state, quad], to[state, quad]
    bits = np.unpackbits(np.ascontiguousarray(got.T).reshape(-1, 1), axis=1, bitorder="little")
    out, before = bits[:, :4].reshape(-1).astype(bool), bits[:, 4:].reshape(-1)
    out[:-1] |= before[1:].astype(bool)
    return out[: len(cls)]


class Transitions:
    """Compiled transitions by state and byte, in a hash table with open places: few of a state's 256 ever occur."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(self.FACTOR)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of these keys; 0: not compiled yet."""
        at = self._place(keys)
        found, out = self.keys[at], self.values[at]
        other = np.flatnonzero(found != keys)
        out[other] = 0
        other = other[found[other] >= 0]
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            here = at[other]
            found = self.keys[here]
            same = found == keys[other]
            out[other[same]] = self.values[here[same]]
            other = other[~same & (found >= 0)]
        return out

    def put(self, key: int, value: int) -> None:
        """``key`` must be new."""
        if 2 * self.used >= len(self.keys):
            self._grow()
        at = (key * self.FACTOR & (1 << 64) - 1) >> (64 - self.bits)
        while self.keys[at] >= 0:
            at = (at + 1) & (len(self.keys) - 1)
        self.keys[at], self.values[at] = key, value
        self.used += 1

    def _grow(self) -> None:
        had = self.keys >= 0
        keys, values = self.keys[had], self.values[had]
        self.bits += 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)


class Merger:
    """The byte transducer of one vocabulary file, determinised as words come."""

    def __init__(self, path: str, max_states: int = 240_000):
        spec = json.load(open(path, encoding="utf-8"))
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        of_char = {c: b for b, c in _byte_chars().items()}
        self.symbols: dict[int, tuple[int, ...]] = {}  # token: its bytes; the last one plus 256 at a word's end

        def spelled(token: str) -> tuple[int, ...]:
            end = token.endswith(self.suffix)
            out = [of_char[c] for c in (token[: -len(self.suffix)] if end else token)]
            return (*out[:-1], out[-1] + 256 * end)

        for token, i in vocab.items():
            if token not in self.special:
                self.symbols[i] = spelled(token)
        self.by_symbols = {v: k for k, v in self.symbols.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.begins = {s[:k] for s in self.by_symbols for k in range(1, len(s))}
        self.fits: dict[int, bool] = {}
        self.max_states = max_states
        self.clear()

    def clear(self) -> None:
        # A state: for each k whose last k bytes begin some token, (k, last token before them, tokens emitted since), packed.
        self.states = [_packed(b"", [(0, -1, 0)])]
        self.ids = {self.states[0]: 0}
        self.last_token = np.zeros(4096, np.int32)
        self.to = Transitions()  # next state * 256 + change of the count + 128
        self.end = Transitions()  # the last token of a word that ends with this byte here, likewise

    def restart(self, live: np.ndarray) -> np.ndarray:
        """Forgets all states but these; returns their new numbers."""
        kept = np.unique(live)
        old = [(self.states[s], int(self.last_token[s])) for s in kept.tolist()]
        self.clear()
        return np.array([self.intern(key, token) for key, token in old], np.int32)[np.searchsorted(kept, live)]

    def intern(self, key: bytes, token: int) -> int:
        """The number of a state; ``token`` is the one that ends there."""
        new = self.ids.get(key)
        if new is None:
            new = self.ids[key] = len(self.states)
            self.states.append(key)
            if new >= len(self.last_token):
                self.last_token = np.concatenate([self.last_token, np.zeros(len(self.last_token) // 2, np.int32)])
            self.last_token[new] = token
        return new

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain merging of a short symbol string."""
        ids = [self.by_symbols[(s,)] for s in symbols]
        while len(ids) > 1:
            best = min(((self.merges.get(p, (1 << 30, 0)), k) for k, p in enumerate(zip(ids, ids[1:], strict=False))), key=lambda x: (x[0][0], x[1]))
            if best[0][0] == 1 << 30:
                break
            rank, made = best[0]
            pair, out, k = (ids[best[1]], ids[best[1] + 1]), [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(made)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def fit(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        pair = a << 32 | b
        got = self.fits.get(pair)
        if got is None:
            got = self.fits[pair] = self.encode(self.symbols[a] + self.symbols[b]) == [a, b]
            if len(self.fits) > 400_000:
                self.fits.clear()
        return got

    def follow(self, state: int, symbol: int) -> tuple[int, int]:
        """(token that ends with this symbol, change of the count)."""
        tail, back = _unpacked(self.states[state])
        for k, last, since in reversed(back):  # the longest that fits; there is exactly one
            t = self.by_symbols.get((*tail[len(tail) - k :], symbol))
            if t is not None and self.fit(last, t):
                return t, 1 - since
        raise ValueError("the vocabulary lacks a byte")

    def compile(self, state: int, byte: int) -> None:
        token, delta = self.follow(state, byte)
        tail, back = _unpacked(self.states[state])
        text = tail + bytes([byte])
        kept = [(0, token, 0)] + [(k + 1, last, since + delta) for k, last, since in back if (*tail[len(tail) - k :], byte) in self.begins]
        text = text[len(text) - kept[-1][0] :] if kept[-1][0] else b""
        new = self.intern(_packed(text, kept), token)
        self.to.put(state * 256 + byte, new * 256 + delta + 128)

    def compile_end(self, state: int, byte: int) -> None:
        token, delta = self.follow(state, byte + 256)
        self.end.put(state * 256 + byte, token * 256 + delta + 128)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: bool = False):
        """Token counts of the words data[starts : starts + lengths]; with ``ids``, (counts, all ids in order)."""
        order = np.argsort(lengths.astype(np.uint16) if len(lengths) and lengths.max() < 65536 else lengths, kind="stable")[::-1]
        at, left = starts[order], lengths[order]
        state, count = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        trail = np.zeros(len(data), np.int32) if ids else None  # the token that ends with each byte
        alive, j = len(at), 0
        falling = -left  # ascending
        while alive:
            if len(self.states) > self.max_states + alive:
                state[:alive] = self.restart(state[:alive])
            going = int(np.searchsorted(falling, -(j + 1), "left"))  # words longer than j + 1
            for table, lo, hi, make in ((self.end, going, alive, self.compile_end), (self.to, 0, going, self.compile)):
                if lo == hi:
                    continue
                where = at[lo:hi] + j
                keys = state[lo:hi].astype(np.int64) * 256 + data[where]
                got = table.get(keys)
                if not got.all():
                    for k in np.unique(keys[got == 0]).tolist():
                        make(k >> 8, k & 255)
                    new = np.flatnonzero(got == 0)
                    got[new] = table.get(keys[new])
                count[lo:hi] += (got & 255) - 128
                now = got >> 8
                if make == self.compile:
                    state[lo:hi] = now
                    now = self.last_token[now] if ids else now
                if ids:
                    trail[where] = now
            alive, j = going, j + 1
        counts = np.empty(len(at), np.int32)
        counts[order] = count
        return (counts, self.backtrack(starts, lengths, counts, trail)) if ids else counts

    def backtrack(self, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray, trail: np.ndarray) -> np.ndarray:
        """The ids, read off from each word's end."""
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        if not len(starts):
            return out
        ends = starts + lengths - 1
        token = trail[ends]
        size = self._length_of()
        left, pos = counts - 1, ends - size[token] + 1
        out[first + left] = token
        live = np.flatnonzero(left > 0)
        while len(live):
            token = trail[pos[live] - 1]
            left[live] -= 1
            out[first[live] + left[live]] = token
            pos[live] -= size[token]
            live = live[left[live] > 0]
        return out

    def _length_of(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(max(self.symbols) + 1, np.int32)
            for i, s in self.symbols.items():
                self._sizes[i] = len(s)
        return self._sizes


ENTRY = struct.Struct("<Bib")


def _packed(tail: bytes, back: list[tuple[int, int, int]]) -> bytes:
    return bytes([len(tail)]) + tail + b"".join(ENTRY.pack(*x) for x in back)


def _unpacked(state: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    n = 1 + state[0]
    return state[1:n], list(ENTRY.iter_unpack(state[n:]))


def _byte_chars() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest follows from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


@keeps_tables
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=1)
def library(path: str) -> tokenizers.Tokenizer:
    out = tokenizers.Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=1)
def newer() -> re.Pattern:
    """Characters of a later Unicode version than 3.2; pictures and currency signs, which are neither letters nor numbers in any, excepted."""
    old = unicodedata.ucd_3_2_0.category
    known = np.array([old(chr(c)) != "Cn" for c in range(0x110000)])
    for a, b in ((0xD800, 0xE000), (0x1F300, 0x1FB00), (0x20A0, 0x20D0)):
        known[a:b] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[True], known, [True]]).astype(np.int8)))
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in edges.reshape(-1, 2).tolist()) + "]")


def normalised(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(SIGMA).lower() if "Σ" in text else text.lower()


def tokenize(texts: list[str], path: str, ids: bool = False):
    """Token counts of the texts; with ``ids``, (counts, ids of all texts in order)."""
    odd = [k for k, t in enumerate(texts) if not t.isascii() and newer().search(t)]
    if not odd:
        return _tokenize(texts, path, ids)
    given = [library(path).encode(texts[k], add_special_tokens=False).ids for k in odd]
    rest = [t for k, t in enumerate(texts) if k not in set(odd)]
    got = _tokenize(rest, path, ids)
    counts = np.zeros(len(texts), np.int64)
    theirs = np.zeros(len(texts), bool)
    theirs[odd] = True
    counts[odd] = [len(g) for g in given]
    counts[~theirs] = got[0] if ids else got
    return (counts, _mixed(theirs, counts, got[1], given)) if ids else counts


def _mixed(theirs: np.ndarray, counts: np.ndarray, ours: np.ndarray, given: list[list[int]]) -> np.ndarray:
    """All ids in order, of units that were done here and of those that the library did."""
    at = np.repeat(theirs, counts)
    out = np.empty(len(at), np.uint32)
    out[~at] = ours
    out[at] = [i for g in given for i in g]
    return out


def _words(m: Merger, path: str, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: bool):
    """Token counts of all words; with ``ids``, (counts, ids)."""
    long = lengths > LONG_WORD
    if not long.any():
        return m.run(data, starts, lengths, ids)
    given = [library(path).encode(data[a : a + n].tobytes().decode(), add_special_tokens=False).ids for a, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
    got = m.run(data, starts[~long], lengths[~long], ids)
    counts = np.zeros(len(starts), np.int32)
    counts[long] = [len(g) for g in given]
    counts[~long] = got[0] if ids else got
    return (counts, _mixed(long, counts, got[1], given)) if ids else counts


def _tokenize(texts: list[str], path: str, ids: bool):
    m = merger(path)
    special = re.compile("|".join(map(re.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None
    parts, owner, fixed = [], [], []  # fixed: (place among the parts, special token)
    for k, text in enumerate(texts):
        if special is not None and (found := special.search(text)):
            at = 0
            while found:
                parts.append(normalised(text[at : found.start()]))
                owner.append(k)
                fixed.append((len(parts), k, m.special[found[0]]))
                at = found.end()
                found = special.search(text, at)
            text = text[at:]
        parts.append(normalised(text))
        owner.append(k)
    whole = "\n".join(parts) + "\n"  # a separator is white space: it ends every word and makes every state fresh
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(whole.encode("utf-8"), np.uint8)
    cls = _classes()[points]
    marks = word_starts(cls)
    width = np.ones(len(points), np.uint8)
    if len(data) != len(points):
        width += (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.cumsum(width, dtype=np.int64)
    begin = np.flatnonzero(marks)
    # A word ends where the next begins or at the first white space after it.
    space = np.flatnonzero(cls == SPACE)
    stop = space[np.searchsorted(space, begin)]
    if len(begin):
        stop[:-1] = np.minimum(stop[:-1], begin[1:])
    starts = at[begin] - width[begin]
    lengths = at[stop] - width[stop] - starts
    got = _words(m, path, data, starts, lengths, ids)
    counts = got[0] if ids else got
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    edge = np.concatenate([[0], np.searchsorted(begin, np.cumsum(sizes))])
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    per_part = upto[edge[1:]] - upto[edge[:-1]]
    total = np.bincount(owner, per_part, len(texts)).astype(np.int64) if parts else np.zeros(len(texts), np.int64)
    for _, k, _t in fixed:
        total[k] += 1
    if not ids:
        return total
    out = got[1]
    if fixed:
        after = np.cumsum(per_part)
        out = np.insert(out, [after[place - 1] for place, _, _ in fixed], [t for _, _, t in fixed])
    return total, out


def batches(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters; one longer text makes a range of its own."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. Null texts count as empty (0 bytes, 0 tokens); repeated rows stay; other columns
    are not read, so their names cannot clash. One pass without shuffle."""

    def count(texts: list[str]) -> list:
        n = [tokenize(texts[a:b], tokenizer) for a, b in batches(texts)]
        return [[len(t.encode()) for t in texts], np.concatenate(n) if n else []]

    return map_texts(docs, id_col, text_col, "n_bytes long, n_tokens long", count, keep=True)
