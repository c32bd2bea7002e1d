"""Near-duplicates by SimHash fingerprints, linked at few differing bits.

Copies collapse first: all that follows works on distinct fingerprints. Two fingerprints within ``distance`` bits agree
on at least half of six blocks of bits when the distance is three, so the (block triple, value) postings bring every
linked pair together. Inside a posting, a table of Hamming distances to many reference fingerprints is built once; a pair
whose coordinates differ by more than the distance anywhere cannot be linked (triangle inequality) and is discarded; what
survives is verified by its own bits. A posting gives a spanning forest of its links, never all pairs. Postings that are
too long are dealt again by triples of the bits that their members do not share yet; after two such steps at most 2**16
fingerprints can share a posting, after three 2**8.

Three bits of 64 are a similarity far above 0.8. Module ``similar`` links at a similarity that is asked for, with longer fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import map_texts, written
from flowlab.llm.components import components

SEED = 42
BLOCKS = 6
#: Members of a posting that one task compares; longer postings are split further.
POSTING = 512
N_PIVOTS = 32
#: Bits of the fingerprints that measure similarity.
LONG_BITS = 512
WHITE = bytes(range(9, 14))
TO_SPACES = bytes.maketrans(WHITE, b" " * len(WHITE))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle of words, repeats included; of all words if they are fewer; none without words."""
    words = text.encode().lower().translate(TO_SPACES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, width: int) -> int:
    """The fingerprint of a text: bit set where over half of the shingles' XXH64 have it; 0 without words."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp a signed long. Null texts count as empty; other columns are not read. One pass without shuffle."""

    def hashed(texts: list[str]) -> list:
        return [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, id_col, text_col, "fp long", hashed)


def _masks(free: int) -> list[int]:
    """Masks of the triples of six blocks into which the free bits (a mask) are cut, as signed longs."""
    bits = [k for k in range(64) if free >> k & 1]
    blocks = [sum(1 << k for k in bits[len(bits) * b // BLOCKS : len(bits) * (b + 1) // BLOCKS]) for b in range(BLOCKS)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivots() -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED)) for k in range(N_PIVOTS)]


def pivot_table(fp: Column) -> Column:
    """Hamming distances to the reference fingerprints, as a binary string of one byte each."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.bit_count(fp.bitwiseXOR(F.lit(p)))), 2, "0") for p in _pivots()]))


def _forest(fps: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what links connect among these fingerprints."""
    n = len(fps)
    root = np.arange(n)
    edges: list[tuple[int, int]] = []
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1  # what is connected already needs no second link
        for p in range(table.shape[1]):
            if not len(rest):
                break
            rest = rest[np.abs(table[rest, p] - table[i, p]) <= distance]
        if len(rest):
            rest = rest[np.bitwise_count((fps[rest] ^ fps[i]).view(np.uint64)) <= distance]  # of a signed integer numpy counts the absolute value's bits
        for j in rest.tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                edges.append((int(fps[i]), int(fps[j])))
    return edges


def _links(postings: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) from postings (array of (fp, table))."""

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for fps, tables in zip(f["fps"], f["tables"], strict=True):
                table = np.frombuffer(b"".join(tables), np.uint8).reshape(len(fps), -1).astype(np.int16)
                out += _forest(np.asarray(fps, np.int64), table, distance)
            yield pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return postings.mapInPandas(linked, "u long, v long")


def links(fps: DataFrame, distance: int = 3, posting: int = POSTING) -> DataFrame:
    """Edges between distinct fingerprints (column fp) within ``distance`` (at most 3) bits: enough to connect every linked pair."""
    if distance > 3:
        raise ValueError("three equal blocks of six hold for at most three differing bits")
    found = None
    # Fingerprints with the mask of bits that all members of their posting share.
    level = fps.select("fp", F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("posting"))
    knowns = [0]
    while knowns:
        keys = None
        for known in knowns:
            masks = [known | m for m in _masks(~known & (1 << 64) - 1)]
            each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
            part = level.where(F.col("known") == _signed(known)).select("fp", each.alias("mask"))
            keys = part if keys is None else keys.union(part)
        # The same fingerprint may come from several postings of the level before.
        keys = keys.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        keys = written(keys if knowns == [0] else keys.distinct(), "postings")
        sizes = keys.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(keys.join(sizes, ["mask", "value"]), "postings")
        short = sized.where(F.col("n") <= posting).withColumn("table", pivot_table(F.col("fp")))
        lists = short.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"), F.collect_list("table").alias("tables"))
        edges = _links(lists.select("fps", "tables"), distance)
        found = edges if found is None else found.union(edges)
        long = sized.where(F.col("n") > posting)
        # Masks only, of which there are at most 20 per mask of the level before.
        knowns = sorted({r[0] % (1 << 64) for r in long.select("mask").distinct().collect()})
        level = long.select("fp", F.col("mask").alias("known"))
    return found


def near_dedup(docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id, component_size) of every row; component_id is the least id that links reach, itself included.

    Null and empty texts have fingerprint zero and link like any other; rows with a null id take part but never name
    a component (null if all ids are null); repeated rows stay. Hot fingerprints are one row after the first, partial aggregate;
    the join back to documents may be split.
    """
    rows = written(fingerprints(docs, width, id_col, text_col).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    classes = written(_classes(rows).withColumn("node", F.col("fp")), "classes")
    return _named(rows, classes, links(classes.select("fp"), distance), id_col)


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))


def _named(rows: DataFrame, classes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Every row (id, fp) with the component of its class (fp, least, n, node) under the edges between nodes."""
    roots = components(edges).withColumnRenamed("root", "to")
    joined = written(classes.join(roots, "node", "left").select("fp", "least", "n", F.coalesce("to", "node").alias("root")), "rooted")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    of_class = joined.select("fp", "root").join(named, "root").drop("root")
    return rows.join(of_class, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "component_size")


def column_counts(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit set, of rows of 64-bit words: full adders turn three rows of a weight into one and one of twice that weight."""
    total, weight = np.zeros(words.shape[1] * 64, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 32:
            t = len(words) // 3
            a, b, c = words[:t], words[t : 2 * t], words[2 * t : 3 * t]
            x = a ^ b
            carries.append(a & b | x & c)
            words = np.concatenate([x ^ c, words[3 * t :]])
        total += weight * np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return total


def long_fingerprint(hashes: np.ndarray, bits: int = LONG_BITS) -> np.ndarray:
    """The fingerprint of shingle hashes in 64-bit words, with as many bits as asked for (a multiple of 64): every hash is mixed anew for each 64 of them."""
    ones = np.zeros(bits, np.int64)
    salt = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(hashes), 8192):
        h = hashes[k : k + 8192, None] + salt
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        ones += column_counts(h ^ (h >> np.uint64(31)))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def differing_bits(similarity: float, bits: int = LONG_BITS, deviations: float = 5.0) -> int:
    """The most bits that may differ for sets of this Jaccard similarity: they have a cosine of 2s/(1+s) or more, an angle that tells the share of bits which
    differ on average; five standard deviations on top leave out such a pair with a probability of 3e-7."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
