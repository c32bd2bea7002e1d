"""Exact deduplication against a history that is kept as minimal perfect hash tables.

History: the distinct digests of earlier rows are dealt into buckets by their hash. Each bucket becomes one row of the
index: bit arrays of a level-by-level perfect hash (a key owns the first level at which no other key meets it; its slot is the
rank of its bit), and in the slots the full digests, the winners' ids and the counts. New rows are grouped by digest and
looked up in their bucket: the digest is compared byte for byte with the one in its slot, for any key, member or not, reaches
some slot. Members repeat a historical row; nonmembers form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import text_or_empty, written

#: Distinct digests in a bucket, on average, of the history and of new rows at most: one task's unit of work.
BUCKET = 8192
INDEX = "bucket long, sizes array<int>, bits binary, digests binary, winners array<long>, counts array<long>"
ENTRY = "digest binary, keep_id long, group_size long, member boolean"


def text_digest(text: Column) -> Column:
    """SHA-256, 32 bytes, of the text with every run of white space (U+0020, U+0009 to U+000D) made one space. Runs that are one
    space already need no replacement, so the pattern skips them."""
    return F.unhex(F.sha2(F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ").cast("binary"), 256))


def _mixed(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Positions at a level, from the digest's own random words."""
    with np.errstate(over="ignore"):
        h = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 1))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(16)) % np.uint64(size)).astype(np.int64)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def build_tables(digests: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level sizes, all bits, slot of each key) of distinct digests. Half of the keys or more leave at each level."""
    words, slots = _words(digests), np.full(len(digests), -1, np.int64)
    sizes, bits, rest, rank = [], [], np.arange(len(digests)), 0
    while len(rest):
        size = 2 * len(rest) + 1
        at = _mixed(words[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        slots[rest[own]] = rank + (np.cumsum(alone) - 1)[at[own]]
        rank += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        rest = rest[~own]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slots


def find_slots(digests: list[bytes], sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 for keys that no level takes. Nonmembers get some slot or -1."""
    words, slots = _words(digests), np.full(len(digests), -1, np.int64)
    ranks, rest, base = np.cumsum(bits) - 1, np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = base + _mixed(words[rest], level, size)
        own = bits[at]
        slots[rest[own]] = ranks[at[own]]
        rest, base = rest[~own], base + size
    return slots


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index (schema INDEX) of ``history``: one row (digest, winner, n) per distinct digest."""

    def build(f: pd.DataFrame) -> pd.DataFrame:
        digests = list(f["digest"])
        sizes, bits, slots = build_tables(digests)
        order = np.argsort(slots)
        winners = [None if pd.isna(f["winner"].iloc[k]) else int(f["winner"].iloc[k]) for k in order]
        row = [f["bucket"].iloc[0], sizes, np.packbits(bits).tobytes(), b"".join(digests[k] for k in order), winners, f["n"].iloc[order].tolist()]
        return pd.DataFrame([row], columns=["bucket", "sizes", "bits", "digests", "winners", "counts"])

    return _bucketed(history, buckets).groupBy("bucket").applyInPandas(build, INDEX)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def look_up(index: DataFrame, probes: DataFrame, buckets: int) -> DataFrame:
    """Every distinct digest of index and probes, once (schema ENTRY): the historical winner where it is a member, the probes' own otherwise."""

    def match(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out, fresh = [], new
        if len(old):
            row = old.iloc[0]
            sizes = [int(x) for x in row["sizes"]]
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
            full = [row["digests"][k : k + 32] for k in range(0, len(row["digests"]), 32)]
            counts = np.array(row["counts"], np.int64)
            if len(new):
                slots = find_slots(list(new["digest"]), sizes, bits)
                same = np.array([s >= 0 and full[s] == d for s, d in zip(slots, new["digest"], strict=True)], bool)
                np.add.at(counts, slots[same], new["n"].to_numpy()[same])
                fresh = new[~same]
            out.append(pd.DataFrame({"digest": full, "keep_id": pd.array([None if pd.isna(x) else int(x) for x in row["winners"]], "Int64"), "group_size": counts, "member": True}))
        if len(fresh):
            out.append(pd.DataFrame({"digest": fresh["digest"].array, "keep_id": pd.array([None if pd.isna(x) else int(x) for x in fresh["winner"]], "Int64"), "group_size": fresh["n"].array, "member": False}))
        return pd.concat(out, ignore_index=True)

    return index.groupBy("bucket").cogroup(_bucketed(probes, buckets).groupBy("bucket")).applyInPandas(match, ENTRY)


def exact_dedup(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, keep_id, group_size, kept, digest, historical) of every row.

    Rows for which ``history`` is true are earlier ones; their ids must be the smaller ones. Of equal texts the smallest
    id stays, rows with a null id last; rows that repeat id and text are the same document and all marked kept. A null text counts
    as empty, and so do empty texts group with it. Other columns are not read. Groups are counted before any shuffle of theirs, so a
    hot digest is one row per task; only the final join meets all its rows, and that join may be split.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), text_digest(text_or_empty(text_col)).alias("digest"), F.coalesce(history, F.lit(False)).alias("old")), "digests")
    part = lambda old: written(rows.where(F.col("old") == old).groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("n")), "parts")
    past, fresh = part(True), part(False)
    buckets = max(1, -(-max(past.count(), fresh.count()) // bucket))  # a task takes a bucket of both
    index = written(build_index(past, buckets), "mph")
    entries = look_up(index, fresh, buckets)
    out = rows.join(entries, "digest")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", F.col("member").alias("historical"))


def earlier_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """History as the ids up to the middle of their range; two numbers come to the driver."""
    lo, hi = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(False) if lo is None else F.col(id_col) <= F.lit(lo + (hi - lo) // 2)
