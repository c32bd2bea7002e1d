"""SimHash near-dedup at a similarity that is asked for: word shingle sets, long fingerprints, distance tables, and an exact check.

A text is the set of the XXH64 of its shingles, each once however often it repeats, and the SimHash fingerprint of that set. Fingerprints of three bits'
distance can be brought together by their blocks; at 0.8 some 90 of 512 bits differ, and bands of bits that catch such pairs would be hundreds a text and
grow with the corpus. So MinHash bands of the same sets (their number depends on the similarity alone) make the postings.
Postings with the same members are one. Each gets a table, built once: every member's Hamming distances to the posting's reference members. All pairs pass
it: one whose coordinates differ by more than the limit anywhere goes at once (triangle inequality). First every member meets the least and the greatest
one, which are references, so that the coordinate is the distance itself; what that leaves in several components meets in blocks, where the bits verify
what the table lets through. Pairs link only if their two sets have the similarity, counted on the sets.
Sets of fewer than ``FEW`` shingles, whose bits say little, pass the fingerprints and are counted all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import map_texts, text_or_empty, written
from flowlab.llm.components import components
from flowlab.llm.exact_dedup import text_digest
from flowlab.llm.simhash import LONG_BITS, SEED, differing_bits, long_fingerprint, shingle_hashes

#: MinHash values of a band.
ROWS = 6
#: Shingles of a block that one task compares with another block.
BLOCK = 1 << 18
#: Shingles from which a set's fingerprint is used.
FEW = 16
#: Nodes that meet others, up to which their names are broadcast (16 bytes each), so that no sets move but theirs.
NAMED = 4_000_000
#: Members of a posting that its distance table refers to.
REFERENCES = 8
#: The least member after mixing by each of these is a reference: the first two give the least and the greatest one.
PICKS = [0, -1, *np.random.default_rng(SEED).integers(-(1 << 63), (1 << 63) - 1, REFERENCES - 2).tolist()]
PRINT = [f"f{k}" for k in range(LONG_BITS // 64)]


def band_count(similarity: float, miss: float = 1e-5) -> int:
    """Bands of ``ROWS`` values that all miss a pair at the very limit of the similarity with probability ``miss`` only, nearer ones less."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log1p(-(similarity**ROWS)))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order; none without words."""
    return np.unique(shingle_hashes(text, width))


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key per band: the hash of its MinHash values and of its number."""
    half = -(-bands * ROWS // 2)  # each 64-bit mix gives two values of 32 bits
    factors = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(2 * half, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 1024):
        h = factors[:, None] * hashes[k : k + 1024]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        low, high = h.astype(np.uint32).min(axis=1), (h >> np.uint64(32)).astype(np.uint32).min(axis=1)
        least = np.minimum(least, np.concatenate([low, high]))
    values = least[: bands * ROWS].reshape(bands, ROWS)
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), k) for k, v in enumerate(values)], np.uint64).view(np.int64)


def shingle_rows(docs: DataFrame, width: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """(key, node, shingles, fp, keys) of every row: key is (id, digest of the text), node names the set, fp is its fingerprint, keys are those of its bands.
    One pass without shuffle."""

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)])
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64, copy=False)))

    def hashed(texts: list[str]) -> list:
        sets = [shingle_set(t, width) for t in texts]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        prints = np.stack([long_fingerprint(s) for s in sets]) if sets else np.zeros((0, len(PRINT)), np.int64)
        fp = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in prints.T], PRINT)
        return [nodes, lists([s.view(np.int64) for s in sets]), fp, lists([band_keys(s, bands) for s in sets])]

    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_digest(text_or_empty(text_col)).alias("digest")).alias("key"), F.col(text_col).alias("text"))
    return map_texts(rows, "key", "text", f"node long, shingles array<long>, fp struct<{', '.join(f'{f}: long' for f in PRINT)}>, keys array<long>", hashed)


def distance_table(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, n, weight, ends, table) of every member (key, node, n; n: the posting's members): its set's size, the posting's least and greatest member
    (node, weight), and the Hamming distances of its fingerprint to those of the posting's references, these two first.

    Up to three members need no other references. Only fingerprints move, and of a posting of any size a bounded number of references."""
    prints = sets.select("node", F.size("shingles").alias("weight"), "fp")
    mixed = members.groupBy("key").agg(F.first("n").alias("n"), *[F.min(F.col("node").bitwiseXOR(F.lit(p))).alias(f"p{k}") for k, p in enumerate(PICKS)])
    picked = [F.col(f"p{k}").bitwiseXOR(F.lit(p)) for k, p in enumerate(PICKS)]
    chosen = F.when(F.col("n") > 3, F.array_distinct(F.array(*picked))).otherwise(F.array(*picked[:2]))
    placed = mixed.select("key", F.posexplode(chosen).alias("at", "node")).join(prints, "node")
    refs = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "node", "weight", "fp"))).alias("refs"))
    apart = lambda r: sum((F.bit_count(r["fp"][f].bitwiseXOR(F.col(f"fp.{f}"))) for f in PRINT[1:]), F.bit_count(r["fp"]["f0"].bitwiseXOR(F.col("fp.f0"))))
    ends = F.transform(F.slice("refs", 1, 2), lambda r: F.struct(r["node"].alias("node"), r["weight"].alias("weight")))
    return members.join(prints, "node").join(refs, "key").select("key", "node", "n", "weight", ends.alias("ends"), F.transform("refs", apart).alias("table"))


def _near_ends(table: DataFrame, similarity: float, most: int) -> DataFrame:
    """The pairs (u, v) of a member and its posting's least or greatest one that their coordinates there leave, the end's own being 0, or of which one set is too small
    for fingerprints. The coordinate is the distance in bits; sets whose sizes alone rule the similarity out go too."""
    small, great = F.least("weight", "e.weight"), F.greatest("weight", "e.weight")
    met = table.select("node", "weight", "table", F.posexplode("ends").alias("at", "e")).where("node <> e.node")
    near = met.where(((small < FEW) | (F.col("table")[F.col("at")] <= most)) & (small >= similarity * great * (1 - 1e-12)))
    return near.select(F.least("node", "e.node").alias("u"), F.greatest("node", "e.node").alias("v")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    shingles = sets.select("node", "shingles")
    both = pairs.join(shingles.toDF("u", "a"), "u").join(shingles.toDF("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.withColumn("common", common).where(F.col("common") / (F.size("a") + F.size("b") - F.col("common")) >= similarity).select("u", "v")


def set_forest(sets: list[np.ndarray], prints: np.ndarray, table: np.ndarray, root: np.ndarray, similarity: float, most: int) -> list[tuple[int, int]]:
    """Positions of edges that, with what ``root`` connects, connect all that similar sets connect. ``prints``: a fingerprint a row, in 64-bit words; ``table``: its
    distances to the posting's references."""
    root, edges, sizes = root.copy(), [], np.array([len(s) for s in sets])
    bits = lambda at, i: np.bitwise_count((prints[at] ^ prints[i]).view(np.uint64)).sum(axis=1, dtype=np.int32)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(flat) + 1, bool)
    at = [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) * (1 - 1e-12)]
        small = (sizes[rest] < FEW) | (sizes[i] < FEW)
        rest = rest[small | (np.abs(table[rest] - table[i]).max(axis=1, initial=0) <= most)]
        if len(rest):
            small = (sizes[rest] < FEW) | (sizes[i] < FEW)
            rest = rest[small | (bits(rest, i) <= most)]
        if not len(rest):
            continue
        marked[at[i]] = True
        for j in rest.tolist():
            if root[j] != root[i]:
                common = int(np.count_nonzero(marked[at[j]]))
                if common / (sizes[i] + sizes[j] - common) >= similarity:
                    root[root == root[j]] = root[i]
                    edges.append((i, j))
        marked[at[i]] = False
    return edges


def set_links(rows: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between nodes whose sets are similar enough and share a band: enough to connect all such pairs. ``rows``: node, shingles, fp, keys."""
    most = differing_bits(similarity)
    keys = written(rows.select("node", F.explode("keys").alias("key")).distinct(), "bands")
    marks = [F.bit_xor(F.xxhash64(F.lit(SEED + k), "node")).alias(f"mark{k}") for k in range(2)]
    postings = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1").groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "n")
    members = written(keys.join(postings, "key"), "members")
    named = written(members.select("node").distinct(), "named")
    # No task of the joins below moves a set that meets nobody; beyond the bound all sets move once, to be picked.
    named = F.broadcast(named) if named.count() <= NAMED else named
    sets = rows.select("node", "shingles", "fp").join(named, "node", "left_semi").groupBy("node").agg(F.first(F.struct("shingles", "fp")).alias("x")).select("node", "x.*")
    sets = written(sets, "sets")
    table = written(distance_table(members, sets), "distances")
    first = written(_verified(written(_near_ends(table, similarity, most), "likely"), sets, similarity), "links")

    # Postings of up to three members are settled now, and those that are one component.
    roots = components(first).withColumnRenamed("root", "to")
    left = table.where("n > 3").select("key", "node", "weight", "table").join(roots, "node", "left").withColumn("root", F.coalesce("to", "node"))
    chosen = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    unsettled = written(left.join(chosen, "key").select("key", "node", "root", "weight", "table"), "unsettled")
    blocks = unsettled.groupBy("key").agg(F.ceil(F.sum("weight") / block).cast("int").alias("blocks"))
    dealt = unsettled.join(blocks, "key").withColumn("blocks", F.greatest("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("node", "root", "table", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    lists = units.join(sets, "node").groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("node", "root", "shingles", "fp", "table")).alias("found"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for found in batch.column(0):
                nodes, root, shingles, fp, table = (found.values.field(c) for c in ("node", "root", "shingles", "fp", "table"))
                nodes, prints = nodes.to_numpy(), np.stack([fp.field(f).to_numpy() for f in PRINT], axis=1)
                for i, j in set_forest([s.values.to_numpy() for s in shingles], prints, table.flatten().to_numpy().reshape(len(nodes), -1), root.to_numpy(), similarity, most):
                    u.append(nodes[i])
                    v.append(nodes[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return first.union(lists.where(F.size("found") > 1).select("found").mapInArrow(linked, "u long, v long"))


def similar_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, component_id, component_size, kept) of every row; component_id is the least id that links reach, itself included.

    Texts without words have the empty set and are one class; shorter texts than ``width`` have one shingle. Of each component the row with the least id
    is kept (a null id only where all are null), of several such the one with the least digest of the text; rows that repeat both are all marked.
    """
    rows = written(shingle_rows(docs, width, band_count(similarity), id_col, text_col), "shingles")
    least = F.min(F.struct(F.col("key.id").isNull().alias("none"), F.col("key.id").alias("id"), F.col("key.digest").alias("digest")))
    classes = written(rows.groupBy("node").agg(least.alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(set_links(rows, similarity)).withColumnRenamed("root", "to")
    joined = written(classes.join(roots, "node", "left").select("node", "least", "n", F.coalesce("to", "node").alias("root")), "rooted")
    named = joined.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("component_size"))
    of_class = joined.select("node", "root").join(named, "root").drop("root")
    kept = F.col("key.id").eqNullSafe(F.col("first.id")) & (F.col("key.digest") == F.col("first.digest"))
    return rows.select("key", "node").join(of_class, "node").select(F.col("key.id").alias(id_col), "key.digest", F.col("first.id").alias("component_id"), "component_size", kept.alias("kept"))
