"""Sum-of-squares packing of documents into sequences of fixed capacity.

Documents are cut into pieces of at most ``capacity`` tokens. A piece goes where the sum over all residual gaps of the
squared number of open bins with that gap becomes smallest, a new bin being one of the places. The rule keeps gaps
diverse, so that later pieces find a gap that they fill exactly. Pieces are dealt at random into groups of bounded size
that are packed on their own, in random order but the shortest fifth last, which closes what the others left open.
Groups then end with one or two sequences more than the sum of lengths asks for, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlab.llm.common import map_texts, written
from flowlab.llm.fst_tokens import batches, tokenize

#: Pieces that one task packs.
GROUP = 50_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids) of every row: its token ids and ``end_id``, cut into pieces of at most ``capacity``.

    ids: little-endian unsigned 32-bit values. Null and empty texts give one piece with the end id alone; repeated rows
    are kept; other columns are not read. One pass without shuffle.
    """

    def cut(texts: list[str]) -> tuple:
        rows, pieces, begins, lengths, parts = [], [], [], [], []
        for a, b in batches(texts):
            n, ids = tokenize(texts[a:b], tokenizer, ids=True)
            ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
            upto = np.cumsum(n + 1)
            count = -(-(n + 1) // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = (upto - n - 1)[row] + piece * capacity
            end = np.minimum(begin + capacity, upto[row])
            raw = ids.tobytes()
            parts += [raw[x:y] for x, y in zip((begin * 4).tolist(), (end * 4).tolist(), strict=True)]
            for out, v in ((rows, row + a), (pieces, piece), (begins, piece * capacity), (lengths, end - begin)):
                out.append(v)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, pieces, begins, lengths)]
        return flat[0], [flat[1].astype(np.int32), *flat[2:], parts]

    return map_texts(docs, id_col, text_col, "piece int, start long, length long, ids binary", cut, keep=True)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        had = open_bins[s:capacity]
        # Taking a bin of gap g: its count falls, that of gap g - s rises; a filled bin is no longer open.
        cost = np.where(had > 0, 2 * (open_bins[: capacity - s] - had + 1), never)
        if len(cost):
            cost[0] = 1 - 2 * had[0] if had[0] else never
        fresh = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
        g = int(cost.argmin()) if len(cost) else -1
        if g < 0 or cost[g] > fresh or cost[g] == never:
            gap, b = capacity, made
            made += 1
        else:
            gap = g + s
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            open_bins[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id (unique, with gaps) and offset (gapless from 0 in each sequence).

    Needs columns id, piece and length (1 to ``capacity``); further columns pass through. Every row gets one place, equal rows
    each their own. Groups are dealt by a hash of the row's key and a count of rows, so they hold about ``group`` rows at any size;
    equal keys spread by a per-partition number.
    """
    narrow = written(pieces.withColumn("__n", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-narrow.count() // group))
    out = StructType([x for x in narrow.schema if x.name != "__n"]).add("sequence_id", "long").add("offset", "long")

    def one(key: tuple, t: pa.Table) -> pa.Table:
        seed = key[0].as_py()
        t = t.sort_by([(id_col, "ascending"), ("piece", "ascending"), ("length", "ascending"), ("__n", "ascending")])
        order = np.random.default_rng(seed).permutation(t.num_rows)
        lengths = t["length"].to_numpy()[order]
        order = order[np.argsort(lengths <= np.quantile(lengths, 0.2), kind="stable")]
        t = t.take(pa.array(order))
        bins, offsets = place(t["length"].to_numpy(), capacity)
        t = t.append_column("sequence_id", pa.array((seed << 32) + bins)).append_column("offset", pa.array(offsets))
        return t.select(out.names)

    dealt = narrow.withColumn("__g", F.pmod(F.xxhash64(id_col, "piece", "__n"), F.lit(groups)))
    return dealt.groupBy("__g").applyInArrow(one, out)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: the ids of its pieces in order (from a packing that carries ``ids``) and where each piece begins.

    A sequence holds at most ``capacity`` pieces, so the collected lists are bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return out.select("sequence_id", "length", joined.alias("ids"), F.transform("parts", lambda x: x["offset"]).alias("begins"))
