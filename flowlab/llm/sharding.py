"""Histogram sort into shards of equal bytes, with DataFrame functions only.

Rows are ordered by (hash of the text, id, row number), so equal texts stand together, and splitters between the shards
are searched by exact histograms: each round counts bytes and rows between candidate boundaries over all partitions and opens
only those intervals that hold a splitter not yet within tolerance. An interval that has shrunk to one hash value goes on
with the ids of that text, so a text that makes up a third of all rows is split like the rest. Then rows move once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowlab.llm.common import written

BITS = 63
FIRST, LATER = 12, 8  # bits of the histogram in the first and in each later round
TOP = (1 << BITS) - 1
KEYS = ("k0", "k1", "k2")


def _positive(col: Column) -> Column:
    """A long's order in 63 bits; its last bit goes."""
    return F.shiftrightunsigned(col.bitwiseXOR(F.lit(-(1 << 63))), 1)


@dataclass
class Interval:
    """Rows whose first keys equal ``prefix`` and whose next key, shifted by ``shift``, equals ``value``."""

    prefix: tuple[int, ...]
    shift: int
    value: int
    bytes_below: int
    rows_below: int
    low: int
    high: int
    goals: list[tuple[int, int]]  # (splitter, bytes that should lie below it)


def _histogram(rows: DataFrame, level: int, opened: list[Interval], shift: int) -> dict[tuple, list]:
    """Bytes, rows, least and greatest key by interval and bin, in order."""
    key = F.col(KEYS[level])
    if level == 0 and opened[0].shift == BITS:
        kept = rows
    elif level == 0:
        kept = rows.where(F.shiftright(key, opened[0].shift).isin([o.value for o in opened]))
    else:  # one entry per open interval, at most one per splitter
        wanted = _inline([{**{f"p{k}": o.prefix[k] for k in range(level)}, "pv": o.value} for o in opened], ", ".join(f"p{k}: bigint" for k in range(level)) + ", pv: bigint", rows)
        on = [F.col(KEYS[k]) == F.col(f"p{k}") for k in range(level)] + [F.shiftright(key, opened[0].shift) == F.col("pv")]
        kept = rows.join(F.broadcast(wanted), on, "left_semi")
    bins = kept.groupBy(*KEYS[:level], F.shiftright(key, shift).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    out: dict[tuple, list] = {}
    for r in bins.collect():
        prefix = tuple(r[k] for k in KEYS[:level])
        whole = (r["bin"] << shift) >> opened[0].shift
        out.setdefault((prefix, whole), []).append((r["bin"], r["bytes"], r["n"], r["low"], r["high"]))
    return {k: sorted(v) for k, v in out.items()}


def _inline(items: list[dict], fields: str, like: DataFrame) -> DataFrame:
    """A small table from a literal, without Python workers."""
    array = F.from_json(F.lit(json.dumps(items)), f"array<struct<{fields}>>")
    return like.sparkSession.range(1).select(F.explode(array).alias("x")).select("x.*")


def find_splitters(rows: DataFrame, parts: int, tolerance: float, each: int = 1, loose: float = 0.25) -> list[tuple[tuple[int, int, int], int]]:
    """parts - 1 pairs (greatest key that stays left, rows up to it), by rounds of exact histograms.

    Every ``each``-th splitter is settled when its bytes are within ``tolerance`` of a part's size from the goal, the others, which only cut
    tasks, within ``loose`` of it; or when the interval is one row or equal rows; then the nearer edge is taken. To the driver come at most
    2**FIRST bins, later 2**LATER per open interval.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = lambda k: (loose if k % each else tolerance) * total / parts
    done: dict[int, tuple[tuple[int, int, int], int]] = {}
    opened = [Interval((), BITS, 0, 0, 0, 0, TOP, [(k, total * k // parts) for k in range(1, parts)])]
    if not total:
        return [((TOP, TOP, TOP), 0)] * (parts - 1)
    while opened:
        level, at = len(opened[0].prefix), opened[0].shift
        now = [o for o in opened if (len(o.prefix), o.shift) == (level, at)]
        opened = [o for o in opened if (len(o.prefix), o.shift) != (level, at)]
        spread = max((o.low ^ o.high).bit_length() for o in now)
        shift = max(0, spread - (FIRST if at == BITS and not level else LATER))
        found = _histogram(rows, level, now, min(shift, at - 1))
        shift = min(shift, at - 1)
        for o in now:
            below, n_below = o.bytes_below, o.rows_below
            goals, rest = sorted(o.goals, key=lambda g: g[1]), 0
            edge = (*o.prefix, (o.value << o.shift) - 1)
            bins = found[(o.prefix, o.value)]
            for j, (value, size, n, low, high) in enumerate(bins):
                upper = (*o.prefix, high)
                inside = []
                while rest < len(goals) and (goals[rest][1] < below + size or j == len(bins) - 1):
                    k, goal = goals[rest]
                    rest += 1
                    left, right = goal - below, below + size - goal
                    if min(left, right) <= slack(k) or n == 1 or (low == high and level == len(KEYS) - 1):
                        done[k] = (_padded(edge), n_below) if left <= right else (_padded(upper), n_below + n)
                    else:
                        inside.append((k, goal))
                if inside and low < high:
                    opened.append(Interval(o.prefix, shift, value, below, n_below, low, high, inside))
                elif inside:
                    opened.append(Interval((*o.prefix, low), BITS, 0, below, n_below, 0, TOP, inside))
                below, n_below, edge = below + size, n_below + n, upper
    return [done[k] for k in range(1, parts)]


def _padded(key: tuple[int, ...]) -> tuple[int, int, int]:
    return (*key, *([TOP] * (len(KEYS) - len(key))))


def histogram_shards(rows: DataFrame, shards: int, key: Column, id_col: str, size_col: str, tolerance: float = 0.002, per_range: int = 200_000) -> DataFrame:
    """The rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Shards differ from the mean size by about ``tolerance`` of a quarter of a shard, or one row. ``key`` is any long, equal for rows that should
    stand together. Null ids come first; repeated rows are split by a row number that is fixed in a written table. Each shard is sorted in several ranges (as
    many as rows ask for, 4 to 1024), so no task has a whole shard. An empty table gives an empty one. The input's columns travel in one
    struct, so their names cannot clash, but columns named shard or slot give way to the new ones.
    """
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0))
    keyed = rows.select(row.alias("row"), _positive(key).alias("k0"), _positive(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).alias("k1"), F.monotonically_increasing_id().alias("k2"), F.col(size_col).cast("long").alias("size"))
    keyed = written(keyed, "shard-keys")
    narrow = keyed.select(*KEYS, "size")
    ranges = min(1024, max(4, -(-narrow.count() // (shards * per_range))))
    parts = shards * ranges
    cuts = find_splitters(narrow, parts, tolerance * ranges / 4, ranges)
    # Which range: splitters below the row's cell of the key space, plus those in the cell that are smaller than the row.
    cell = lambda c: c[0][0] >> (BITS - FIRST) if c[0][0] >= 0 else -1
    cells = [{"cell": x, "base": 0, "cuts": []} for x in range(1 << FIRST)]
    for c in cuts:
        if cell(c) >= 0:
            cells[cell(c)]["cuts"].append(dict(zip(KEYS, c[0], strict=True)))
    base = sum(cell(c) < 0 for c in cuts)
    for x in cells:
        x["base"], base = base, base + len(x["cuts"])
    grid = _inline(cells, "cell: int, base: int, cuts: array<struct<k0: bigint, k1: bigint, k2: bigint>>", rows)
    starts = [0] + [n for _, n in cuts]
    firsts = _inline([{"range": r, "shard": r // ranges, "first": n - starts[r // ranges * ranges]} for r, n in enumerate(starts)], "range: int, shard: int, first: bigint", rows)
    at = F.broadcast(grid)  # 2**FIRST rows at any size of the input
    placed = keyed.join(at, F.shiftright("k0", BITS - FIRST).cast("int") == F.col("cell"))
    halvings = max(len(x["cuts"]) for x in cells).bit_length()
    mine = F.struct(*KEYS)

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        less = F.get("cuts", middle) < mine
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(less, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(less, a["hi"]).otherwise(middle).alias("hi")))

    # A cell's cuts are in order: how many are smaller is found by halves, as a hot text's cell may have a third of all.
    smaller = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(F.lit(0).alias("lo"), F.size("cuts").alias("hi")), halve)["lo"] if halvings else F.lit(0)
    placed = placed.select("row", *KEYS, (F.col("base") + smaller).alias("range"))
    order = Window.partitionBy("range").orderBy(*KEYS)
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(firsts), "range")  # shards * ranges rows
    return ranked.select(*[F.col("row")[c].alias(c) for c in own], "shard", (F.col("first") + F.col("rank")).alias("slot"))
