"""Bootstrap replicates of ranking metrics from counts, without a row per replicate.

Counts per score lie in ranges of the order of scores. A task draws the weights of all replicates for its scores as one matrix and returns a few sums per replicate; the
ranges' sums are added up in order, so nothing is multiplied by the number of replicates but numbers inside a task.

Weights come from hashes of what is weighed, so a replicate is the same wherever and whenever its rows are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.scans import PER_RANGE, in_ranges

#: Numbers of a matrix of weights that a task holds at once.
CELLS = 2_000_000
#: In 16-bit steps, where a Poisson weight of mean 1 becomes 1, 2, ...: floor(65536 * P(at most k)).
STEPS = tuple(int(65536 * sum(0.36787944117144233 / f for f in facts)) for facts in ((1,), (1, 1), (1, 1, 2), (1, 1, 2, 6), (1, 1, 2, 6, 24), (1, 1, 2, 6, 24, 120), (1, 1, 2, 6, 24, 120, 720)))


def cluster_weights(seed: int, clusters: list, replicates: int) -> np.ndarray:
    """(clusters, replicates + 1): Poisson weights of mean 1; replicate 0 weighs all once. Eight replicates share the MD5 of ``seed|replicate div 8|cluster``, 16 bits each."""
    out = np.ones((len(clusters), replicates + 1), np.int64)
    for i, c in enumerate(clusters):
        name = "" if c is None else str(c)
        bits = b"".join(hashlib.md5(f"{seed}|{k}|{name}".encode()).digest() for k in range(replicates // 8 + 1))
        out[i, 1:] = np.searchsorted(STEPS, np.frombuffer(bits, ">u2")[1 : replicates + 1], "right")
    return out


def _uniform(seed: int, scores: np.ndarray, label: int, first: int, last: int) -> np.ndarray:
    """(scores, replicates first to last): uniform numbers from the scores' bits."""
    with np.errstate(over="ignore"):
        x = scores.astype(np.float64).view(np.uint64)[:, None] ^ (np.arange(first, last, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * seed + label))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15), (32, 0xD6E8FEB86659FD93)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def poisson_quantiles(mean: int, u: np.ndarray) -> np.ndarray:
    """The Poisson quantiles of ``u``, from the distribution's table within twelve deviations."""
    if mean <= 0:
        return np.zeros(u.shape, np.int64)
    width = int(12 * mean**0.5) + 20
    low = max(0, mean - width)
    k = np.arange(low, mean + width)
    steps = np.concatenate([[0.0], np.cumsum(np.log(mean / np.arange(low + 1, mean + width)))])
    mass = np.exp(steps - steps.max())
    return low + np.searchsorted(np.cumsum(mass) / mass.sum(), u)


def _row_weights(seed: int, scores: np.ndarray, counts: np.ndarray, label: int, first: int, last: int) -> np.ndarray:
    """(scores, replicates): a draw for each count, the sum of as many Poisson weights of mean 1."""
    out, u = np.zeros((len(scores), last - first)), _uniform(seed, scores, label, first, last)
    for c in np.unique(counts):
        at = counts == c
        out[at] = poisson_quantiles(int(c), u[at])
    if first == 0:
        out[:, 0] = counts
    return out


def ranked_counts(counts: DataFrame, by: tuple[str, ...], cluster: bool, per_range: int = PER_RANGE) -> DataFrame:
    """Counts (by, [c,] s, p, n) with ``part``, rows of a score in one range."""
    shown = counts.select(*by, *(["c"] if cluster else []), F.col("s").cast("double").alias("s"), F.col("p").cast("long").alias("p"), F.col("n").cast("long").alias("n"))
    return in_ranges(shown, by, [F.desc("s")], per_range)


SUMS = "part int, model string, replicate int, p double, n double, area double, precision double"


def areas(ranked: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(model, replicate, roc_auc, pr_auc) for replicates 0 (the rows as they are) to ``replicates`` of counts (model, [c,] s, p, n, part): null where a class has no weight."""
    cluster = "c" in ranked.columns
    rows = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), *(["c"] if cluster else []), "p", "n")))
    packed = ranked.groupBy("model", "part").agg(rows.alias("rows"))  # a range's counts: bounded by its size

    def pass_over(offsets: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = batch.column(2).slice(i, 1).flatten()
                    s, p, n = (np.asarray(rows.field(f).to_numpy(zero_copy_only=False)) for f in ("s", "p", "n"))
                    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                    before = np.array(batch.column(3)[i].as_py(), float).reshape(2, -1) if offsets else np.zeros((2, replicates + 1))
                    if cluster:
                        names = rows.field("c").to_pylist()
                        place = {c: k for k, c in enumerate(dict.fromkeys(names))}
                        table, at = cluster_weights(seed, list(place), replicates), np.fromiter(map(place.__getitem__, names), np.int64)
                    step = max(1, CELLS // max(1, len(s)))
                    got = np.zeros((4, replicates + 1))
                    for a in range(0, replicates + 1, step):
                        b = min(replicates + 1, a + step)
                        if cluster:
                            w = table[at, a:b]
                            wp, wn = p[:, None] * w, n[:, None] * w
                        else:
                            wp, wn = _row_weights(seed, 0.0 - s, p, 1, a, b), _row_weights(seed, 0.0 - s, n, 0, a, b)
                        wp, wn = (np.add.reduceat(x, starts, 0).astype(float) for x in (wp, wn))
                        tp, fp = np.cumsum(wp, 0) + before[0, a:b], np.cumsum(wn, 0) + before[1, a:b]
                        got[0, a:b], got[1, a:b] = wp.sum(0), wn.sum(0)
                        got[2, a:b] = (wn * (tp - wp / 2)).sum(0)
                        got[3, a:b] = (wp * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)).sum(0)
                    model, part = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    size = replicates + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, part, np.int32)), pa.array([model] * size), pa.array(np.arange(size, dtype=np.int32)), *(pa.array(x) for x in got)], names=[x.split()[0] for x in SUMS.split(", ")])

        return run

    source = packed.select("model", "part", "rows")
    first = source.mapInArrow(pass_over(False), SUMS)
    several = ranked.agg(F.count_distinct("part").alias("n")).first()["n"] > 1
    if several:  # later ranges again, with what lies before them
        upto = Window.partitionBy("model", "replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = first.select("model", "part", "replicate", *[F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(c) for c in ("p", "n")])
        each = sums.groupBy("model", "part").agg(F.array_sort(F.collect_list(F.struct("replicate", "p", "n"))).alias("x"))
        flat = F.concat(F.transform("x", lambda r: r["p"]), F.transform("x", lambda r: r["n"]))
        first = source.join(each.select("model", "part", flat.alias("before")), ["model", "part"]).select("model", "part", "rows", "before").mapInArrow(pass_over(True), SUMS)
    out = first.groupBy("model", "replicate").agg(*[F.sum(c).alias(c) for c in ("p", "n", "area", "precision")])
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select("model", "replicate", F.when(both, F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(both, F.col("precision") / F.col("p")).alias("pr_auc"))


def weighted_cells(cells: DataFrame, names: list[str], replicates: int, seed: int) -> DataFrame:
    """(model, replicate, names): sums of the clusters' cells (c, model, names) under the clusters' weights, added up in the task that reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            models, clusters = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            values = np.column_stack([batch.column(k + 2).to_numpy(zero_copy_only=False) for k in range(len(names))]) if batch.num_rows else np.empty((0, len(names)))
            for a in range(0, len(clusters), 1000):
                w = cluster_weights(seed, clusters[a : a + 1000], replicates)
                for m in set(models[a : a + 1000]):
                    at = np.array([x == m for x in models[a : a + 1000]])
                    total[m] = total.get(m, 0) + w[at].T @ values[a : a + 1000][at]
        for m, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(sums)), pa.array(np.arange(len(sums), dtype=np.int32)), *(pa.array(sums[:, k].astype(np.int64)) for k in range(len(names)))], names=["model", "replicate", *names])

    got = cells.select("c", "model", *names).mapInArrow(run, f"model string, replicate int, {', '.join(f'{n} long' for n in names)}")
    return got.groupBy("model", "replicate").agg(*[F.sum(n).alias(n) for n in names])
