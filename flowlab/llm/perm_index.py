"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order (a prefix of a permutation). The rows of a block are posted in the
inverted files of the pivots in their prefixes, with the pivot's place. A query visits only the files of its own first
``visited`` pivots and adds up, for the rows of the block, how far the places differ (Spearman's footrule; a pivot outside
a row's prefix stands at its end); the rows with the least footrule are reranked by the exact inner product. Blocks are
dealt by hash and searched in phases of growing size; from the second phase on a row is returned only if it beats the
query's worst result so far, so what is shuffled grows in proportion to the queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import written

PIVOTS, PREFIX, VISITED = 1024, 128, 48
SHARE, LEAST = 0.07, 48  # of a block this share and so many rows more are reranked
BLOCK, FEWEST, QUERIES = 8192, 12, 32_768  # rows in a block at most, blocks at least, queries in a block
STEP = 16  # growth of the phases


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, v) with finite, nonzero vectors as doubles, each row on its own; shorter vectors are filled up with zeros."""
    v = F.col(vec_col)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    most = good.agg(F.max(F.size(v))).first()[0] or 0
    filled = F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(most) - F.size(v)))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), filled.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) if len(whole) else np.zeros((0, 1))


def _prefixes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row in order."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length].astype("<u2")


def inverted_files(prefix: np.ndarray, n_pivots: int) -> np.ndarray:
    """Places by pivot (first axis) and row; a row that is not posted in a pivot's file has the place after the prefix."""
    n, m = prefix.shape
    out = np.full((n_pivots, n), m, np.int16 if m < 1 << 15 else np.int32)
    out[prefix.T, np.arange(n)] = np.arange(m, dtype=out.dtype)[:, None]
    return out


def footrules(files: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Footrule of every row over the pivots of a query's prefix. Only their files are read. 16 bits do as long as the greatest sum fits in them."""
    farthest = int(files.max(initial=0)) + len(query)
    kind = np.int16 if farthest * len(query) < 1 << 15 else np.int64
    total, apart = np.zeros(files.shape[1], kind), np.empty(files.shape[1], kind)
    for place, pivot in enumerate(query.tolist()):
        np.subtract(files[pivot], place, out=apart)
        np.abs(apart, out=apart)
        np.add(total, apart, out=total)
    return total


def search_block(ids: np.ndarray, least_ids: np.ndarray, x: np.ndarray, files: np.ndarray, q: np.ndarray, q_prefix: np.ndarray, floor: np.ndarray, k: int, share: float, least: int):
    """(query row, row of the block, score) of the block's best k rows for each query above its floor, by footrule and then exactly; ties to the smaller of ``least_ids``."""
    out = []
    keep = min(len(ids), max(k, int(np.ceil(share * len(ids))) + least))
    for j, prefix in enumerate(q_prefix):
        near = np.argpartition(footrules(files, prefix), keep - 1)[:keep] if keep < len(ids) else np.arange(len(ids))
        exact = x[near] @ q[j]
        good = np.flatnonzero(exact >= floor[j])
        if len(good) > k:
            good = good[exact[good] >= np.partition(exact[good], -k)[-k]]  # ties at the k-th stay
        best = good[np.lexsort((least_ids[near[good]], -exact[good]))[:k]]
        out.append((np.full(len(best), j), near[best], exact[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(
    rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, visited: int = VISITED, share: float = SHARE, least: int = LEAST, block: int = BLOCK,
    fewest: int = FEWEST, per_group: int = QUERIES, step: int = STEP,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query, among all other rows, ties to the smaller id.

    ``is_query`` is a predicate on a column named id. ``pivots`` rows, the first by a hash, are the bounded sample that the index is fitted on; every row is
    indexed. ``share`` 1.0 reranks everything and is exact; smaller shares trade recall for time. Equal vectors are searched once: a class carries its
    k + 1 least ids, which is all that k results can need. Rows that repeat an id are rows of their own. Left out: rows with a null id, and null, empty, zero and
    non-finite vectors; shorter vectors count as filled up with zeros. Other columns are not read. No queries or no rows give an empty result.
    """
    vectors = written(valid_vectors(rows, id_col, vec_col), "vectors")
    classes = written(vectors.groupBy("v").agg(F.min("row").alias("cid"), F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    copied = vectors.join(classes.where("n > 1").select("v", "cid"), "v").select("cid", "row", "id")
    alone = vectors.join(classes.where("n = 1").select(F.col("cid").alias("row")), "row").select(F.col("row").alias("cid"), "row", "id")
    everyone = written(copied.union(alone), "members")
    queries = everyone.where(is_query)
    order = Window.partitionBy("cid").orderBy("id", "row")
    members = everyone.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    sample = [r["v"] for r in classes.orderBy(F.xxhash64("v"), "cid").limit(pivots).select("v").collect()]
    if not sample:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    table = np.array(sample, np.float64)
    table /= np.linalg.norm(table, axis=1, keepdims=True)

    def index(batches):
        for b in batches:
            got = prefixes(_matrix(pa.chunked_array([b.column(1)])), table, prefix)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in got], pa.binary())], names=["cid", "v", "low", "prefix"])

    indexed = written(classes.select("cid", "v", "low").mapInArrow(index, "cid long, v array<double>, low long, prefix binary"), "index")
    n_blocks = max(fewest, -(-indexed.count() // block))
    asked = indexed.join(queries.select("cid").distinct(), "cid", "left_semi").withColumn("prefix", F.substring("prefix", 1, 2 * visited))
    asked = written(asked, "queries")
    n_groups = max(1, -(-asked.count() // per_group))
    posted = indexed.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(n_blocks)).cast("int"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(n_groups)).cast("int"))

    def match(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cids, low = left["cid"].to_numpy(), left["low"].to_numpy()
        if not left.num_rows or not right.num_rows:
            got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            files = inverted_files(_prefixes(left["prefix"]), len(table))
            got = search_block(cids, low, _matrix(left["v"]), files, _matrix(right["v"]), _prefixes(right["prefix"]), right["floor"].to_numpy(), k + 1, share, least)
        return pa.table({"q": right["cid"].to_numpy()[got[0]], "cid": pa.array(cids[got[1]], pa.int64()), "low": pa.array(low[got[1]], pa.int64()), "score": pa.array(got[2], pa.float64())})

    best, begin, end = None, 0, min(n_blocks, step)
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "low")  # the classes with the least ids have the k rows of least id among equals
    while begin < n_blocks:
        if best is None:
            floored = asked.withColumn("floor", F.lit(float("-inf")))
        else:  # the worst of k + 1 results so far
            floor = best.groupBy(F.col("q").alias("cid")).agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(float("-inf")).alias("floor"))
            floored = asked.join(floor, "cid")
        left = posted.where((F.col("block") >= begin) & (F.col("block") < end)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        right = floored.withColumn("block", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(match, "q long, cid long, low long, score double")
        found = found if best is None else found.union(best)
        best = written(found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).drop("r"), "nearest")
        begin, end = end, min(n_blocks, end * step)

    single = best.join(members, "cid").select("q", "row", "id", "score")
    asker = queries.select(F.col("cid").alias("q"), F.col("row").alias("asker"), F.col("id").alias("query_id"))
    pairs = single.join(asker, "q").where("row <> asker")
    final = Window.partitionBy("asker").orderBy(F.desc("score"), "id", "row")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
