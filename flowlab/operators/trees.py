"""Tree ensembles grown level by level on Spark aggregates: histogram boosting with early stopping, and extra trees with random cuts.

Rows are written once, their features filled and typed. A level is one pass over them in which every task walks its rows down the trees so far and returns
sums per node, so what moves depends on nodes and features, not on rows. Nodes are numbered as in a heap: the root is 1, the children of k are 2k and 2k + 1.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from flowlab.shared import written


def medians(rows: DataFrame, features: list[str]) -> dict[str, float]:
    """Each feature's median, 0 where it has no values."""
    row = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5, 10_000).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def _filled(features: list[str], fill: dict[str, float]) -> list:
    return [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(fill[f])).alias(f"__x{k}") for k, f in enumerate(features)]


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) if batch.num_rows else np.empty((0, len(names)))


def _with_score(rows: DataFrame, features: list[str], fill: dict[str, float], value) -> DataFrame:
    """The rows, of a table or a stream, with score: ``value`` of their filled features."""
    wide = rows.select("*", *_filled(features, fill))
    xs = [f"__x{k}" for k in range(len(features))]
    schema = StructType(list(rows.schema)).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(xs)], pa.array(value(_matrix(batch, xs)))], names=schema.names)

    return wide.mapInArrow(run, schema)


# Histogram boosting


@dataclass(frozen=True)
class Boosted:
    """``trees``: per tree (feature, -1 in leaves; bin up to which rows go left; value) by heap number. Bounded by rounds and depth."""

    features: list[str]
    fill: dict[str, float]
    cuts: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    losses: list[float] = field(default_factory=list)  # of the held-out rows, before the first tree and after each

    def transform(self, rows: DataFrame) -> DataFrame:
        cuts, base, trees = self.cuts, self.base, self.trees

        def value(x: np.ndarray) -> np.ndarray:
            return _sigmoid(base + _margin(_binned(x, cuts), trees))

        return _with_score(rows, self.features, self.fill, value)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, f.tolist(), b.tolist(), v.tolist()) for k, (f, b, v) in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, feature array<int>, bin array<int>, value array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/trees")
        one = [(self.features, [self.fill[f] for f in self.features], [c.tolist() for c in self.cuts], self.base, self.losses)]
        spark.createDataFrame(one, "features array<string>, fill array<double>, cuts array<array<double>>, base double, losses array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        a = spark.read.schema("features array<string>, fill array<double>, cuts array<array<double>>, base double, losses array<double>").json(f"{path}/about").first()
        rows = spark.read.schema("tree int, feature array<int>, bin array<int>, value array<double>").json(f"{path}/trees").orderBy("tree").collect()  # of the model
        trees = [(np.array(r["feature"], np.int32), np.array(r["bin"], np.int32), np.array(r["value"])) for r in rows]
        return cls(a["features"], dict(zip(a["features"], a["fill"], strict=True)), [np.array(c, float) for c in a["cuts"]], a["base"], trees, list(a["losses"]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)]).astype(np.int32) if len(x) else np.empty((0, len(cuts)), np.int32)


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The heap number of the leaf that each row comes to."""
    node, going, flat = np.ones(len(bins), np.int64), np.arange(len(bins)), np.ascontiguousarray(bins).ravel()
    while len(going):
        at = node[going]
        inner = feature[at] >= 0
        going, at = going[inner], at[inner]
        node[going] = 2 * at + (flat[going * bins.shape[1] + feature[at]] > cut[at])
    return node


def _margin(bins: np.ndarray, trees: list) -> np.ndarray:
    out = np.zeros(len(bins))
    for feature, cut, value in trees:
        out += value[_walk(bins, feature, cut)]
    return out


def _quantile_cuts(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 cuts a feature, by a quantile sketch of all rows; the greatest value is no cut, as nothing lies beyond it."""
    at = [k / bins for k in range(1, bins)]
    row = rows.agg(*[F.percentile_approx(n, at, 10_000).alias(n) for n in names], *[F.max(n).alias(f"{n}_max") for n in names]).first()
    return [np.array(sorted({v for v in row[n] or [] if v < row[f"{n}_max"]})) for n in names]


def boost(rows: DataFrame, features: list[str], y: str, weight: str = "weight", rounds: int = 300, depth: int = 8, rate: float = 0.05, leaves: int = 31, least: int = 20, bins: int = 255, held_out: float = 0.1, patience: int = 20, seed: int = 104, local: int = 1_000_000) -> Boosted:
    """Gradient boosting of the logistic loss. Features are cut into bins once; each level is one pass that adds up gradients and hessians per (node, feature, bin) over all
    rows, exchanged by node, where the best cut is found. Trees grow to ``depth``; of their splits those stay that a growth by greatest gain to ``leaves`` leaves would
    make, with ``least`` rows a leaf. A share ``held_out`` of the rows (by a hash of the row) only measures the loss; growth ends when ``patience`` rounds bring no lower
    one. Without held-out rows all rounds are made. Null features are their median. One class or no rows: a model without trees.

    Rows that agree in all bins, class, weight and share are one unit with a count (``units``). Of up to ``local`` units one task makes all rounds, with the same sums and
    cuts, as jobs of so few would be waiting only."""
    fill = medians(rows, features)
    names = [f"__x{k}" for k in range(len(features))]
    hashed = F.xxhash64(F.lit(seed), *[c for c, kind in rows.dtypes if "map<" not in kind])
    held = (F.pmod(hashed, F.lit(1 << 30)) < int(held_out * (1 << 30))).alias("held")
    plain = rows.select(*_filled(features, fill), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), held)
    plain = written(plain, "boost")
    cuts = _quantile_cuts(plain.where("not held"), names, bins)
    first = plain.agg(F.sum(F.when(~F.col("held"), F.col("w") * F.col("y"))).alias("p"), F.sum(F.when(~F.col("held"), F.col("w"))).alias("w")).first()
    if not first["w"] or not 0 < first["p"] < first["w"]:
        share = min(1 - 1e-9, max(1e-9, (first["p"] or 0.0) / (first["w"] or 1.0)))
        return Boosted(list(features), fill, cuts, float(np.log(share / (1 - share))), [])
    base = float(np.log(first["p"] / (first["w"] - first["p"])))
    table = written(units(plain, names, cuts, ["y", "w", "held"]), "units")
    state = _blocks(table.repartition(_slots(rows.sparkSession)), len(features), base)
    shape = (len(features), 1 + max((len(c) for c in cuts), default=0))
    rule = _Rule(rounds, depth, rate, leaves, least, patience)
    trees, losses = _in_one_task(state, shape, rule) if table.count() <= local else _by_passes(state, shape, rule)
    return Boosted(list(features), fill, cuts, base, trees, losses)


@dataclass(frozen=True)
class _Rule:
    rounds: int
    depth: int
    rate: float
    leaves: int
    least: int
    patience: int


def _rounds(source: _Passes | _Held, rule: _Rule) -> tuple[list, list[float]]:
    """(trees, losses). ``source`` gives the best cuts of a level's open nodes and the loss, and takes each tree."""
    trees, losses = [], []
    while len(trees) < rule.rounds:
        tree = _Growing(rule)
        for level in range(rule.depth):
            cuts, loss = source.level(tree, level == 0)
            if level == 0 and loss is not None:
                losses.append(loss)
                if len(losses) > rule.patience and min(losses[-rule.patience :]) >= min(losses[: -rule.patience]) - 1e-7:
                    return trees, losses
            if not tree.take(cuts):
                break
        if (done := tree.best()) is None:
            break  # nothing to split: all further rounds would be alike
        trees.append(done)
        source.add(done)
    return trees, losses


def units(plain: DataFrame, names: list[str], cuts: list[np.ndarray], keys: list[str]) -> DataFrame:
    """(b0, b1, ...: bins of the features, keys, n): the distinct binned rows and how often each is there. Rows that agree in all of these take the same way through every
    tree, so sums over the units are those over the rows, and passes over many like rows cost as much as over few."""
    shown = ", ".join([f"b{k} int" for k in range(len(names))] + [f"`{c}` {dict(plain.dtypes)[c]}" for c in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(_matrix(batch, names), cuts)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in bins.T), *(batch.column(c) for c in keys)], names=[*(f"b{k}" for k in range(len(names))), *keys])

    rows = plain.select(*names, *keys).mapInArrow(run, shown)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


#: Rows or units whose columns travel as one array each.
BLOCK = 1 << 16
STATE = "block long, bins binary, y binary, w binary, held binary, margin binary, n binary"


def _blocks(table: DataFrame, features: int, base: float) -> DataFrame:
    """Units many at a time, each column as the bytes of one array, so that a pass has them without taking rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, BLOCK):
            bins = np.column_stack([batch.column(k).to_numpy() for k in range(features)]).astype(np.uint16)
            y, w, held, n = (batch.column(c).to_numpy() for c in ("y", "w", "held", "n"))
            yield _block([bins, y.astype(float), w.astype(float), held.astype(bool), np.full(len(y), base), n.astype(float)])

    return table.mapInArrow(run, STATE)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task's batches in tables of about ``rows``."""
    have: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            have.append(batch)
        if sum(b.num_rows for b in have) >= rows:
            yield pa.Table.from_batches(have)
            have = []
    if have:
        yield pa.Table.from_batches(have)


def _slots(spark: SparkSession) -> int:
    """Tasks that the cluster runs at a time."""
    return max(1, spark.sparkContext.defaultParallelism)


def _block(arrays: list[np.ndarray]) -> pa.RecordBatch:
    data = [np.ascontiguousarray(a).tobytes() for a in arrays]
    name = int.from_bytes(hashlib.md5(data[0] + data[1] + data[2] + data[3] + data[5]).digest()[:7])
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([d], pa.binary()) for d in data)], names=[c.split()[0] for c in STATE.split(", ")])


def _state_arrays(row: tuple) -> tuple[np.ndarray, ...]:
    """Of a block: bins, y, w, held, margin, n."""
    bins, *others = (np.frombuffer(data, t) for data, t in zip(row[1:], (np.uint16, float, float, bool, float, float), strict=True))
    return bins.reshape(len(others[0]), -1).astype(np.int32), *others


def _sums(arrays: tuple[np.ndarray, ...], tree: _Growing, shape: tuple[int, int]) -> np.ndarray:
    """(3, open nodes, features, bins): sums of gradients, hessians and rows."""
    bins, y, w, held, margin, n = arrays
    bins, g, h, n = _gradients(bins[~held], y[~held], w[~held], margin[~held], n[~held])
    slot = tree.slots()[_walk(bins, tree.feature, tree.cut)]
    own = np.flatnonzero(slot >= 0)
    return _histograms(bins[own].T, slot[own], (g[own], h[own], n[own]), len(tree.open), shape)


def _gradients(bins: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    p = _sigmoid(margin)
    return bins, w * n * (p - y), w * n * p * (1 - p), n


def _histograms(columns: list[np.ndarray] | np.ndarray, slot: np.ndarray, values: tuple, nodes: int, shape: tuple[int, int]) -> np.ndarray:
    """(values, nodes, features, bins): sums of the values by node and bin, a feature at a time."""
    out, first = np.empty((len(values), nodes, *shape)), slot * shape[1]
    for f, bins in enumerate(columns):
        cell = first + bins
        for k, v in enumerate(values):
            out[k, :, f] = np.bincount(cell, v, nodes * shape[1]).reshape(nodes, shape[1])
    return out


def _loss(arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of the held-out rows: the weighted loss and the weight."""
    _, y, w, _, z, n = (a[arrays[3]] for a in arrays)
    w = w * n
    return np.array([np.sum(w * (np.logaddexp(0, z) - y * z)), np.sum(w)])


def _best_cut(sums: np.ndarray, least: int) -> tuple:
    """(feature, bin, gain, g, h, n of the left side, all g, h, n) of a node's sums (3, features, bins); ties: the least feature, then bin. Without an allowed cut the feature is -1."""
    left = np.cumsum(sums, 2)
    every = left[:, 0, -1]
    (g, h, n), (og, oh, on) = left, every[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / h + og * og / oh - every[0] ** 2 / every[1]
    gain = np.where((n >= least) & (on >= least) & (h > 1e-3) & (oh > 1e-3), gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    f_ = int(f) if gain[f, b] > 0 else -1
    return (f_, int(b), float(gain[f, b]) if f_ >= 0 else 0.0, *(float(x[f, b]) for x in (g, h, n)), *map(float, every))


class _Held:
    """All units in one task. Within a tree the units' gradients and nodes are kept from level to level."""

    def __init__(self, arrays: tuple[np.ndarray, ...], shape: tuple[int, int]) -> None:
        self.arrays, self.shape, self.train = arrays, shape, np.flatnonzero(~arrays[3])
        self.bins = np.ascontiguousarray(arrays[0][self.train])
        self.columns = [self.bins[:, f].astype(np.int64) for f in range(shape[0])]

    def level(self, tree: _Growing, measure: bool) -> tuple[list, float | None]:
        loss, wide = _loss(self.arrays) if measure else (0, 0), self.shape[0]
        if tree.open == [1]:
            _, *self.values = _gradients(self.bins, *(a[self.train] for a in (*self.arrays[1:3], *self.arrays[4:])))
            self.at, self.node = np.arange(len(self.train)), np.ones(len(self.train), np.int64)
        else:
            f = tree.feature[self.node]
            self.node = 2 * self.node + (self.bins.ravel()[self.at * wide + f] > tree.cut[self.node])
        slot = tree.slots()[self.node]
        if len(stay := np.flatnonzero(slot >= 0)) < len(slot):
            self.at, self.node, slot = self.at[stay], self.node[stay], slot[stay]
        whole = len(self.at) == len(self.train)
        sums = _histograms([c if whole else c[self.at] for c in self.columns], slot, tuple(v if whole else v[self.at] for v in self.values), len(tree.open), self.shape)
        return [(k, *_best_cut(sums[:, k], tree.rule.least)) for k in range(len(tree.open))], float(loss[0] / loss[1]) if loss[1] else None

    def add(self, tree: tuple) -> None:
        self.arrays = (*self.arrays[:4], self.arrays[4] + _margin(self.arrays[0], [tree]), self.arrays[5])


def _in_one_task(state: DataFrame, shape: tuple[int, int], rule: _Rule) -> tuple[list, list[float]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_state_arrays(row) for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)]
        made = _rounds(_Held(tuple(np.concatenate(x) for x in zip(*parts, strict=True)), shape), rule)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["made"])

    return pickle.loads(state.coalesce(1).mapInArrow(run, "made binary").first()["made"])  # noqa: S301 (our own task's, some MB at most)


def _by_passes(state: DataFrame, shape: tuple[int, int], rule: _Rule) -> tuple[list, list[float]]:
    source = _Passes(state.sparkSession, state.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK), shape)
    try:
        return _rounds(source, rule)
    finally:
        source.blocks.unpersist()


@dataclass
class _Passes:
    """Units in blocks that the executors keep, one job of one stage for each level: a task's sums per open node, feature and bin go to the driver, where there are as many as
    tasks. A tree's values are added to the margins by the next pass; every ``CUT`` trees the blocks are written, which ends their lineage."""

    spark: SparkSession
    blocks: RDD
    shape: tuple[int, int]
    made: int = 0
    old: RDD | None = None

    CUT = 16

    def add(self, tree: tuple) -> None:
        def with_tree(row: tuple) -> tuple:
            arrays = _state_arrays(row)
            return *row[:5], (arrays[4] + _margin(arrays[0], [tree])).tobytes(), row[6]

        self.old, self.made = self.blocks, self.made + 1
        moved = self.blocks.map(with_tree)
        if self.made % self.CUT == 0:
            moved = written(self.spark.createDataFrame(moved, STATE, verifySchema=False), "boost").rdd.map(tuple)
        self.blocks = moved.persist(StorageLevel.MEMORY_AND_DISK)

    def level(self, tree: _Growing, measure: bool) -> tuple[list, float | None]:
        shape = (len(tree.open), *self.shape)

        def add_up(rows: Iterator[tuple]) -> Iterator[tuple]:
            sums, lost = np.zeros((3, *shape)), np.zeros(2)
            for row in rows:
                arrays = _state_arrays(row)
                sums += _sums(arrays, tree, shape[1:])
                lost += _loss(arrays) if measure else 0
            yield sums, lost

        parts = self.blocks.mapPartitions(add_up).collect()
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        sums, lost = (sum(x[1:], x[0]) for x in zip(*parts, strict=True))
        return [(k, *_best_cut(sums[:, k], tree.rule.least)) for k in range(shape[0])], float(lost[0] / lost[1]) if lost[1] else None


class _Growing:
    """A tree that is being grown: arrays by heap number, and the nodes that the next level may split, in order."""

    def __init__(self, rule: _Rule) -> None:
        self.rule, depth = rule, rule.depth
        self.feature = np.full(2 << depth, -1, np.int32)
        self.cut = np.zeros(2 << depth, np.int32)
        self.gain = np.zeros(2 << depth)
        self.sums = np.zeros((2 << depth, 2))
        self.open = [1]

    def take(self, cuts: list[tuple]) -> bool:
        """Splits the open nodes by their best cuts and opens the children that may be split; whether there are any."""
        opened = []
        for slot, feature, cut, gain, g, h, n, all_g, all_h, all_n in cuts:
            node = self.open[slot]
            self.sums[node] = all_g, all_h
            if feature >= 0:
                self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
                self.sums[2 * node], self.sums[2 * node + 1] = (g, h), (all_g - g, all_h - h)
                opened += [c for c, size in ((2 * node, n), (2 * node + 1, all_n - n)) if size >= 2 * self.rule.least]
        self.open = opened
        likely = set(self._greatest())  # children can only push others out
        self.open = sorted(c for c in opened if c // 2 in likely)
        return bool(self.open)

    def slots(self) -> np.ndarray:
        """By heap number the place among the open nodes, -1 if it is not open."""
        out = np.full(len(self.feature), -1, np.int64)
        out[self.open] = np.arange(len(self.open))
        return out

    def _greatest(self) -> list[int]:
        """The splits that a growth by greatest gain makes until there are enough leaves: a split's gain does not depend on the order."""
        edge, kept = [1] if self.feature[1] >= 0 else [], []
        while edge and len(kept) + 1 < self.rule.leaves:
            node = max(edge, key=lambda k: (self.gain[k], -k))
            edge.remove(node)
            kept.append(node)
            edge += [c for c in (2 * node, 2 * node + 1) if self.feature[c] >= 0]
        return kept

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The tree of the kept splits; None without any."""
        if not (kept := self._greatest()):
            return None
        feature = np.full_like(self.feature, -1)
        feature[kept] = self.feature[kept]
        value = -self.rule.rate * self.sums[:, 0] / np.maximum(self.sums[:, 1], 1e-12)
        return feature, self.cut.copy(), value


# Extra trees


@dataclass(frozen=True)
class ExtraTrees:
    """``nodes``: a table (tree, node, feature, cut, p), feature -1 in leaves; p the share of the second class there. ``packed``: the same as a row per tree (``PACKED``), where
    there is one."""

    features: list[str]
    fill: dict[str, float]
    nodes: DataFrame
    trees: int
    per_pass: int = 2_000_000
    packed: DataFrame | None = None

    def transform(self, rows: DataFrame) -> DataFrame:
        """A forest of up to ``SENT`` nodes goes to the rows' tasks by way of the driver, and so does a larger one for a stream, in groups of ``per_pass`` nodes; else rows and
        trees meet in the tasks of ``_point_scores``."""
        forest = self.packed if self.packed is not None else written(_packed(self.nodes), "forest")
        sizes = [tuple(r) for r in forest.select("tree", "size").orderBy("tree").collect()]  # a row per tree
        xs = [f"__x{k}" for k in range(len(self.features))]
        wide = rows.select("*", *_filled(self.features, self.fill))
        if not rows.isStreaming and sum(n for _, n in sizes) > min(SENT, self.per_pass):
            scores = _point_scores(wide.select(xs).distinct(), xs, forest, sizes)
            return wide.join(scores, xs).select(*rows.columns, "score")
        groups, size = [[]], 0
        for tree, n in sizes:
            if groups[-1] and size + n > self.per_pass:
                groups.append([])
                size = 0
            groups[-1].append(tree)
            size += n
        wide = wide.withColumn("__sum", F.lit(0.0))
        for group in groups if sizes else []:
            parts = [_arrays(r["feature"], r["value"], r["low"]) for r in forest.where(F.col("tree").between(group[0], group[-1])).orderBy("tree").collect()]
            wide = wide.mapInArrow(_adder(rows.sparkSession.sparkContext.broadcast(parts), xs), wide.schema)
        return wide.withColumn("score", F.col("__sum") / max(1, len(sizes))).drop(*xs, "__sum")

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.features, [self.fill[f] for f in self.features], self.trees)], "features array<string>, fill array<double>, trees int").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExtraTrees:
        a = spark.read.schema("features array<string>, fill array<double>, trees int").json(f"{path}/about").first()
        return cls(a["features"], dict(zip(a["features"], a["fill"], strict=True)), spark.read.parquet(f"{path}/nodes"), a["trees"])


#: A tree: its number of nodes, and the bytes of an array each for the nodes' features (-1 in leaves), their cuts or shares, and the places of the left children; the right ones
#: stand behind these, and the root is first.
PACKED = "tree int, size int, feature binary, value binary, low binary"


def _packed(nodes: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, feature, cut, p = (table.column(c).to_numpy() for c in ("node", "feature", "cut", "p"))
        return _packed_row(table.column("tree")[0].as_py(), feature, np.where(feature < 0, p, cut), np.searchsorted(node, 2 * node))

    return nodes.select("tree", "node", "feature", "cut", "p").groupBy("tree").applyInArrow(run, PACKED)


def _packed_row(tree: int, feature: np.ndarray, value: np.ndarray, low: np.ndarray) -> pa.Table:
    data = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((feature, np.int16), (value, float), (low, np.int32))]
    return pa.table([pa.array([tree], pa.int32()), pa.array([len(feature)], pa.int32()), *data], names=[c.split()[0] for c in PACKED.split(", ")])


def _unpacked(forest: DataFrame) -> DataFrame:
    """(tree, node, feature, cut, p) of packed trees, nodes numbered as in a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, _, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                feature, value, low = _arrays(*data)
                node, level = np.ones(len(feature), np.int64), np.zeros(1, np.int64)
                while len(level := level[feature[level] >= 0]):
                    node[low[level]], node[low[level] + 1] = 2 * node[level], 2 * node[level] + 1
                    level = np.concatenate([low[level], low[level] + 1])
                leaf = feature < 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), tree, np.int32)), pa.array(node), pa.array(feature.astype(np.int32)), pa.array(np.where(leaf, 0.0, value)), pa.array(np.where(leaf, value, 0.0))], names=["tree", "node", "feature", "cut", "p"])

    return forest.mapInArrow(run, "tree int, node long, feature int, cut double, p double")


def _arrays(feature: bytes, value: bytes, low: bytes) -> tuple[np.ndarray, ...]:
    return np.frombuffer(feature, np.int16), np.frombuffer(value), np.frombuffer(low, np.int32)


def _leaf_shares(x: np.ndarray, feature: np.ndarray, value: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A tree's share for each row."""
    flat, out, going, at = x.ravel(), np.zeros(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(going):
        f = feature[at]
        inner = f >= 0
        if not inner.all():
            out[going[~inner]] = value[at[~inner]]
            going, at, f = going[inner], at[inner], f[inner]
        at = low[at] + (flat[going * x.shape[1] + f] > value[at])
    return out


def _adder(forest, xs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, total = _matrix(batch, xs), np.zeros(batch.num_rows)
            for tree in forest.value:
                total += _leaf_shares(x, *tree)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column(len(names) - 1).to_numpy(zero_copy_only=False) + total)], names=names)

    return run


#: Nodes that the driver may have at a time: 3 MB.
SENT = 200_000
#: Rows and nodes that meet in a task when a large forest scores rows: 80 MB of five features, 140 MB of nodes.
TASK_POINTS, TASK_NODES = 2_000_000, 10_000_000


def _point_scores(points: DataFrame, xs: list[str], forest: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """(features, score) of distinct points. These and the trees are dealt into groups, and each pair of a group of points and one of trees meets in a task, so the driver has no
    trees, and a task a bounded part of both. The sums of a block's groups of trees are added in their order: equal points have equal scores."""
    spark, wide = points.sparkSession, len(xs)
    blocks = written(_point_blocks(points, xs), "points")
    count = blocks.agg(F.sum("n")).first()[0] or 0
    parts, groups = max(1, -(-count // TASK_POINTS)), min(len(sizes), max(2 * _slots(spark), -(-sum(n for _, n in sizes) // TASK_NODES)))
    none = {c: F.lit(None).cast(t) for c, t in (("tree", "int"), ("feature", "binary"), ("value", "binary"), ("low", "binary"), ("block", "long"), ("x", "binary"))}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("g", every(groups)).select((F.col("g") * parts + F.pmod("block", F.lit(parts))).cast("int").alias("task"), *[F.col(c) if c in ("block", "x") else v.alias(c) for c, v in none.items()])
    right = forest.withColumn("part", every(parts)).select((F.pmod("tree", F.lit(groups)) * parts + F.col("part")).cast("int").alias("task"), *[v.alias(c) if c in ("block", "x") else F.col(c) for c, v in none.items()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, own, task = [], [], 0
        for batch in batches:
            for task, tree, feature, value, low, block, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007 (the task's own number)
                if tree is None:
                    own.append((block, x))
                else:
                    trees.append((tree, _arrays(feature, value, low)))
        trees.sort(key=lambda t: t[0])
        for block, data in own:
            x = np.frombuffer(data).reshape(-1, wide)
            total = np.zeros(len(x))
            for _, tree in trees:
                total += _leaf_shares(x, *tree)
            group = task // parts
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([group], pa.int32()), pa.array([data if group == 0 else None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["block", "g", "x", "sums"])

    def add_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        total = sum(np.frombuffer(data.as_buffer()) for data in table.column("sums"))
        x = np.frombuffer(table.column("x")[0].as_buffer()).reshape(-1, wide)
        return pa.table([*(pa.array(np.ascontiguousarray(c)) for c in x.T), pa.array(total / len(sizes))], names=[*xs, "score"])

    sums = left.unionByName(right).repartitionById(groups * parts, "task").mapInArrow(meet, "block long, g int, x binary, sums binary")
    return written(sums.groupBy("block").applyInArrow(add_up, ", ".join(f"{c} double" for c in [*xs, "score"])), "scores")


def _point_blocks(points: DataFrame, xs: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, BLOCK // 2):
            x = _matrix(batch, xs)
            data = x[np.lexsort(x.T[::-1])].tobytes()  # neighbours take like ways
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(hashlib.md5(data).digest()[:7])], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([data], pa.binary())], names=["block", "n", "x"])

    return points.mapInArrow(run, "block long, n long, x binary")


@dataclass
class _Top:
    """The upper nodes of a forest, by (tree, node): a split (feature, cut) or a closed node. ``rest``: nodes with few enough rows, whose subtrees are grown in one task each."""

    splits: list[dict[int, tuple[int, float]]]

    def walk(self, tree: int, x: np.ndarray) -> np.ndarray:
        node, splits = np.ones(len(x), np.int64), self.splits[tree]
        todo = [(1, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if k in splits and len(rows):
                f, cut = splits[k]
                right = x[rows, f] > cut
                todo += [(2 * k, rows[~right]), (2 * k + 1, rows[right])]
            else:
                node[rows] = k
        return node


def extra_trees(rows: DataFrame, features: list[str], y: str, weight: str = "weight", trees: int = 500, depth: int = 24, least: int = 2, tried: int | None = None, seed: int = 104, local: int = 4_000_000, lower: int = 20_000) -> ExtraTrees:
    """Trees on all rows whose splits have random cuts: at every node ``tried`` features (by default the root of their number) that are not constant there get a cut drawn
    between their least and greatest value, and the cut of greatest Gini gain splits, if both sides have ``least`` rows. Null features are their median; no rows give no nodes.

    Rows that agree in all features are one point with a count of each class. Up to ``local`` points go to every task that grows trees (48 bytes a point of five features), and
    a task grows its share of the trees from them. Of more points, or where a class has several weights, nodes of more than ``lower`` rows are split level by level for all
    trees at once: one pass for the ranges of the features, one for the sums beside the cuts; the rows of a smaller node go to one task, which grows the node's subtree."""
    fill = medians(rows, features)
    names = [f"__x{k}" for k in range(len(features))]
    tried = tried or max(1, int(len(features) ** 0.5))
    data = written(rows.select(*_filled(features, fill), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")), "extra")
    by_class = [tuple(r) for r in data.groupBy("y").agg(F.min("w"), F.max("w"), F.count(F.lit(1))).limit(3).collect()]
    if all(c in (0.0, 1.0) and low is not None and 0 < low == high and n < 1 << 31 for c, low, high, n in by_class):
        points = written(_points(data, names), "points")
        if (points.agg(F.sum("n")).first()[0] or 0) <= local:
            weights = {c: low for c, low, _, _ in by_class}
            forest = written(_grown(points, len(features), [weights.get(c, 0.0) for c in (0.0, 1.0)], trees, depth, least, tried, seed), "forest")
            return ExtraTrees(list(features), fill, _unpacked(forest), trees, packed=forest)
    local = min(local, lower)
    spark, top = rows.sparkSession, _Top([{} for _ in range(trees)])
    whole = data.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("w")).first()
    leaves: list[tuple] = []
    open_nodes = {(t, 1): (whole["n"], whole["p"] or 0.0, whole["w"] or 0.0) for t in range(trees)} if whole["n"] > local else {}
    level = 0
    while open_nodes:
        ranges = _node_ranges(data, names, top, set(open_nodes))
        drawn = {}
        for (t, node), span in ranges.items():
            rng = np.random.default_rng([seed, t, node])
            able = [f for f in rng.permutation(len(features)) if span[f][0] < span[f][1]][:tried]
            drawn[t, node] = [(int(f), float(rng.uniform(*span[f]))) for f in able]
        sums = _cut_sums(data, names, top, drawn)
        further = {}
        for key, (n, p, w) in open_nodes.items():
            best = None
            for k, (f, cut) in enumerate(drawn.get(key, [])):
                ln, lp, lw = sums.get((*key, k), (0, 0.0, 0.0))
                if min(ln, n - ln) >= least and lw > 0 and w - lw > 0:
                    gain = (lp**2 + (lw - lp) ** 2) / lw + ((p - lp) ** 2 + (w - lw - p + lp) ** 2) / (w - lw)
                    if best is None or gain > best[0]:
                        best = gain, f, cut, (ln, lp, lw)
            t, node = key
            if best is None or not 0 < p < w:
                leaves.append((t, node, -1, 0.0, p / w if w else 0.0))
                continue
            top.splits[t][node] = best[1:3]
            leaves.append((t, node, best[1], best[2], 0.0))
            ln, lp, lw = best[3]
            for child, own in ((2 * node, (ln, lp, lw)), (2 * node + 1, (n - ln, p - lp, w - lw))):
                if own[0] > local and level + 1 < depth:
                    further[t, child] = own
                elif own[0] > local:
                    leaves.append((t, child, -1, 0.0, own[1] / own[2]))
        open_nodes, level = further, level + 1
    upper = spark.createDataFrame(leaves, "tree int, node long, feature int, cut double, p double")
    closed = {(t, node) for t, node, f, _, _ in leaves if f < 0}
    lower = _subtrees(data, names, top, closed, trees, depth, least, tried, seed)
    return ExtraTrees(list(features), fill, written(upper.unionByName(lower), "forest"), trees)


def _points(data: DataFrame, names: list[str]) -> DataFrame:
    """(n, x, counts): blocks of the distinct points with their rows of each class, those of the second class in a count's upper half."""
    each = data.groupBy(*names).agg(F.sum(F.when(F.col("y") == 1, F.lit(1 << 32)).otherwise(F.lit(1))).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([_matrix(batch, names).tobytes()], pa.binary()), pa.array([batch.column("counts").to_numpy().tobytes()], pa.binary())], names=["n", "x", "counts"])

    return each.mapInArrow(run, "n long, x binary, counts binary")


def _grown(points: DataFrame, features: int, weights: list[float], trees: int, depth: int, least: int, tried: int, seed: int) -> DataFrame:
    """Packed trees, each task's grown from all points."""
    tasks = min(trees, 2 * _slots(points.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not blocks:
            return
        task = blocks[0][0]
        x = np.concatenate([np.frombuffer(b[1]).reshape(-1, features) for b in blocks])
        counts = np.concatenate([np.frombuffer(b[2], np.int64) for b in blocks])
        del blocks
        order = np.lexsort(x.T[::-1])  # the same trees in whatever order the blocks come
        x, counts = x[order], counts[order]
        for t in range(task, trees, tasks):
            yield from _packed_row(t, *grow_points(x, counts, weights, depth, least, tried, np.random.default_rng([seed, t]))).to_batches()

    every = points.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "x", "counts")
    return every.repartitionById(tasks, "task").mapInArrow(run, PACKED)


def grow_points(x: np.ndarray, counts: np.ndarray, weights: list[float], depth: int, least: int, tried: int, rng: np.random.Generator, block: int = 2 * BLOCK) -> tuple[np.ndarray, ...]:
    """(feature, cut or share, place of the left child) of a tree's nodes. All nodes of a level are split at once, until there are more rows than a ``block``: then runs of nodes
    of that many rows go on by themselves, with copies of their rows, which keeps these in the processor's cache. A count's halves are the rows of either class."""
    width, made, out, low_half = x.shape[1], 1, [[], [], [], []], np.int64((1 << 32) - 1)
    todo = [(np.ascontiguousarray(x).ravel(), counts, np.arange(len(counts)), np.array([len(counts)]), np.zeros(1, np.int64), np.zeros((1, width), bool), 0)]
    while todo:
        # rows in the order of their nodes; per node its rows, place, and the features known to be constant
        flat, have, at, sizes, ids, fixed, level = todo.pop()
        if 2 * len(at) <= len(have) and len(have) > block:
            flat, have, at = flat.reshape(-1, width)[at].ravel(), have[at], np.arange(len(at))
        starts, every, own, base = np.cumsum(sizes) - sizes, np.arange(len(ids)), have[at], at * width
        total = np.add.reduceat(own, starts)
        all_1, all_n = total >> 32, (total >> 32) + (total & low_half)
        feature, cut, best = np.full(len(ids), -1), np.zeros(len(ids)), np.full(len(ids), -np.inf)
        wants = np.where((all_n >= 2 * least) & (all_1 > 0) & (all_1 < all_n) & (level < depth), tried, 0)
        draw, right = np.argsort(rng.random(fixed.shape), 1), np.zeros(len(at), bool)
        for k in range(width):
            asks = (wants > 0) & ~fixed[every, draw[:, k]]
            some = np.flatnonzero(asks)
            if not len(some):
                continue
            f, n = draw[some, k], sizes[some]
            rows = np.flatnonzero(np.repeat(asks, sizes)) if len(some) < len(ids) else slice(None)
            first = np.cumsum(n) - n
            v = flat[base[rows] + np.repeat(f, n)]
            low, high = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
            varies = low < high
            fixed[some[~varies], f[~varies]] = True
            wants[some] -= varies
            c = low + (high - low) * rng.random(len(some))
            over = v > np.repeat(c, n)
            beyond = np.add.reduceat(own[rows] * over, first)
            r1, rn = beyond >> 32, (beyond >> 32) + (beyond & low_half)
            l1, ln = all_1[some] - r1, all_n[some] - rn
            rp, lp, ro, lo = r1 * weights[1], l1 * weights[1], (rn - r1) * weights[0], (ln - l1) * weights[0]
            ok = varies & (ln >= least) & (rn >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (lp**2 + lo**2) / (lp + lo) + (rp**2 + ro**2) / (rp + ro)
            ok &= np.where(ok, gain, -np.inf) > best[some]
            won, takes = some[ok], np.repeat(ok, n)
            feature[won], cut[won], best[won] = f[ok], c[ok], gain[ok]
            if isinstance(rows, slice):
                np.copyto(right, over, where=takes)
            else:
                right[rows[takes]] = over[takes]
        split = feature >= 0
        child = np.where(split, made + 2 * (np.cumsum(split) - 1), 0)
        p, o = all_1 * weights[1], (all_n - all_1) * weights[0]
        for column, value in zip(out, (ids, feature, np.where(split, cut, np.divide(p, p + o, out=np.zeros(len(ids)), where=p + o > 0)), child), strict=True):
            column.append(value)
        made += 2 * int(split.sum())
        if not split.any():
            continue
        stays, n = np.repeat(split, sizes), sizes[split]
        at, right = at[stays], right[stays]
        node = np.repeat(np.arange(0, 2 * len(n), 2), n) + right
        at = at[np.argsort(node.astype(np.uint16) if 2 * len(n) <= 1 << 16 else node, kind="stable")]
        beyond = np.add.reduceat(right, np.cumsum(n) - n, dtype=np.int64)
        sizes, ids, fixed = np.column_stack([n - beyond, beyond]).ravel(), np.column_stack([child[split], child[split] + 1]).ravel(), np.repeat(fixed[split], 2, 0)
        ends = np.cumsum(sizes)
        begin = 0
        for end in [*(np.flatnonzero(np.diff((ends - 1) // block)) + 1).tolist(), len(ids)]:
            todo.append((flat, have, at[ends[begin] - sizes[begin] : ends[end - 1]], sizes[begin:end], ids[begin:end], fixed[begin:end], level + 1))
            begin = end
    place = np.concatenate(out[0])
    tree = []
    for column in out[1:]:
        values = np.concatenate(column)
        tree.append(np.empty_like(values))
        tree[-1][place] = values
    return tuple(tree)


def _per_tree(batch: pa.RecordBatch, names: list[str], top: _Top, wanted) -> Iterator[tuple]:
    """(tree, node, rows, x) of the batch's rows in each wanted node."""
    x = _matrix(batch, names)
    for t in range(len(top.splits)):
        node = top.walk(t, x)
        order = np.argsort(node, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if len(part) and wanted(t, int(node[part[0]])):
                yield t, int(node[part[0]]), part, x


def _node_ranges(data: DataFrame, names: list[str], top: _Top, open_nodes: set) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict = {}
        for batch in batches:
            for t, node, part, x in _per_tree(batch, names, top, lambda t, k: (t, k) in open_nodes) if batch.num_rows else ():
                own = x[part].min(0), x[part].max(0)
                was = low.get((t, node))
                low[t, node] = own if was is None else (np.minimum(was[0], own[0]), np.maximum(was[1], own[1]))
        rows = [(t, node, f, a[f], b[f]) for (t, node), (a, b) in low.items() for f in range(len(names))]
        yield _table(rows, "iiidd", ["tree", "node", "feature", "low", "high"])

    got = data.mapInArrow(run, "tree long, node long, feature long, low double, high double").groupBy("tree", "node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict = {}
    for r in got.collect():  # open nodes have many rows each, so these are few
        out.setdefault((r["tree"], r["node"]), {})[r["feature"]] = (r["low"], r["high"])
    return out


def _cut_sums(data: DataFrame, names: list[str], top: _Top, drawn: dict) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            for t, node, part, x in _per_tree(batch, names, top, lambda t, k: (t, k) in drawn):
                for k, (f, cut) in enumerate(drawn[t, node]):
                    left = part[x[part, f] <= cut]
                    was = sums.get((t, node, k), (0, 0.0, 0.0))
                    sums[t, node, k] = was[0] + len(left), was[1] + float(np.sum(w[left] * y[left])), was[2] + float(np.sum(w[left]))
        yield _table([(*key, *v) for key, v in sums.items()], "iiiidd", ["tree", "node", "k", "n", "p", "w"])

    got = data.mapInArrow(run, "tree long, node long, k long, n long, p double, w double").groupBy("tree", "node", "k").agg(*[F.sum(c).alias(c) for c in ("n", "p", "w")])
    return {(r["tree"], r["node"], r["k"]): (r["n"], r["p"], r["w"]) for r in got.collect()}


def _table(rows: list, kinds: str, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "i" else pa.float64()) for c, k in zip(columns, kinds, strict=True)], names=names)


def _subtrees(data: DataFrame, names: list[str], top: _Top, closed: set, trees: int, depth: int, least: int, tried: int, seed: int) -> DataFrame:
    """The nodes below the upper ones: a node's rows, packed by the task that reads them, meet in one task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            for t, node, part, x in _per_tree(batch, names, top, lambda t, k: (t, k) not in closed):
                own = np.ascontiguousarray(np.column_stack([x[part], y[part], w[part]]))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([node], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["tree", "node", "rows"])

    def grow(table: pa.Table) -> pa.Table:
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        parts = sorted(table.column("rows").to_pylist())  # the same tree in whatever order the parts come
        rows = np.frombuffer(b"".join(parts), float).reshape(-1, len(names) + 2)
        got = grow_extra(rows[:, :-2], rows[:, -2], rows[:, -1], node, depth, least, tried, np.random.default_rng([seed, t, node]))
        return pa.table([pa.array(np.full(len(got[0]), t, np.int32)), pa.array(got[0]), pa.array(got[1].astype(np.int32)), pa.array(got[2]), pa.array(got[3])], names=["tree", "node", "feature", "cut", "p"])

    packed = data.mapInArrow(pack, "tree int, node long, rows binary")
    return packed.groupBy("tree", "node").applyInArrow(grow, "tree int, node long, feature int, cut double, p double")


def grow_extra(x: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, depth: int, least: int, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(node, feature, cut, p) of the subtree of ``root``: all nodes of a level are split at once."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    heap = np.array([root], np.int64)  # the level's nodes
    at = np.zeros(len(x), np.int64)  # each row's place among them
    level = root.bit_length() - 1
    while len(heap):
        order = np.argsort(at, kind="stable")
        x, y, w, at = x[order], y[order], w[order], at[order]
        starts = np.searchsorted(at, np.arange(len(heap)))
        n, p, all_w = np.bincount(at, minlength=len(heap)), np.bincount(at, w * y, len(heap)), np.bincount(at, w, len(heap))
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        feature, cut, best = np.full(len(heap), -1), np.zeros(len(heap)), np.full(len(heap), -np.inf)
        able = (n >= 2 * least) & (p > 0) & (p < all_w) & (level < depth)
        draw = np.where((low < high) & able[:, None], rng.random(low.shape), np.inf)
        choice = np.argsort(draw, 1)[:, :tried]
        for k in range(choice.shape[1]):
            f = choice[:, k]
            ok = np.isfinite(draw[np.arange(len(heap)), f])
            lo, hi = low[np.arange(len(heap)), f], high[np.arange(len(heap)), f]
            c = lo + (hi - lo) * rng.random(len(heap))
            left = x[np.arange(len(x)), f[at]] <= c[at]
            ln, lp, lw = np.bincount(at[left], minlength=len(heap)), np.bincount(at[left], (w * y)[left], len(heap)), np.bincount(at[left], w[left], len(heap))
            ok &= (ln >= least) & (n - ln >= least) & (lw > 0) & (all_w > lw)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (lp**2 + (lw - lp) ** 2) / lw + ((p - lp) ** 2 + (all_w - lw - p + lp) ** 2) / (all_w - lw)
            ok &= np.where(ok, gain, -np.inf) > best
            feature[ok], cut[ok], best[ok] = f[ok], c[ok], gain[ok]
        for column, v in zip(out, (heap, feature, cut, np.where(feature < 0, np.divide(p, all_w, out=np.zeros(len(heap)), where=all_w > 0), 0.0)), strict=True):
            column.append(v)
        split = np.flatnonzero(feature >= 0)
        place = np.full(len(heap), -1)
        place[split] = 2 * np.arange(len(split))
        stays = place[at] >= 0
        x, y, w, at = x[stays], y[stays], w[stays], at[stays]
        at = place[at] + (x[np.arange(len(x)), feature[at]] > cut[at])
        heap = np.column_stack([2 * heap[split], 2 * heap[split] + 1]).ravel()
        level += 1
    return tuple(np.concatenate(c) for c in out)


# Random forest


@dataclass(frozen=True)
class Forest(ExtraTrees):
    """Nodes as of extra trees, and gain: the weighted Gini decrease of each split."""

    def importances(self) -> list[float]:
        """Each feature's share of the decrease, a tree's shares adding up to one before the trees are averaged."""
        sums = self.nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        share = sums.join(sums.groupBy("tree").agg(F.sum("g").alias("all")), "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("s"))
        found = {r["feature"]: r["s"] for r in share.collect()}  # a row per feature
        total = sum(found.values()) or 1.0
        return [found.get(k, 0.0) / total for k in range(len(self.features))]


def random_forest(rows: DataFrame, features: list[str], y: str, weight: str, trees: int, depth: int, bins: int = 32, seed: int = 104, local: int = 200_000) -> Forest | None:
    """A forest on all rows, of bootstrapped trees that take the best of the bins' cuts in a random root of the features at every node. Rows are binned and counted by ``units``;
    a unit's draws for a tree are Poisson of its count, as the sum of its rows' draws is. Each tree is grown in a task of its own. None where the rows are over ``local``
    units, which are too many for a task."""
    fill = medians(rows, features)
    names = [f"__x{k}" for k in range(len(features))]
    plain = written(rows.select(*_filled(features, fill), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w")), "forest")
    cuts = _quantile_cuts(plain, names, bins)
    table = written(units(plain, names, cuts, ["y", "w"]), "units")
    if table.count() > local:
        return None
    spark, tried = rows.sparkSession, math.ceil(len(features) ** 0.5)
    every = table.orderBy(*table.columns).toPandas()  # of ``local`` rows at most
    given = spark.sparkContext.broadcast((every[[f"b{k}" for k in range(len(features))]].to_numpy(np.int64), *(every[c].to_numpy(float) for c in ("y", "w", "n"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                node, feature, cut, p, gain = grow_forest(*given.value, depth, tried, np.random.default_rng([seed, t]))
                at = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature.tolist(), cut.tolist(), strict=True)], float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), pa.array(node), pa.array(feature.astype(np.int32)), pa.array(at), pa.array(p), pa.array(gain)], names=["tree", "node", "feature", "cut", "p", "gain"])

    grown = spark.range(0, trees if len(every) else 0, 1, trees).mapInArrow(run, "tree int, node long, feature int, cut double, p double, gain double")
    return Forest(list(features), fill, written(grown, "forest"), trees)


def grow_forest(bins: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, depth: int, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(node, feature, bin up to which units go left, p, gain) of a tree on a bootstrap of the units: all nodes of a level are split at once."""
    drawn = rng.poisson(n)
    if not drawn.any():
        drawn = n.astype(np.int64)  # the draws of one row may all be none
    bins, y, w, drawn = (a[drawn > 0] for a in (bins, y, w, drawn))
    w, width, out = w * drawn, 1 + int(bins.max(initial=0)), [[], [], [], [], []]
    p_, heap, at, level = w * y, np.array([1], np.int64), np.zeros(len(y), np.int64), 0
    while len(heap):
        order = np.argsort(at, kind="stable")
        bins, w, p_, drawn, at = bins[order], w[order], p_[order], drawn[order], at[order]
        starts, every = np.searchsorted(at, np.arange(len(heap))), np.arange(len(heap))
        all_n, all_p, all_w = (np.bincount(at, v, len(heap)) for v in (drawn, p_, w))
        low, high = np.minimum.reduceat(bins, starts), np.maximum.reduceat(bins, starts)
        feature, cut, best = np.full(len(heap), -1), np.zeros(len(heap), np.int64), 1e-12 * all_w
        able = (all_p > 0) & (all_p < all_w) & (level < depth)
        draw = np.where((low < high) & able[:, None], rng.random(low.shape), np.inf)
        choice = np.argsort(draw, 1)[:, :tried]
        parent = (all_p**2 + (all_w - all_p) ** 2) / all_w
        for k in range(choice.shape[1]):
            f = choice[:, k]
            own = np.flatnonzero(np.isfinite(draw[every, f])[at])
            cell = at[own] * width + bins[own, f[at[own]]]
            ln, lp, lw = (np.bincount(cell, v[own], len(heap) * width).reshape(-1, width).cumsum(1) for v in (drawn, p_, w))
            rp, rw = all_p[:, None] - lp, all_w[:, None] - lw
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (lp**2 + (lw - lp) ** 2) / lw + (rp**2 + (rw - rp) ** 2) / rw - parent[:, None]
            gain = np.where((ln > 0) & (ln < all_n[:, None]) & (lw > 0) & (rw > 0), gain, -np.inf)
            b = gain.argmax(1)
            ok = gain[every, b] > best
            feature[ok], cut[ok], best[ok] = f[ok], b[ok], gain[every, b][ok]
        split = feature >= 0
        share = np.divide(all_p, all_w, out=np.zeros(len(heap)), where=all_w > 0)
        for column, v in zip(out, (heap, feature, cut, np.where(split, 0.0, share), np.where(split, best, 0.0)), strict=True):
            column.append(v)
        place = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        stays = split[at]
        bins, w, p_, drawn, at = bins[stays], w[stays], p_[stays], drawn[stays], at[stays]
        at = place[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
        heap = np.column_stack([2 * heap[split], 2 * heap[split] + 1]).ravel()
        level += 1
    return tuple(np.concatenate(c) for c in out)
