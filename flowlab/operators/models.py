"""Detectors: pyspark.ml pipelines, the tree ensembles of ``trees``, and an isolation forest that grows its trees in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators import trees
from flowlab.operators.evaluate import select_threshold

FEATURES = ["orig_bytes", "resp_bytes", "orig_p", "resp_p", "proto_num"]


def balanced_weights(df: DataFrame, y: str) -> DataFrame:
    """Adds weight = n / (2 n_class)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"))
    return df.join(F.broadcast(counts.crossJoin(total)), y).withColumn("weight", F.col("__n") / (2.0 * F.col("__c"))).drop("__c", "__n")  # two classes


class CountedForest(RandomForestClassifier):
    """The forest, fitted on distinct binned rows with their counts (``trees.random_forest``) where these are few enough for a task, else by its own rounds over all rows."""

    features: list[str] = []

    def _fit(self, dataset: DataFrame):
        own = lambda name: self.getOrDefault(name)
        made = trees.random_forest(dataset, self.features, own("labelCol"), own("weightCol"), own("numTrees"), own("maxDepth"), own("maxBins"), own("seed")) if self.features else None
        return super()._fit(dataset) if made is None else made


def candidate(kind: str, features: list[str], y: str, seed: int, size: int | None = None, centre: bool = False) -> Pipeline:
    """A pipeline for the forest or the linear model: imputation by the median, assembly, scaling for the linear model (with ``centre`` about the mean), and the
    classifier. ``size``: trees or iterations. The forest keeps each row's node between levels, so no task carries the forest."""
    filled = [f"{f}__f" for f in features]
    steps = [Imputer(inputCols=features, outputCols=filled, strategy="median", relativeError=1e-4), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep")]
    common = {"labelCol": y, "weightCol": "weight", "featuresCol": "raw"}
    if kind == "rf":
        forest = CountedForest(numTrees=size or 200, maxDepth=20, seed=seed, cacheNodeIds=True, maxMemoryInMB=1024, **common)
        forest.features = list(features)
        steps.append(forest)
    else:
        steps += [StandardScaler(inputCol="raw", outputCol="scaled", withMean=centre), LogisticRegression(maxIter=size or 100, **(common | {"featuresCol": "scaled"}))]
    return Pipeline(stages=steps)


def fit_model(train: DataFrame, kind: str, features: list[str], y: str, seed: int, size: int | None = None, depth: int | None = None):
    """The fitted detector of a kind on rows with balanced weights: gbt, extra (``trees``), rf, logreg (``candidate``). ``size``: rounds, trees or
    iterations, ``depth`` of the trees; by default the reference's 300 rounds of depth 8 with early stopping, 500 trees of 24, 200 of 20, 100 iterations."""
    rows = balanced_weights(train, y)
    if kind == "gbt":
        return trees.boost(rows, features, y, rounds=size or 300, depth=depth or 8, seed=seed)
    if kind == "extra":
        return trees.extra_trees(rows, features, y, trees=size or 500, depth=depth or 24, seed=seed)
    steps = candidate(kind, features, y, seed, size)
    if kind == "rf" and depth:
        steps.getStages()[-1].setMaxDepth(depth)
    made = steps.fit(rows)
    return made.stages[-1] if isinstance(made.stages[-1], trees.Forest) else made


@dataclass(frozen=True)
class Linear:
    """A given linear score: the sum of weights times features, missing ones as ``fill`` has them."""

    weights: dict[str, float]
    fill: dict[str, float]

    def transform(self, rows: DataFrame) -> DataFrame:
        terms = [F.coalesce(F.col(f).cast("double"), F.lit(self.fill[f])) * F.lit(w) for f, w in self.weights.items()]
        return rows.withColumn("score", sum(terms[1:], terms[0]))


def score_rows(model, rows: DataFrame) -> DataFrame:
    """The rows with score: the probability of the second class, or what a given model says."""
    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]) if "probability" in out.columns else out


def margin_scores(scored: DataFrame, margin: str = "margin") -> DataFrame:
    """Scores of a model that gives margins but no probabilities: the margin between its least (0) and greatest (1) value; 0 where all are alike."""
    ends = scored.agg(F.min(margin).alias("__lo"), F.max(margin).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    return scored.crossJoin(F.broadcast(ends)).withColumn("score", F.when(width > 0, (F.col(margin) - F.col("__lo")) / width).otherwise(0.0)).drop("__lo", "__hi")  # one row


def fit_and_score(rows: DataFrame, kind: str, y: str = "is_attack", row_id: str = "flow_id", seed: int = 104, size: int | None = None) -> DataFrame:
    """Fits on role train, takes the threshold of the best F1 on val, and returns (row id, y, score, pred) of test. ``size``: as in ``candidate``, by default in full."""
    typed = rows.withColumns({f: F.col(f).cast("double") for f in FEATURES})
    model = fit_model(typed.where("role = 'train'"), kind, FEATURES, y, seed, size)
    threshold = select_threshold(score_rows(model, typed.where("role = 'val'")), y, "score", "f1").select("threshold")
    scored = score_rows(model, typed.where("role = 'test'"))
    return scored.crossJoin(F.broadcast(threshold)).select(row_id, y, "score", (F.col("score") >= F.col("threshold")).cast("int").alias("pred"))  # one row


def isolation_forest(rows: DataFrame, features: list[str], row_id: str, trees: int = 100, sample: int = 512, seed: int = 1337) -> DataFrame:
    """(tree, node, feature, cut, depth, size): each tree grown in a task of its own on a sample of ``sample`` rows in hashed order.

    A row enters a tree's candidates by a hash cut-off that keeps a few times the sample, so no tree sees the table."""
    total = max(1, rows.count())
    share = min(1.0, 4.0 * sample / total)
    gate = min(1.0, trees * share)  # of large tables most rows are in no tree and go by one hash
    some = rows.select(row_id, *[F.col(f).cast("double").alias(f) for f in features]).where(F.pmod(F.xxhash64(F.lit(seed + 1), row_id), F.lit(1 << 40)) < int(gate * (1 << 40)))
    h = lambda tree: F.pmod(F.xxhash64(F.lit(seed), tree, row_id), F.lit(1 << 40))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: h(t) < int(share / gate * (1 << 40)))
    near = some.withColumn("tree", F.explode(chosen)).withColumn("__h", h(F.col("tree")))
    picked = near.withColumn("__r", F.row_number().over(Window.partitionBy("tree").orderBy("__h", row_id))).where(F.col("__r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng, x = np.random.default_rng(seed + tree), np.nan_to_num(pdf.sort_values("__r")[features].to_numpy(float))
        deepest, out, todo = int(np.ceil(np.log2(max(2, len(x))))), [], [(1, np.arange(len(x)), 0)]
        while todo:
            node, rows_, depth = todo.pop()
            part = x[rows_]
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else np.array([], int)
            if depth >= deepest or not len(spread):
                out.append((tree, node, -1, 0.0, depth, len(rows_)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] < cut
            out.append((tree, node, f, cut, depth, len(rows_)))
            todo += [(2 * node, rows_[low], depth + 1), (2 * node + 1, rows_[~low], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "depth", "size"])

    return picked.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, cut double, depth int, size long")


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = n.astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(rows: DataFrame, forest: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(row id, score), score from 0 to 1, higher the odder. The forest is bounded by trees and sample size and goes to every task."""
    nodes = forest.orderBy("tree", "node").toPandas()
    trees = [{int(r.node): (int(r.feature), r.cut, r.depth, r.size) for r in g.itertuples()} for _, g in nodes.groupby("tree")]
    scale = float(_mean_path(np.array([max(t[1][3] for t in trees) if trees else 2]))[0]) or 1.0

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, total = np.nan_to_num(f[features].to_numpy(float)), np.zeros(len(f))
            for tree in trees:
                todo = [(1, np.arange(len(x)))]
                while todo:
                    node, at = todo.pop()
                    feature, cut, depth, size = tree[node]
                    if feature < 0:
                        total[at] += depth + float(_mean_path(np.array([size]))[0])
                        continue
                    low = x[at, feature] < cut
                    todo += [(n, a) for n, a in ((2 * node, at[low]), (2 * node + 1, at[~low])) if len(a)]
            yield pd.DataFrame({row_id: f[row_id], "score": 2.0 ** (-total / max(1, len(trees)) / scale)})

    typed = rows.select(row_id, *[F.col(f).cast("double").alias(f) for f in features])
    return typed.mapInPandas(score, f"{row_id} long, score double")
