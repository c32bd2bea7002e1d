"""The leaderboard's candidates on tables of one file: rows dealt over tasks, extra trees grown from counted points, forests that meet the rows in tasks."""

import numpy as np
import pytest
from flowlab.operators import evaluate, experiments, models, trees
from flowlab.plans import protocols
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(200)) / 200.0
    df = spark.range(4000).withColumns({"a": h(1), "b": h(2), "c": F.when(F.col("id") % 7 != 0, h(3))})
    return models.balanced_weights(df.withColumn("y", ((F.col("a") > 0.5) != (F.col("b") > 0.3)).cast("int")), "y").cache()


def test_days_are_dealt_over_tasks(spark, sf_dir):
    got = protocols.days(spark, sf_dir)
    assert len(got.inputFiles()) > 1
    assert got.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_points_are_counted_rows():
    """Rows that are there three times give the tree of one with their count, and every leaf holds what came to it."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, (500, 3)).astype(float), rng.integers(0, 2, 500)
    counts = np.where(y == 1, np.int64(1) << 32, np.int64(1))
    grow = lambda x, counts, block=1 << 16: trees.grow_points(x, counts, [0.7, 1.5], 24, 2, 1, np.random.default_rng(5), block)
    once, thrice = grow(x, 3 * counts), grow(np.repeat(x, 3, 0), np.repeat(counts, 3))
    assert all(np.array_equal(a, b) for a, b in zip(once, thrice, strict=True))
    for feature, value, low in (grow(x, counts), grow(x, counts, 40)):
        inner = feature >= 0
        assert sorted([0, *low[inner], *(low[inner] + 1)]) == list(range(len(feature)))
        at = np.zeros(len(x), int)
        while (going := np.flatnonzero(feature[at] >= 0)).size:
            k = at[going]
            at[going] = low[k] + (x[going, feature[k]] > value[k])
        weight = np.where(y == 1, 1.5, 0.7)
        n, p, w = (np.bincount(at, v, len(feature)) for v in (np.ones(500), weight * y, weight))
        assert (n[~inner] >= 2).all() and np.allclose(value[~inner], p[~inner] / w[~inner])


def test_extra_trees_by_points_and_by_levels(rows):
    """No task has a tree's rows shuffled to it; the nodes of both ways are whole trees of like quality, and the same at each run."""
    made = [trees.extra_trees(rows, FEATURES, "y", trees=12, **more) for more in ({}, {}, {"local": 100})]
    assert made[0].packed is not None and made[2].packed is None
    assert made[0].nodes.exceptAll(made[1].nodes).count() == 0 == made[1].nodes.exceptAll(made[0].nodes).count()
    for m in made:
        assert m.nodes.select("tree").distinct().count() == 12 and m.nodes.count() == m.nodes.select("tree", "node").distinct().count()
        assert evaluate.roc_auc(models.score_rows(m, rows), "y", "score").first()["roc_auc"] > 0.97
    heavy = trees.extra_trees(rows.withColumn("weight", F.col("id") % 3 + 1.0), FEATURES, "y", trees=3)
    assert heavy.packed is None and heavy.nodes.select("tree").distinct().count() == 3


def test_large_forests_score_without_the_driver(spark, rows, monkeypatch):
    """Trees and rows in several groups give the scores that a forest sent to the rows gives, to null features too."""
    monkeypatch.setattr(trees, "TASK_POINTS", 900)
    monkeypatch.setattr(trees, "TASK_NODES", 2000)
    monkeypatch.setattr(trees, "BLOCK", 256)
    whole = trees.extra_trees(rows, FEATURES, "y", trees=12)
    few = trees.ExtraTrees(whole.features, whole.fill, whole.nodes, 12, per_pass=1000)
    sent = whole.transform(rows).select("id", F.col("score").alias("s"))

    def stop(*args):
        raise AssertionError("nodes on the driver")

    monkeypatch.setattr(spark.sparkContext, "broadcast", stop)
    got = few.transform(rows)
    assert got.columns == [*rows.columns, "score"]
    both = got.join(sent, "id")
    assert both.count() == 4000 and both.where(F.abs(F.col("score") - F.col("s")) > 1e-9).count() == 0


def test_boosting_in_one_task_up_to_a_million_units():
    assert trees.boost.__defaults__[-1] == 1_000_000


def test_candidates_are_scored_once(rows, monkeypatch):
    """Train and val of a candidate go through its model in one pass, whose scores give the threshold and the metrics that a pack gives."""
    calls, score = [], models.score_rows
    monkeypatch.setattr(models, "score_rows", lambda model, df: calls.append(model) or score(model, df))
    dealt = rows.drop("weight").withColumn("role", F.element_at(F.array(F.lit("train"), F.lit("val")), (F.col("id") % 2 + 1).cast("int")))
    board, packs = experiments.rank_candidates(dealt, ["logreg", "extra"], FEATURES, "y", size=5)
    got = {r["model"]: r for r in board.collect()}
    assert len(calls) == 2 and list(packs) == ["logreg", "extra"]
    for kind, pack in packs.items():
        want = experiments.evaluate_pack(pack, dealt, "y").first().asDict()
        assert {k: pytest.approx(got[kind][k]) for k in want} == want
