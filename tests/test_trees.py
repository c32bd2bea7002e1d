"""Tree ensembles on planted rows: areas near the best that the noise allows, early ends, and the same trees whichever way they are grown."""

import numpy as np
import pytest
from flowlab.operators import evaluate, experiments, models, trees
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two features decide the class together, one in ten labels is wrong: no model has an area above 0.9 or so."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0
    clean = ((F.col("a") > 0.5) != (F.col("b") > 0.3)).cast("int")
    df = spark.range(3000).withColumns({"a": h(1), "b": h(2), "c": h(3)}).withColumn("y", F.when(h(4) < 0.1, 1 - clean).otherwise(clean))
    df = df.withColumns({"c": F.when(F.col("id") % 7 != 0, F.col("c")), "role": F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int"))})
    return df.repartition(3).cache()


def area(model, rows):
    return evaluate.roc_auc(models.score_rows(model, rows), "y", "score").first()["roc_auc"]


def test_boosting_stops_early_and_finds_the_rule(rows):
    train, test = models.balanced_weights(rows.where("role <> 'test'"), "y"), rows.where("role = 'test'")
    model = trees.boost(train, FEATURES, "y")
    assert 20 < len(model.trees) < 250 and len(model.losses) == len(model.trees) + 1
    assert min(model.losses[:-20]) - 1e-7 <= min(model.losses[-20:]) and model.losses[0] == pytest.approx(np.log(2), abs=0.01)
    assert 0.87 < area(model, test) < 0.93
    assert all((f >= 0).sum() <= 30 for f, _, _ in model.trees)
    plain = trees.boost(train, FEATURES, "y", rounds=25, held_out=0.0)
    assert len(plain.trees) == 25 and plain.losses == []


def test_boosting_by_passes_is_the_same(rows):
    train = models.balanced_weights(rows.where("role = 'train'"), "y")
    one, many = (trees.boost(train, FEATURES, "y", rounds=12, local=n) for n in (200_000, 0))
    assert np.allclose(one.losses, many.losses) and len(one.trees) == len(many.trees) == 12
    both = one.transform(rows.select("id", *FEATURES)).join(many.transform(rows.select("id", *FEATURES)).select("id", F.col("score").alias("s")), "id")
    assert both.where(F.abs(F.col("score") - F.col("s")) > 1e-9).count() == 0 and both.count() == 3000


@pytest.mark.parametrize("local", [100, 20_000])
def test_extra_trees(rows, local):
    train, test = models.balanced_weights(rows.where("role <> 'test'"), "y"), rows.where("role = 'test'")
    model = trees.extra_trees(train, FEATURES, "y", trees=25, local=local)
    nodes = model.nodes
    assert 0.86 < area(model, test) < 0.93
    assert nodes.select("tree").distinct().count() == 25 and nodes.count() == nodes.select("tree", "node").distinct().count()
    inner = nodes.where("feature >= 0").select("tree", F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
    root = nodes.select("tree").distinct().withColumn("node", F.lit(1).cast("long"))
    assert inner.union(root).exceptAll(nodes.select("tree", "node")).count() == nodes.select("tree", "node").exceptAll(inner.union(root)).count() == 0  # whole binary trees
    cuts = nodes.where("node = 1").agg(F.count_distinct("cut")).first()[0]
    assert cuts == 25  # random ones
    few = trees.ExtraTrees(model.features, model.fill, nodes, 25, per_pass=3000)
    assert area(few, test) == pytest.approx(area(model, test))


def test_trees_of_odd_tables(spark, rows):
    typed = rows.select("id", *FEATURES, "y").withColumn("weight", F.lit(1.0))
    for make in (trees.boost, trees.extra_trees):
        empty = make(typed.limit(0), FEATURES, "y")
        assert empty.transform(typed.limit(3)).where("score between 0 and 1").count() == 3
        one_class = make(typed.where("y = 1"), FEATURES, "y", **({"trees": 3} if make is trees.extra_trees else {}))
        assert one_class.transform(typed).where("score > 0.999").count() == 3000
        constant = make(typed.withColumns({f: F.lit(None).cast("double") for f in FEATURES}), FEATURES, "y", **({"trees": 3} if make is trees.extra_trees else {}))
        assert constant.transform(typed).select("score").distinct().count() == 1


@pytest.mark.parametrize("kind", ["gbt", "extra"])
def test_packs_of_trees(spark, rows, tmp_path, kind):
    pack = experiments.fit(rows, kind, FEATURES, "y", size=15)
    experiments.save_pack(spark, pack, str(tmp_path / kind))
    again = experiments.load_pack(spark, [str(tmp_path / kind)])
    total = lambda p: experiments.score(p, rows).agg(F.sum("score"), F.sum("pred")).first()
    assert tuple(total(again)) == pytest.approx(tuple(total(pack))) and again.kind == kind
    assert {r["variant"] for r in experiments.mask_ablation(pack, rows, "y", {"ab": ["a", "b"]}).collect()} == {"all_features", "ab"}


def test_leaderboard_in_full(rows):
    """All four candidates at their full sizes."""
    board, packs = experiments.rank_candidates(rows, ["logreg", "rf", "extra", "gbt"], FEATURES, "y")
    got = {r["model"]: r for r in board.collect()}
    assert set(got) == {"logreg", "rf", "extra", "gbt"} and sorted(r["place"] for r in got.values()) == [1, 2, 3, 4]
    assert got["logreg"]["place"] == 4 and min(got[k]["val_roc_auc"] for k in ("rf", "extra", "gbt")) > 0.83 > got["logreg"]["val_roc_auc"]
    assert packs["extra"].model.nodes.agg(F.count_distinct("tree")).first()[0] == 500
