"""Registered model queries ask for the reference's sizes."""

import pytest
from flowlab.operators import evaluate, experiments, models, trees
from flowlab.plans import catalogue, protocols

FULL = {"rf": ("numTrees", 200, 20), "logreg": ("maxIter", 100, None)}


class Asked(Exception):
    pass


def fits(rows, kind):
    return (lambda: models.fit_and_score(rows, kind), lambda: experiments.fit(rows, kind, models.FEATURES, "is_attack"), lambda: experiments.rank_candidates(rows, [kind], models.FEATURES, "is_attack"))


def test_fits_have_the_full_size(spark, sf_dir, monkeypatch):
    """What is about to be fitted, without fitting it."""
    seen = []

    def stop(self, rows, params=None):
        seen.append(self.getStages()[-1])
        raise Asked

    monkeypatch.setattr("pyspark.ml.Pipeline.fit", stop)
    rows = catalogue.by_day(spark, sf_dir)
    for kind, (name, size, depth) in FULL.items():
        for run in fits(rows, kind):
            with pytest.raises(Asked):
                run()
            last = seen[-1]
            assert last.getOrDefault(name) == size and (depth is None or last.getOrDefault("maxDepth") == depth)
    for query in (protocols.model_leaderboard, protocols.refit_table, protocols.multi_seed):
        with pytest.raises(Asked):
            query(spark, sf_dir)
        assert seen[-1].getOrDefault("maxIter") == 100


def test_tree_ensembles_have_the_full_size(spark, sf_dir, monkeypatch):
    asked = []

    def stop(rows, features, y, **sizes):
        asked.append((sizes.get("rounds") or sizes["trees"], sizes["depth"]))
        raise Asked

    monkeypatch.setattr(trees, "boost", stop)
    monkeypatch.setattr(trees, "extra_trees", stop)
    for kind, want in (("gbt", (300, 8)), ("extra", (500, 24))):
        for run in fits(catalogue.by_day(spark, sf_dir), kind):
            with pytest.raises(Asked):
                run()
            assert asked[-1] == want


def test_forest_and_replicates_in_full(spark, sf_dir, monkeypatch):
    asked = []
    grow, draw = models.isolation_forest, evaluate.bootstrap_ci

    def forest(rows, features, row_id, trees=100, **more):
        asked.append(trees)
        raise Asked

    def interval(*args, n=300, **more):
        asked.append(n)
        return draw(*args, n=2, **more)

    monkeypatch.setattr(models, "isolation_forest", forest)
    monkeypatch.setattr(evaluate, "bootstrap_ci", interval)
    with pytest.raises(Asked):
        protocols.iforest_contamination(spark, sf_dir)
    catalogue.bootstrap_ci(spark, sf_dir)
    assert asked == [100, 300, 300] and grow.__defaults__[0] == 100 and draw.__defaults__[2] == 300
