"""Models compared at one recall: only the thresholds need a ranking, and picking a key's flow is part of matching."""

import pytest
from flowlab.operators import enrich, evaluate, experiments, models
from flowlab.plans import catalogue, views
from pyspark.sql import functions as F


def test_only_thresholds_rank(spark, monkeypatch):
    rows = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 7 % 101).alias("a"), F.when(F.col("id") % 2 == 0, "val").otherwise("test").alias("role"))
    packs = {n: experiments.Pack(models.Linear({"a": w}, {"a": 0.0}), ["a"], t, "given") for n, w, t in (("x", 1.0, 40.0), ("y", -1.0, -70.0))}
    want = {n: experiments.summary(experiments.score(p, rows), "y", p.threshold).first() for n, p in packs.items()}
    for n, p in packs.items():
        got = experiments.rates(experiments.score(p, rows), "y", p.threshold).first()
        assert got.asDict() == pytest.approx({m: want[n][m] for m in ("f1", "recall", "precision", "fpr")})
    calls, ranked = [], evaluate.prefix_sums
    monkeypatch.setattr(evaluate, "prefix_sums", lambda *a, **k: calls.append(1) or ranked(*a, **k))
    assert experiments.matched_recall(packs, rows, "y").count() == 2 and len(calls) == 2


def test_best_flow_is_picked_while_matching(spark, sf_dir):
    conn, flows, order = views.flows(spark, sf_dir), views.kernel(spark, sf_dir), F.struct(*catalogue.BEST)
    assert flows.count() > flows.select(*enrich.TUPLE).distinct().count()
    got, want = enrich.match(conn, flows, best=order), enrich.match(conn, enrich.dedup_max(flows, order))
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
