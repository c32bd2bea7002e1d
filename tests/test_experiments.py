"""Experiment protocols on rows whose answers are known, and the flow cache."""

import pytest
from flowlab.operators import enrich, evaluate, experiments
from flowlab.plans import protocols
from flowlab.streaming import CACHED
from pyspark.sql import functions as F

FEATURES = ["a", "b", "ebpf_samples"]


@pytest.fixture(scope="module")
def rows(spark):
    """Feature a decides the class, b is noise, and ebpf_samples says half of it."""
    y = (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)) == 0).cast("int")
    df = spark.range(600).withColumn("y", y).withColumn("role", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")))
    noise = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(100))
    return df.withColumns({"a": F.col("y") * 50 + noise * 0.6, "b": F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(10)), "ebpf_samples": F.col("y") * 5 + F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(20))}).cache()


@pytest.fixture(scope="module")
def pack(rows):
    return experiments.fit(rows, "logreg", FEATURES, "y")


def test_summary_agrees_with_the_single_metrics(rows, pack):
    scored = experiments.score(pack, rows)
    got = {r["role"]: r for r in experiments.summary(scored, "y", pack.threshold, ("role",)).collect()}
    for role in ("train", "val", "test"):
        part = scored.where(F.col("role") == role)
        assert got[role]["roc_auc"] == pytest.approx(evaluate.roc_auc(part, "y", "score").first()[0])
        assert got[role]["pr_auc"] == pytest.approx(evaluate.average_precision(part, "y", "score").first()[0])
        one = evaluate.binary_metrics(part, "y", "pred").first()
        assert [got[role][m] for m in ("f1", "recall", "precision", "fpr")] == pytest.approx([one[m] for m in ("f1", "recall", "precision", "fpr")])


def test_importances_and_ablations(rows, pack):
    test = rows.where("role = 'test'")
    base = experiments.summary(experiments.score(pack, test), "y", pack.threshold).first()["roc_auc"]
    falls = {r["feature"]: r for r in experiments.permutation_importance(pack, test, "y", "id", repeats=3, block=70).collect()}
    assert falls["a"]["importance_mean"] > 0.2 > abs(falls["b"]["importance_mean"]) + 0.1 and falls["ebpf_samples"]["origin"] == "kernel"
    masked = {r["variant"]: r for r in experiments.mask_ablation(pack, test, "y", {"core": ["a", "b"], "kernel": ["ebpf_samples"], "nothing": []}).collect()}
    assert set(masked) == {"all_features", "core", "kernel"} and masked["all_features"]["roc_auc"] == pytest.approx(base) and masked["all_features"]["delta_f1"] == 0
    assert masked["kernel"]["delta_roc_auc"] < -0.1 and masked["kernel"]["n_features"] == 1
    steps = {r["step"]: r for r in experiments.progressive_ablation(pack, test, "y", ["b", "a"]).collect()}
    assert steps[2]["test_auc"] == pytest.approx(base) and steps[2]["feature_added"] == "a" and steps[0]["test_auc"] < base


def test_matched_recall_and_tables(rows, pack):
    weak = experiments.fit(rows, "logreg", ["b", "ebpf_samples"], "y")
    got = {r["model"]: r for r in experiments.matched_recall({"weak": weak, "all": pack}, rows, "y").collect()}
    assert got["all"]["target_recall"] == got["weak"]["target_recall"] and got["all"]["fpr"] < got["weak"]["fpr"]
    table = experiments.refit_table({"s": rows}, {"weak": ["b"], "all": FEATURES}, "logreg", "y", size=5)
    best = {r["feature_set"]: r["wins"] for r in experiments.seed_summary(table).collect()}
    assert best == {"weak": 0, "all": 1} and {r["n_features"] for r in table.collect()} == {1, 3}


def test_packs_outlive_the_session(spark, rows, pack, tmp_path):
    experiments.save_pack(spark, pack, str(tmp_path / "p"))
    again = experiments.load_pack(spark, [str(tmp_path / "none"), str(tmp_path / "p")])
    assert (again.features, again.threshold, again.kind) == (pack.features, pack.threshold, "logreg")
    total = lambda p: experiments.score(p, rows).agg(F.sum("score")).first()[0]
    assert total(again) == pytest.approx(total(pack))
    assert experiments.score(pack, rows.drop("b")).count() == 600  # a missing feature is 0
    with pytest.raises(FileNotFoundError):
        experiments.load_pack(spark, [str(tmp_path / "none")])


def test_contamination_grid(spark):
    benign = spark.range(100).select(F.col("id").cast("int").alias("s"))
    val = spark.createDataFrame([(1, 99)] * 12 + [(0, 50)] * 20, "y int, s int")
    got = {r["contamination"]: r for r in experiments.contamination_grid(benign, val, "y", "s").collect()}
    assert got[0.01]["threshold"] == 99 and got[0.1]["threshold"] == 90 and got[0.001]["threshold"] == float("inf")
    assert [c for c, r in got.items() if r["chosen"]] == [0.01]
    few = experiments.contamination_grid(benign, val.where("y = 0"), "y", "s").where("chosen").collect()
    assert [r["contamination"] for r in few] == [0.1]


def test_flow_cache_holds_the_best_and_forgets(spark, sf_dir):
    got = protocols.stream_flow_state(spark, sf_dir).collect()
    best = enrich.dedup_max(protocols.views.kernel(spark, sf_dir), F.struct("samples", "last_us", "part_id")).select(*CACHED).collect()
    assert sorted(tuple(r[c] for c in CACHED) for r in got if not r["expired"]) == sorted(tuple(r) for r in best)
    end = max(r["last_us"] for r in got)
    assert all(r["last_us"] < end - 3_600_000_000 for r in got if r["expired"]) and any(r["expired"] for r in got)
