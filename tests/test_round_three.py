"""Findings of the third round."""

import numpy as np
import pandas as pd
from flowlab.operators import enrich, evaluate, experiments, label, trees
from flowlab.plans import catalogue, intake, protocols, streams
from flowlab.streaming import CACHED, flow_state, matching
from pyspark.sql import functions as F


def test_newest_flows_keeps_the_whole_bound():
    assert protocols.NEWEST == 50_000 == enrich.newest_keys.__defaults__[0]
    assert "limit 50000" in catalogue.ORACLES["newest_flows"]


def test_boosting_counts_like_rows_once(spark):
    rows = spark.range(6000).selectExpr("cast(id % 10 as double) as __x0", "cast(id % 2 as double) as y", "1.0D as w", "id % 3 = 0 as held")
    got = trees.units(rows, ["__x0"], [np.arange(9.0)], ["y", "w", "held"])
    assert got.count() == 20 and got.agg(F.sum("n")).first()[0] == 6000


def test_forest_counts_like_rows_once(spark, tmp_path):
    """Rows of which many are alike: the fit takes them by their counts, finds the rule, gives importances, and is the same when saved and read."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(20)) / 20.0
    rows = spark.range(4000).withColumns({"a": h(1), "b": h(2), "c": h(3)}).withColumn("y", ((F.col("a") > 0.5) != (F.col("b") > 0.3)).cast("int"))
    rows = rows.withColumn("role", F.element_at(F.array(F.lit("train"), F.lit("val")), (F.col("id") % 2 + 1).cast("int")))
    pack = experiments.fit(rows, "rf", ["a", "b", "c"], "y", size=10)
    assert isinstance(pack.model, trees.Forest) and pack.model.nodes.select("tree").distinct().count() == 10
    assert evaluate.roc_auc(experiments.score(pack, rows.where("role = 'val'")), "y", "score").first()["roc_auc"] > 0.95
    got = {r["feature"]: r["importance"] for r in experiments.impurity_importance(spark, pack).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["c"] < min(got["a"], got["b"])
    experiments.save_pack(spark, pack, str(tmp_path / "rf"))
    again = experiments.load_pack(spark, [str(tmp_path / "rf")])
    total = lambda p: experiments.score(p, rows).agg(F.round(F.sum("score"), 6)).first()[0]
    assert isinstance(again.model, trees.Forest) and total(again) == total(pack)


def test_files_do_not_gather_rows(spark, sf_dir):
    """Raw labels: a file's rows never meet in one task."""
    plan = intake.raw_labels(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sorting_tasks_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(label, "SORTED", 10)
    rows = spark.range(1000)
    assert label.spread(rows, 1000, "id").rdd.getNumPartitions() == 100 and label.spread(rows, 20, "id") is rows


def test_log_files_grow_in_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    logs = next(streams.grown_logs(spark, sf_dir))
    assert spark.read.text(logs).select(F.input_file_name()).distinct().count() == -(-catalogue.views.events(spark, sf_dir).count() // 100)


def test_streams_call_python_by_buckets(spark, sf_dir):
    """Keys of the cache and of the matcher are served many at a time."""
    for out in (flow_state(catalogue.views.kernel(spark, sf_dir, catalogue.stream_source(spark, sf_dir)).select(*protocols.TUPLE.split(", "), *CACHED)), matching.stream_match(*catalogue.both_sides(catalogue.stream_source(spark, sf_dir)))):
        assert "bucket" in out._jdf.queryExecution().analyzed().toString()


def test_meeting_in_a_hot_key(monkeypatch):
    """Ranges of candidates with one long flow among short ones, in small steps, against all pairs."""
    monkeypatch.setattr(matching, "PAIRS", 7)
    rng = np.random.default_rng(5)
    side = lambda n: pd.DataFrame({"key": rng.choice(["a", "b", "c"], n), "way": rng.random(n) < 0.5, "start_us": rng.integers(0, 1000, n), "span": rng.choice([3, 30, 600], n)})
    conns, flows = (d.assign(end_us=d["start_us"] + d["span"]) for d in (side(60), side(80)))
    flows = flows.assign(samples=rng.integers(1, 5, 80), bytes_sent=rng.integers(1, 9, 80), bytes_recv=rng.integers(1, 9, 80))
    got = matching._meet(conns.assign(conn_id=range(60), matched=0, same=0, samples=0, bytes_sent=0, bytes_recv=0)[matching.CONNS], flows[matching.FLOWS], 10)
    for c, g in zip(conns.itertuples(), got.itertuples(), strict=True):
        met = [(1, int(f.way == c.way), f.samples, f.bytes_sent, f.bytes_recv) for f in flows.itertuples() if f.key == c.key and f.start_us <= c.end_us + 10 and f.end_us >= c.start_us - 10]
        assert (g.matched, g.same, g.samples, g.bytes_sent, g.bytes_recv) == max(met, default=(0,) * 5)
