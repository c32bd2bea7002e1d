"""Operators that once did less than their whole job."""

import random

import pytest
from flowlab.operators import evaluate, prepare
from flowlab.streaming import stream_enrich


def metrics(rows, pred, score):
    """Brute force over (y, weight-free rows)."""
    pos, neg = [r for r in rows if r["y"]], [r for r in rows if not r["y"]]
    tp, fp = sum(r[pred] for r in pos), sum(r[pred] for r in neg)
    roc = sum((p[score] > q[score]) + (p[score] == q[score]) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    at = lambda s: sum(p[score] >= s for p in pos) / sum(r[score] >= s for r in rows)
    return {"roc_auc": roc, "pr_auc": sum(at(p[score]) for p in pos) / len(pos), "f1": 2 * tp / (tp + fp + len(pos)), "precision": tp / (tp + fp), "recall": tp / len(pos), "fpr": fp / len(neg)}


def test_paired_cluster_bootstrap_has_six_metrics(spark):
    rnd = random.Random(4)
    rows = [{"c": f"h{k % 12}", "y": int(rnd.random() < 0.4), "sa": rnd.randint(0, 30)} for k in range(240)]
    for r in rows:
        r["sb"] = r["sa"] + 6 * r["y"]
        r["a"], r["b"] = int(r["sa"] > 14), int(r["sb"] > 14)
    df = spark.createDataFrame(rows)
    got = {r["metric"]: r for r in evaluate.paired_cluster_bootstrap(df, "y", "a", "b", "sa", "sb", "c", n=60).collect()}
    want_a, want_b = metrics(rows, "a", "sa"), metrics(rows, "b", "sb")
    assert set(got) == set(want_a)
    for m, r in got.items():
        assert r["delta"] == pytest.approx(want_b[m] - want_a[m]) and (r["replicates"], r["clusters"]) == (60, 12)
        assert r["low"] <= r["mean"] <= r["high"] and r["low"] - 1e-9 <= r["delta"] <= r["high"] + 1e-9
    same = evaluate.paired_cluster_bootstrap(df, "y", "a", "a", "sa", "sa", "c", n=5).collect()
    assert len(same) == 6 and all(r["low"] == r["high"] == r["delta"] == 0 for r in same)


def test_group_split_gives_rare_families_every_role(spark):
    rows = [(f"{fam}-{k}", fam, 100) for fam, n in (("five", 5), ("eight", 8), ("twelve", 12), ("many", 400)) for k in range(n)] + [("odd", None, 100)]
    groups = spark.createDataFrame(rows, "g string, fam string, n int")
    for seed in range(3):
        split = prepare.group_split(groups, "fam", "n", ("g",), seed).groupBy("fam").pivot("role", ["train", "val", "test"]).count().fillna(0, ["train", "val", "test"])
        got = {r["fam"]: (r["train"], r["val"], r["test"]) for r in split.collect()}
        assert all(min(got[f]) >= 1 for f in ("five", "eight", "twelve", "many")) and sum(got[None]) == 1
        assert got["many"] == (280, 60, 60)
    dealt = prepare.group_split(groups, "fam", "n", ("g",), 1, per_task=50)
    assert dealt.count() == len(rows) and set(dealt.columns) == {"g", "fam", "n", "role"}


def test_long_connections_match_on_tables(spark):
    at = "timestamp'2024-01-01 00:00:00' + interval {} seconds"
    key = "'10.0.0.1' as {}, '10.0.1.1' as {}, 1024 as {}, 443 as {}, 6 as {}"
    conn = spark.sql(f"select 1 as conn_id, {at.format(0)} as start, {at.format(300)} as end, {key.format('orig_h', 'resp_h', 'orig_p', 'resp_p', 'proto_num')}")
    flows = spark.sql(f"select {key.format('saddr', 'daddr', 'sport', 'dport', 'proto')}, {at.format(5)} as first, {at.format(290)} as last, 7 as samples, 1 as bytes_sent, 2 as bytes_recv")
    assert [(r["match_dir"], r["samples"]) for r in stream_enrich(conn, flows).collect()] == [("fwd", 7)]
