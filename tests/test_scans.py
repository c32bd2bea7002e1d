"""Prefix sums, quantiles, windows and bootstraps whose groups are spread over ranges, against plain Python and exact moments."""

import math
import random

import numpy as np
import pytest
from flowlab import functions as fn
from flowlab.operators import evaluate, monitor, resample, scans
from pyspark.sql import functions as F

RND = random.Random(6)


@pytest.fixture(scope="module")
def scored(spark):
    """One group of continuous scores with nearly all rows, one with many ties, one of a single row, one without a name."""
    rows = [("hot", int(RND.random() < 0.4), RND.random()) for _ in range(900)] + [("ties", int(RND.random() < 0.5), float(RND.randint(0, 5))) for _ in range(80)] + [("one", 1, 0.5), (None, 0, 1.5), (None, 1, 2.5), ("hot", 1, None)]
    return spark.createDataFrame(rows, "g string, y int, s double").repartition(3).cache()


def by_group(df, *cols):
    out = {}
    for r in df.select("g", *cols).collect():
        out.setdefault(r["g"], []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("per_range", [7, 100, 10**6])
def test_prefix_sums_over_ranges(scored, per_range):
    counts = evaluate.score_counts(scored, "y", "s", ("g",))
    sums = by_group(scans.prefix_sums(counts, ("g",), per_range), "s", "p", "n", "tp", "fp", "pos", "neg", "next_p", "next_n")
    for g, found in by_group(counts, "s", "p", "n").items():
        tp = fp = 0
        want = []
        found.sort(reverse=True)
        for k, (s, p, n) in enumerate(found):
            tp, fp = tp + p, fp + n
            after = found[k + 1][1:] if k + 1 < len(found) else (None, None)
            want.append((s, p, n, tp, fp, sum(x[1] for x in found), sum(x[2] for x in found), *after))
        assert sorted(sums[g], reverse=True) == want


@pytest.mark.parametrize("per_range", [7, 10**6])
def test_percentiles(scored, per_range):
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = by_group(scans.percentiles(scored, "s", probs, ("g",), per_range), "n", *[f"q{k}" for k in range(5)])
    want = by_group(scored.groupBy("g").agg(F.count("s").alias("n"), *[F.percentile("s", q).alias(f"q{k}") for k, q in enumerate(probs)]), "n", *[f"q{k}" for k in range(5)])
    assert set(got) == set(want) and all(got[g][0] == pytest.approx(want[g][0]) for g in want)


def test_moving_average_of_a_hot_host(spark, monkeypatch):
    rows = spark.range(700).select(F.when(F.col("id") % 10 == 9, F.col("id") % 7).otherwise(0).alias("h"), F.col("id").alias("k"), (F.col("id") * 37 % 101).alias("v"))
    plain = rows.withColumn("moving_avg", F.expr("avg(v) over (partition by h order by k rows between 4 preceding and current row)"))
    for per_range in (3, 50, 10**6):
        monkeypatch.setattr(scans, "PER_RANGE", per_range)
        monkeypatch.setattr(scans.trailing_rows, "__defaults__", (per_range,))
        got = monitor.moving_avg(rows, "v", ["k"], ["h"])
        assert got.columns == plain.columns and got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
    parts = scans.in_ranges(rows, ("h",), [F.col("k")], 50)
    assert parts.where("h = 0").select("part").distinct().count() > 5


def test_kept_roc_points(spark):
    """By the rule on a list: ends, and where the second difference of either count is not zero."""
    rows = [(float(k), int(k % 9 < 5)) for k in range(60)] + [(5.0, 1), (5.0, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    steps = [(s, sum(y for t, y in rows if t == s), sum(1 - y for t, y in rows if t == s)) for s in sorted({s for s, _ in rows}, reverse=True)]
    want = {s for k, (s, p, n) in enumerate(steps) if k in (0, len(steps) - 1) or (p, n) != steps[k + 1][1:]}
    assert {r["threshold"] for r in evaluate.roc_points(df, "y", "s", True).collect()} == want and len(want) < len(steps)


def test_mcnemar_at_any_count(spark):
    def exact(b, c):
        n, k = b + c, min(b, c)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0

    pairs = [(0, 0), (0, 1), (1, 1), (0, 30), (3, 9), (15, 17), (16, 16), (40, 90), (500, 560), (4900, 5100), (5000, 5000), (10, 3000)]
    big = [(500_000_000, 500_100_000), (30_000_000, 30_000_000), (3_000_000_000, 3_000_200_000)]
    df = spark.createDataFrame(pairs + big, "b long, c long")
    got = {(r["b"], r["c"]): r["p"] for r in df.select("b", "c", fn.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()}
    for b, c in pairs:
        assert got[b, c] == pytest.approx(exact(b, c), rel=1e-10)
    for b, c in big:  # with so many the normal form with half a step is near
        z = max(0.0, (abs(b - c) - 1) / math.sqrt(b + c))
        assert got[b, c] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_draws_have_the_moments_of_poisson():
    w = resample.cluster_weights(3, [f"h{k}" for k in range(400)], 500)[:, 1:]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and (resample.cluster_weights(3, ["h7"], 500)[0, 1:] == w[7]).all()
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2
    for mean in (1, 3, 40, 1000, 10**7):
        x = resample._row_weights(5, np.arange(50.0), np.full(50, mean), 1, 1, 400)
        assert abs(x.mean() - mean) < 5 * math.sqrt(mean / x.size) and abs(x.var() / mean - 1) < 0.06
    assert (resample._row_weights(5, np.arange(3.0), np.array([0, 2, 0]), 1, 0, 5)[[0, 2]] == 0).all()


@pytest.mark.parametrize("per_range", [40, 10**6])
@pytest.mark.parametrize("cluster", [False, True])
def test_replicates_against_plain_metrics(spark, per_range, cluster):
    """Each replicate's areas are those of the rows with the drawn weights, however the counts are ranged."""
    rows = [(f"h{k % 9}", int(RND.random() < 0.4), float(RND.randint(0, 60))) for k in range(300)]
    df = spark.createDataFrame(rows, "c string, y int, s double")
    counts = evaluate.score_counts(df, "y", "s", ("c",) if cluster else ()).withColumn("model", F.lit("m"))
    got = {r["replicate"]: r for r in resample.areas(resample.ranked_counts(counts, ("model",), cluster, per_range), 6, 11).collect()}
    assert set(got) == set(range(7))
    for rep, r in got.items():
        cells = []
        for x in counts.collect():
            if cluster:
                w = int(resample.cluster_weights(11, [x["c"]], 6)[0, rep])
                cells.append((x["s"], x["p"] * w, x["n"] * w))
            else:
                draw = lambda n, label, s=x["s"]: float(resample._row_weights(11, np.array([s]), np.array([n]), label, 0, 7)[0, rep])
                cells.append((x["s"], draw(x["p"], 1), draw(x["n"], 0)))
        pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
        area = sum(p * n * ((s > t) + 0.5 * (s == t)) for s, p, _ in cells for t, _, n in cells) / pos / neg
        at = lambda s: sum(c[1] for c in cells if c[0] >= s) / sum(c[1] + c[2] for c in cells if c[0] >= s)
        assert r["roc_auc"] == pytest.approx(area) and r["pr_auc"] == pytest.approx(sum(p * at(s) for s, p, _ in cells if p) / pos)


def test_cluster_key(spark):
    df = spark.createDataFrame([("r", "k1", 1.0, 1), ("r", None, 2.0, 0), ("r", "k1", 3.0, 1)], "run_id string, k string, s double, y int")
    assert evaluate.cluster_key(df) == "k" and evaluate.cluster_key(df.drop("k")) is None
    got = evaluate.paired_cluster_bootstrap(df.drop("k").withColumn("p", F.col("y")), "y", "p", "p", "s", "s", n=3).first()
    assert got["clusters"] == 3 and got["delta"] == 0
