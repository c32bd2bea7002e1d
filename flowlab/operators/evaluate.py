"""Exact ranking metrics, thresholds, rates and paired statistics, as aggregates over score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions import BENIGN_LIKE, mcnemar_p, wilson
from flowlab.operators import resample
from flowlab.operators.scans import percentiles, prefix_sums
from flowlab.shared import written


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, y: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def binary_metrics(df: DataFrame, y: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates; a rate without rows to divide by is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = confusion(df, y, pred, by).withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "fpr": ratio(fp, fp + tn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_counts(df: DataFrame, y: str, score: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Positives and negatives of every distinct score: the only form in which the ranking metrics read rows."""
    w = F.col(weight) if weight else F.lit(1)
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("n"))


def roc_auc(df: DataFrame, y: str, score: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Exact area with ties at one half; null with one class."""
    sums = prefix_sums(score_counts(df, y, score, by, weight), by)
    area = F.sum(F.col("n").cast("double") * (F.col("tp") - F.col("p") + F.col("p") / 2.0))
    pairs = F.max("pos").cast("double") * F.max("neg")
    return sums.groupBy(*by).agg(F.when(pairs > 0, area / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    sums = prefix_sums(score_counts(df, y, score, by, weight), by)
    step = F.when(F.col("tp") + F.col("fp") > 0, F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return sums.groupBy(*by).agg(F.when(F.max("pos") > 0, F.sum(step) / F.max("pos")).alias("average_precision"))


def pr_points(df: DataFrame, y: str, score: str) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    return prefix_sums(score_counts(df, y, score)).select(F.col("s").alias("threshold"), "tp", "fp", (tp / (tp + fp)).alias("precision"), ratio(tp, F.col("pos")).alias("recall"))


def roc_points(df: DataFrame, y: str, score: str, drop_collinear: bool = False) -> DataFrame:
    """One point for each distinct score. With ``drop_collinear`` only the first, the last, and those at which the curve's step changes: where the next lower score adds other
    numbers of positives or negatives."""
    sums = prefix_sums(score_counts(df, y, score))
    if drop_collinear:
        first, last = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n")), F.col("next_p").isNull()
        sums = sums.where(first | last | (F.col("p") != F.col("next_p")) | (F.col("n") != F.col("next_n")))
    return sums.select(F.col("s").alias("threshold"), ratio(F.col("tp"), F.col("pos")).alias("tpr"), ratio(F.col("fp"), F.col("neg")).alias("fpr"))


def select_threshold(df: DataFrame, y: str, score: str, mode: str, target: float = 0.0) -> DataFrame:
    """One row (threshold, tp, fp, pos, neg). f1: the greatest F1, ties to the higher threshold; fpr: the greatest recall whose false
    positive rate is within the target; recall: the least false positive rate that reaches the target. With fewer than ten positives (f1) or one class
    (others) 0.5; where no score meets an fpr target, infinity, as nothing may be flagged."""
    sums = prefix_sums(score_counts(df, y, score))
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    if mode == "f1":
        good, order, enough = F.lit(True), F.struct(ratio(2.0 * tp, tp + fp + pos), F.col("s")), F.max("pos") >= 10
    else:
        enough = (F.max("pos") > 0) & (F.max("neg") > 0)
        good = (fp <= target * neg) if mode == "fpr" else (tp >= target * pos)
        order = F.struct(tp, F.col("s")) if mode == "fpr" else F.struct(-fp, F.col("s"))
    pick = F.max_by(F.struct("s", "tp", "fp"), F.when(good, order))
    none = F.lit(float("inf")) if mode == "fpr" else F.min("s").cast("double")
    return sums.agg(F.coalesce(F.when(enough, F.coalesce(pick["s"].cast("double"), none)), F.lit(0.5)).alias("threshold"), F.when(enough, pick["tp"]).alias("tp"), F.when(enough, pick["fp"]).alias("fp"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))


def family_rates(df: DataFrame, family: str, pred: str) -> DataFrame:
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("support"), F.sum(pred).alias("detected"), (F.sum(pred) / F.count(F.lit(1))).alias("rate"))


def paired_family(df: DataFrame, family: str, y: str, a: str, b: str) -> DataFrame:
    """Per attack family: both detection counts and rates with Wilson intervals, their difference, discordant counts, exact McNemar p, Holm p."""
    rows = df.where((F.col(y) == 1) & ~F.coalesce(F.col(family), F.lit("nan")).isin(*BENIGN_LIKE))
    got = rows.groupBy(family).agg(F.count(F.lit(1)).alias("support"), F.sum(a).alias("a_detected"), F.sum(b).alias("b_detected"), F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    n = F.col("support")
    (al, ah), (bl, bh) = wilson(F.col("a_detected"), n), wilson(F.col("b_detected"), n)
    out = got.withColumns({"a_rate": F.col("a_detected") / n, "b_rate": F.col("b_detected") / n, "a_low": al, "a_high": ah, "b_low": bl, "b_high": bh, "p_exact": mcnemar_p(F.col("only_a"), F.col("only_b"))})
    return holm(out.withColumn("delta", F.col("b_rate") - F.col("a_rate")), "p_exact", "p_holm")


def holm(df: DataFrame, p: str, out: str) -> DataFrame:
    """Holm's step-down over a small table (one row per test); null p stay null and do not count."""
    rank = Window.orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy())
    scaled = (m - F.row_number().over(rank) + 1) * F.col(p)
    ordered = df.withColumn("__s", scaled)
    running = F.max("__s").over(rank.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ordered.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("__s")


def coverage_pivot(df: DataFrame, family: str, role: str, roles: list[str]) -> DataFrame:
    return df.groupBy(family).pivot(role, roles).count().fillna(0, roles)


def score_summary(df: DataFrame, score: str, by: str) -> DataFrame:
    """n, mean and exact p50 and p95 by class; a class of any size is spread over tasks."""
    means = df.groupBy(F.col(by).alias("__by")).agg(F.count(score).alias("n"), F.avg(score).alias("mean"))
    q = percentiles(df, score, [0.5, 0.95], (by,))
    return means.join(q.drop("n"), F.col("__by").eqNullSafe(F.col(by)), "left").select(F.col("__by").alias(by), "n", "mean", F.col("q0").alias("p50"), F.col("q1").alias("p95"))  # a row per class


def histogram(df: DataFrame, score: str, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of equal bins; the upper end belongs to the last one."""
    bin_ = F.least(F.floor((F.col(score) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(score).between(low, high)).groupBy(*by, bin_.alias("bin")).count()


def cumulative_share(df: DataFrame, value: str, order: str) -> DataFrame:
    """Share of the total of clipped values up to each row, greatest first; a table of one row per feature."""
    clipped = F.greatest(F.col(value), F.lit(0))
    w = Window.orderBy(F.desc("clipped"), order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("clipped", clipped).withColumn("cum_share", F.sum("clipped").over(w) / F.sum("clipped").over(Window.partitionBy()))


def rank_consensus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Mean of two ranks (columns rank); a missing rank is one more than that side's greatest."""
    side = lambda d, n: d.select(key, F.col("rank").alias(n))
    top = a.agg(F.max("rank").alias("ma")).crossJoin(F.broadcast(b.agg(F.max("rank").alias("mb"))))
    both = side(a, "rank_a").join(side(b, "rank_b"), key, "full_outer").crossJoin(F.broadcast(top))
    filled = both.withColumns({"rank_a": F.coalesce("rank_a", F.col("ma") + 1), "rank_b": F.coalesce("rank_b", F.col("mb") + 1)})
    return filled.select(key, "rank_a", "rank_b", ((F.col("rank_a") + F.col("rank_b")) / 2.0).alias("mean_rank"))


def compare_outer(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer").withColumn("delta", F.col("b") - F.col("a"))


def pair_predictions(a: DataFrame, b: DataFrame, key: str, y: str) -> DataFrame:
    """Two prediction sets joined by row identity; rows of one side only, or with unequal labels, are flagged as misaligned."""
    joined = a.alias("a").join(b.alias("b"), key, "full_outer")
    return joined.withColumn("aligned", F.coalesce(F.col(f"a.{y}") == F.col(f"b.{y}"), F.lit(False)))


def bootstrap_ci(df: DataFrame, y: str, score: str, metric: str = "roc_auc", cluster: str | None = None, n: int = 300, seed: int = 104, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of a ranking metric over Poisson replicates, of rows or of clusters; replicates with one class are left out.

    Rows are counted by (cluster, score) first; each count's weights in all replicates are drawn in the task that holds it (``resample``)."""
    rows = df.withColumn("c", F.col(cluster).cast("string")) if cluster else df
    counts = score_counts(rows, y, score, ("c",) if cluster else ()).withColumn("model", F.lit("one"))
    each = resample.areas(resample.ranked_counts(counts, ("model",), bool(cluster)), n, seed)
    v = F.col("roc_auc" if metric == "roc_auc" else "pr_auc")
    drawn = each.where((F.col("replicate") > 0) & v.isNotNull()).select(v.alias("v"))
    return drawn.agg(F.lit(metric).alias("metric"), F.count("v").alias("replicates"), F.avg("v").alias("mean"), F.percentile("v", low).alias("low"), F.percentile("v", high).alias("high"))  # n rows


#: Columns that may name what is drawn together, tried in this order.
CLUSTERS = ("run_id", "k", "day", "orig_h", "src_ip")


def cluster_key(df: DataFrame, candidates: tuple[str, ...] = CLUSTERS) -> str | None:
    """The first of these columns that is there with more than one value, null counting as one; None: rows are drawn one by one."""
    there = [c for c in candidates if c in df.columns]
    ends = df.agg(*[(F.min(F.coalesce(F.col(c).cast("string"), F.lit("nan"))) < F.max(F.coalesce(F.col(c).cast("string"), F.lit("nan")))).alias(c) for c in there]).first() if there else {}
    return next((c for c in there if ends[c]), None)


def paired_cluster_bootstrap(df: DataFrame, y: str, a: str, b: str, score_a: str, score_b: str, cluster: str | None = None, n: int = 1000, seed: int = 104) -> DataFrame:
    """Point values and intervals of six metric differences (b minus a) over cluster replicates: (metric, delta, replicates, mean, low, high, clusters).

    ``cluster``: by default that of ``cluster_key``; where no column has several values each row is a cluster. F1, precision, recall and the false-positive rate
    are of the predictions, counted per cluster first; the two areas are of the scores, counted per (cluster, score) first. Both sides draw the same weights
    (``resample.cluster_weights``). Replicate 0 has every cluster once and is the point value; replicates in which a metric has no value are left out of its
    interval. F1 and precision are 0 where nothing is predicted or found."""
    cluster = cluster or cluster_key(df)
    c = F.col(cluster).cast("string") if cluster else F.monotonically_increasing_id().cast("string")
    rows = written(df.select(c.alias("c"), *[F.col(x).alias(k) for k, x in (("y", y), ("a", a), ("b", b), ("sa", score_a), ("sb", score_b))]), "paired")

    def cells(model: str) -> DataFrame:
        hit = lambda yy: F.count_if((F.col("y") == yy) & (F.col(model) == 1))
        return rows.groupBy("c").agg(F.lit(model).alias("model"), hit(1).alias("tp"), hit(0).alias("fp"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))

    def counts(model: str) -> DataFrame:
        return score_counts(rows, "y", f"s{model}", ("c",)).withColumns({"model": F.lit(model), "s": F.col("s").cast("double")})

    got = resample.weighted_cells(cells("a").unionByName(cells("b")), ["tp", "fp", "pos", "neg"], n, seed)
    rate = lambda top, bottom: F.when(bottom > 0, top / bottom)
    tp, fp, pos, neg = (F.col(x) for x in ("tp", "fp", "pos", "neg"))
    or_zero = lambda x: F.when(pos + neg > 0, F.coalesce(x, F.lit(0.0)))
    rates = got.select("replicate", "model", or_zero(rate(2.0 * tp, tp + fp + pos)).alias("f1"), or_zero(rate(tp, tp + fp)).alias("precision"), rate(tp, pos).alias("recall"), rate(fp, neg).alias("fpr"))
    both = resample.areas(resample.ranked_counts(counts("a").unionByName(counts("b")), ("model",), True), n, seed)

    def long(table: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
        value = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")
        side = lambda model: F.max(F.when(F.col("model") == model, F.col("v")))
        return table.select("replicate", "model", value).select("replicate", "model", "x.*").groupBy("replicate", "metric").agg((side("b") - side("a")).alias("delta"))

    deltas = long(rates, ("f1", "precision", "recall", "fpr")).union(long(both, ("roc_auc", "pr_auc")))
    drawn = F.when(F.col("replicate") > 0, F.col("delta"))
    out = deltas.groupBy("metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("delta"))).alias("delta"), F.count(drawn).alias("replicates"), F.avg(drawn).alias("mean"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))  # n values a metric
    return out.crossJoin(F.broadcast(rows.agg(F.count_distinct("c").alias("clusters"))))  # one row


def ecdf(df: DataFrame, score: str) -> DataFrame:
    """(score, share): the share of rows at or below every distinct score."""
    sums = prefix_sums(score_counts(df.withColumn("__y", F.lit(1)), "__y", score))
    return sums.select(F.col("s").alias("score"), (1.0 - (F.col("tp") - F.col("p")) / F.col("pos")).alias("share"))
