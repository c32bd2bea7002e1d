"""Dashboard queries over scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.scans import percentiles, trailing_rows


def kpis(events: DataFrame, score: str, pred: str) -> DataFrame:
    n = F.count(F.lit(1))
    return events.agg(n.alias("events"), F.sum(pred).alias("alerts"), F.round(100.0 * F.sum(pred) / n, 6).alias("alert_pct"), F.round(F.avg(score), 6).alias("mean_score"), F.max(score).alias("max_score"))


def trailing(events: DataFrame, time: str, width: int, now: int | None = None) -> DataFrame:
    """Events of the trailing window that ends at the newest event or ``now``, whichever is later."""
    last = events.agg(F.greatest(F.max(time), F.lit(now).cast("long")).alias("__end"))
    return events.crossJoin(F.broadcast(last)).where(F.col(time) >= F.col("__end") - width).drop("__end")  # one row


def score_buckets(events: DataFrame, time: str, score: str, step: int) -> DataFrame:
    """Events and mean score by bucket, with a centred moving average of three buckets. The window runs over buckets, whose number the trailing window bounds."""
    out = events.groupBy((F.floor(F.col(time) / step) * step).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    return out.withColumn("smooth", F.avg("mean_score").over(Window.orderBy("bucket").rowsBetween(-1, 1)))


def moving_avg(df: DataFrame, value: str, order: list[str], by: list[str], rows: int = 5) -> DataFrame:
    """The mean of the row's value and the ``rows`` - 1 before it in its group. Ranges of the order are windows of their own, with the last rows before them: a hot group is spread over tasks."""
    ranged, copied = trailing_rows(df, by, order, rows - 1)
    mean = F.avg(value).over(Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(1 - rows, 0))
    return ranged.withColumn("moving_avg", mean).where(~F.col(copied)).drop("part", copied)


def recent(events: DataFrame, time: str, tie: str, n: int = 300) -> DataFrame:
    return events.orderBy(F.desc(time), F.desc(tie)).limit(n)


def top_labels(events: DataFrame, label: str, n: int) -> DataFrame:
    return events.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(n)


def anomalies(events: DataFrame, score: str, threshold: float) -> DataFrame:
    return events.where(F.col(score) >= threshold)


def resource_summary(samples: DataFrame, run: str, values: list[str]) -> DataFrame:
    """Mean and 95th percentile per run, then mean, deviation and range over runs."""
    per = samples.groupBy(run).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])
    for v in values:  # exact, with no run's samples in one task
        q = percentiles(samples, v, [0.95], (run,)).select(F.col(run).alias("__run"), F.col("q0").alias(f"{v}_p95"))
        per = per.join(q, F.col(run).eqNullSafe(F.col("__run")), "left").drop("__run")
    return per.agg(*[x for v in values for c in (f"{v}_mean", f"{v}_p95") for x in (F.avg(c).alias(f"{c}_avg"), F.stddev_samp(c).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range"))])


def noise(dst: Column) -> Column:
    """Multicast and broadcast destinations: 224 to 239, 255.255.255.255, ff00::/8."""
    return F.trim(dst).rlike(r"^(22[4-9]|23[0-9])\.|^255\.255\.255\.255$|^[fF][fF][0-9a-fA-F]{2}:")
