"""The rolling dashboard of a stream: counts and mean scores by time bucket, kept current as batches come.

Each micro-batch gives the buckets that it changed, whole; they are written under the batch's number, so a batch that runs again replaces its own rows and
nothing is counted twice. The dashboard reads each bucket's latest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "bucket long, n long, total double, alerts long, batch long"


def keep_buckets(scored: DataFrame, at: str, score: str, pred: str, step_us: int, path: str, state: str, delay: str = "1 day"):
    """Starts the stream of scored events (``at``: a timestamp) and returns its query. Buckets behind the newest event by ``delay`` are closed: their state goes, later rows of
    theirs are dropped; what was written of them stays."""
    width = f"{step_us} microseconds"
    buckets = scored.withWatermark(at, delay).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(score).cast("double")).alias("total"), F.sum(F.col(pred).cast("long")).alias("alerts"))
    shown = buckets.select(F.unix_micros("window.start").alias("bucket"), "n", "total", "alerts")

    def merge(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/at={batch}")  # buckets of one batch

    return shown.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def dashboard(spark: SparkSession, path: str, width_us: int | None = None, step_us: int = 900_000_000) -> DataFrame:
    """(bucket, n, mean_score, alerts, smooth: the mean of the bucket's and its neighbours' means), of the ``width_us`` up to the newest bucket's end or of all."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/at=*")
    now = rows.groupBy("bucket").agg(F.max_by(F.struct("n", "total", "alerts"), "batch").alias("x"))
    if width_us:
        last = rows.agg((F.max("bucket") + step_us - width_us).alias("from"))
        now = now.crossJoin(F.broadcast(last)).where(F.col("bucket") >= F.col("from"))  # one row
    mean = (F.col("x.total") / F.col("x.n")).alias("mean_score")
    return now.select("bucket", "x.n", mean, "x.alerts").withColumn("smooth", F.avg("mean_score").over(Window.orderBy("bucket").rowsBetween(-1, 1)))
