"""Counters of streams that hold for any number of batches and restarts.

A listener receives the progress of every micro-batch (a query itself remembers the last hundred) and writes what was counted as one small file per batch beside
the checkpoint, named by the batch's number, so a batch that is run again replaces its own. Sums are read from there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LATE = "late"
SCHEMA = "batch long, counts map<string, long>"


class Ledger(StreamingQueryListener):
    """Keeps the counts of the stream of this name: rows read (``input``), rows that came after their watermark (``late``), and what ``observe`` counted on the way."""

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.path, self.name, self._jvm, self._conf = path, name, spark._jvm, spark._jsc.hadoopConfiguration()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        step = event.progress
        if step.name != self.name:
            return
        counts = {"input": int(step.numInputRows), LATE: sum(int(s.numRowsDroppedByWatermark) for s in step.stateOperators)}
        for name, row in step.observedMetrics.items():
            counts |= {f"{name}.{column}": int(value or 0) for column, value in row.asDict().items()}
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{step.batchId:012d}.json")
        out = where.getFileSystem(self._conf).create(where, True)
        out.writeBytes(json.dumps({"batch": step.batchId, "counts": counts}))
        out.close()


def batch_counts(spark: SparkSession, state: str) -> DataFrame:
    """(batch, name, value) of all batches of the stream with this checkpoint folder, in this run and earlier ones."""
    return spark.read.schema(SCHEMA).json(ledger_path(state)).select("batch", F.explode("counts").alias("name", "value"))


def totals(spark: SparkSession, state: str, after: int = -1) -> dict[str, int]:
    """The sums of the counts of all batches behind ``after``, by name: a few rows."""
    rows = batch_counts(spark, state).where(F.col("batch") > after).groupBy("name").agg(F.sum("value").alias("n")).collect()
    return {r["name"]: r["n"] for r in sorted(rows)}


def missing_batches(spark: SparkSession, state: str) -> list[int]:
    """Batches up to the last that the checkpoint has as committed which nobody has counted, as when the driver died between the two. Empty: the sums are exact."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(f"{state}/commits")  # the checkpoint keeps the last ones only
    last = names.agg(F.max(F.regexp_extract("path", r"(\d+)$", 1).cast("long"))).first()[0]
    every = spark.range(0 if last is None else last + 1).withColumnRenamed("id", "batch")
    return sorted(r["batch"] for r in every.join(batch_counts(spark, state), "batch", "left_anti").collect())


def ledger_path(state: str) -> str:
    return f"{state.rstrip('/')}-counts"


def run_counted(out: DataFrame, path: str, state: str, mode: str = "append") -> int:
    """Runs a stream over what there is, appends its rows at ``path`` and keeps its counts. The number of the last batch before this run (-1: none)."""
    spark, name = out.sparkSession, f"counted-{uuid.uuid4().hex}"
    ledger = Ledger(spark, ledger_path(state), name)
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger.path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    before = spark.read.schema(SCHEMA).json(ledger.path).agg(F.max("batch")).first()[0]
    spark.streams.addListener(ledger)
    try:
        query = out.writeStream.format("parquet").queryName(name).outputMode(mode).option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(ledger)
    return -1 if before is None else int(before)
