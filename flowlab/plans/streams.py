"""Registered queries of streams: what the streams themselves give, without a final pass, counters with late rows, growing logs, the rolling dashboard."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.plans import views
from flowlab.plans.catalogue import EPOCH, STREAMED, flushed, packet_events, query, rounded, stream_source, streamed
from flowlab.shared import new_path
from flowlab.sources.growing import json_rows, stream_log
from flowlab.streaming import counters
from flowlab.streaming.dashboard import dashboard, keep_buckets

STAGES = 6
#: Rows of a log file, which one task sorts and writes.
FILE_ROWS = 250_000
#: When a row comes: by its number, every 17th two stages later, behind the watermark (a batch drops what is behind the watermark of the batch before it).
STAGE = "least(3, floor((event_id - lo) * 4 / (hi - lo + 1))) + case when event_id % 17 = 0 then 2 else 0 end"
DELAY_S = 3600
EVENT = "event_id long, us long, user_id long, event_type string, value double"


def grown_logs(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """A folder of JSON logs of all events, as it stands after each stage: the files of a stage are those of the one before with more lines at their ends."""
    ends = views.events(spark, sf_dir).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    parts = max(6, -(-views.events(spark, sf_dir).count() // FILE_ROWS))
    rows = views.events(spark, sf_dir).crossJoin(F.broadcast(ends)).withColumn("us", F.expr(EPOCH)).withColumn("stage", F.expr(STAGE).cast("int"))  # one row
    lines = rows.select("stage", "event_id", F.to_json(F.struct("event_id", "us", "user_id", "event_type", "value")).alias("line"))
    logs, path = new_path(spark, "logs"), spark._jvm.org.apache.hadoop.fs.Path
    files = path(logs).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(logs))
    for stage in range(STAGES):
        written = new_path(spark, "grown")
        lines.where(F.col("stage") <= stage).repartition(parts, "event_id").sortWithinPartitions("stage", "event_id").select("line").write.text(written)
        for status in files.listStatus(path(written)):  # a few names
            name = status.getPath().getName()
            if name.startswith("part-"):
                target = path(f"{logs}/{name[:10]}.log")
                files.delete(target, False)
                files.rename(status.getPath(), target)
        yield logs


def log_events(spark: SparkSession, logs: str) -> DataFrame:
    """The events of growing logs as a stream."""
    ts = F.expr("timestampadd(microsecond, us, timestamp_ntz '1970-01-01 00:00:00')")
    return json_rows(stream_log(spark, logs, ".log"), EVENT).withColumn("ts", ts)


@query("select event_id, epoch_us(ts) as us, user_id, event_type, round(value, 6) as value, 1::bigint as times from events")
def growing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that grow five times under a stream: every line once."""
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    for logs in grown_logs(spark, sf_dir):
        counters.run_counted(log_events(spark, logs).drop("ts"), out, state)
    given = spark.read.schema(EVENT).parquet(out)
    return rounded(given.groupBy("event_id", "us", "user_id", "event_type", "value").agg(F.count(F.lit(1)).alias("times")), "value")


@query(f"""with d as (select event_id, epoch_us(ts) as us, {STAGE} as stage from events, (select min(event_id) as lo, max(event_id) as hi from events)),
w as (select s.stage, max(us) as newest from (select distinct stage from d) s join d on d.stage < s.stage - 1 group by 1),
l as (select d.event_id, newest is not null and us <= (newest // 1000 - {DELAY_S * 1000}) * 1000 as late from d left join w using (stage))
select count(*) as "connections.rows", count(*) as "scored.rows", cast(sum(ebpf_pred) as bigint) as "scored.alerts", count(*) filter (where late) as late, count(*) filter (where not late) as kept from v_scores join l on l.event_id = flow_id""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream counts on its way over six runs with one checkpoint: connections read, rows scored, alerts, rows that came after their watermark, and the rows it gave."""
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    for logs in grown_logs(spark, sf_dir):
        source = views.flows(spark, sf_dir, log_events(spark, logs)).observe("connections", F.count(F.lit(1)).alias("rows"))
        scored = spark.sql(views.SCORES, v_flows=source).observe("scored", F.count(F.lit(1)).alias("rows"), F.sum("ebpf_pred").alias("alerts"))
        at = F.timestamp_micros("start_us")
        given = scored.select("flow_id", at.alias("at")).withWatermark("at", f"{DELAY_S} seconds").dropDuplicatesWithinWatermark(["flow_id"])
        counters.run_counted(given, out, state)
    if missing := counters.missing_batches(spark, state):
        raise RuntimeError(f"batches {missing} are not counted")
    sums = counters.totals(spark, state)
    names = ["connections.rows", "scored.rows", "scored.alerts", "late"]
    row = spark.createDataFrame([tuple(sums.get(n, 0) for n in names)], ", ".join(f"`{n}` long" for n in names))
    return row.crossJoin(spark.read.schema("flow_id long").parquet(out).agg(F.count(F.lit(1)).alias("kept")))  # one row


@query(STREAMED + """, g as (select cast(floor(us / 5000000.0) as bigint) * 5000000 as flush_us, a as saddr, b as daddr, port as sport, dport, count(*) as samples, min(us) as first_us, max(us) as last_us from s where evtype <> 3 or bytes > 0 group by all)
select * from g where flush_us + 5000000 <= (select max(us) // 1000 * 1000 - 5000000 from s)""")
def streamed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow partials that the stream itself gives: of the windows that its watermark has passed."""
    return streamed(spark, flushed(packet_events(stream_source(spark, sf_dir)))).select("flush_us", "saddr", "daddr", "sport", "dport", "samples", "first_us", "last_us")


@query("""select bucket, n, alerts, round(m, 6) as mean_score, round(avg(m) over (order by bucket rows between 1 preceding and 1 following), 6) as smooth from
(select cast(floor(start_us / 900000000.0) as bigint) * 900000000 as bucket, count(*) as n, cast(sum(ebpf_pred) as bigint) as alerts, avg(ebpf_score_m) as m from v_scores group by 1)""")
def stream_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's buckets as six runs of a stream keep them, the rows of each in any order of time."""
    kept, state = new_path(spark, "kept"), new_path(spark, "state")
    for logs in grown_logs(spark, sf_dir):
        scored = spark.sql(views.SCORES, v_flows=views.flows(spark, sf_dir, log_events(spark, logs)))
        keep_buckets(scored.withColumn("at", F.timestamp_micros("start_us")), "at", "ebpf_score_m", "ebpf_pred", 900_000_000, kept, state, "3650 days").awaitTermination()
    return rounded(dashboard(spark, kept), "mean_score", "smooth")
