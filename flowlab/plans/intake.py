"""Registered queries of what happens to rows on their way in: event forms, filters, provenance, raw labels, replay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab import functions as fn
from flowlab import sources
from flowlab.operators import clean, label, models, monitor
from flowlab.plans import views
from flowlab.plans.catalogue import query, raw_events, rounded
from flowlab.shared import shared_dir


@query("""select flow_id, orig_h as src_ip, resp_h as dst_ip, cast(orig_p as varchar) as src_port, cast(resp_p as varchar) as dst_port, case flow_id % 4 when 0 then '' when 2 then 'curl' else 'sshd' end as exe,
 case when flow_id % 2 = 0 then 7 else orig_p end as pid, case when flow_id % 5 = 0 then 'TCP' when proto_num = 6 then 'TCP' else 'UDP' end as proto from v_flows""")
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under other names, with gaps, in the form of the dashboard."""
    n = F.col("flow_id")
    raw = views.flows(spark, sf_dir).select(
        "flow_id", (F.col("start_us") / 1e6).alias("ts_s"), F.when(n % 3 != 0, F.col("orig_h")).alias("saddr_str"), F.col("orig_h").alias("saddr"), F.col("resp_h").alias("daddr_str"), F.col("orig_p").alias("sport"), F.col("resp_p").alias("dport"),
        F.when(n % 4 == 0, "nan").when(n % 4 == 1, "").when(n % 4 == 2, "curl").alias("comm"), F.lit("sshd").alias("comm_mode"), F.when(n % 2 == 1, F.col("orig_p")).otherwise(0).alias("pid_mode"), F.lit(7).alias("ebpf_pid"), F.when(n % 5 != 0, F.col("proto_num").cast("string")).alias("proto"),
    )
    return clean.normalise_event(raw).select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "exe", "pid", "proto")


@query("select flow_id as event_id, orig_h as saddr_str, resp_h as daddr_str from v_flows")
def event_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as the kernel hands them over, packet events in network order, and as text."""
    number = lambda c: F.when(F.col("evtype") == 5, fn.byteswap32(fn.ipv4_to_u32(F.col(c)))).otherwise(fn.ipv4_to_u32(F.col(c)))
    given = raw_events(spark, sf_dir).select("event_id", "evtype", number("saddr").alias("saddr"), number("daddr").alias("daddr"))
    return clean.normalise_event_ips(given).select("event_id", "saddr_str", "daddr_str")


@query("""select flow_id, 'Friday' as day, 'run-7' as run_id, 3600 as label_time_offset_sec, 0 as label_halfday_shift_sec, 10 as label_window_pre_slop_sec, 20 as label_window_post_slop_sec, m.* from v_flows,
 (select count(*) as run_rows, min(start_us) as run_span_first_us, max(start_us) as run_span_last_us from v_flows) m""")
def run_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flows(spark, sf_dir)
    meta = rows.agg(F.count(F.lit(1)).alias("rows"), F.struct(F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us")).alias("span"))
    out = clean.with_run_meta(clean.with_provenance(rows.select("flow_id"), "Friday", "run-7", 3600, 0, 10, 20), meta)
    return out.select("flow_id", "day", "run_id", *[c for c in out.columns if c.startswith("label_")], "run_rows", "run_span_first_us", "run_span_last_us")


def spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with wrong addresses, gaps, other protocols, multicast and unknown labels among them."""
    n = F.col("flow_id")
    return views.flows(spark, sf_dir).withColumns({"ts_s": F.col("start_us") / 1e6, "orig_h": F.when(n % 11 == 0, "fe80::1").otherwise(F.col("orig_h")), "resp_h": F.when(n % 13 == 0, " ").when(n % 7 == 0, "224.0.0.251").otherwise(F.col("resp_h")), "proto_num": F.when(n % 17 == 0, 1).otherwise(F.col("proto_num")), "label_family": F.when(n % 19 == 0, "UNKNOWN").otherwise(F.col("label_family"))})


def filters(spark: SparkSession, sf_dir: str) -> dict:
    last = views.flows(spark, sf_dir).agg((F.max("start_us") / 1e6).alias("t")).first()["t"]
    return {"addresses": clean.valid_addresses(), "label": clean.known_label(), "complete": clean.complete("start_us", "orig_h", "resp_h"), "protocol": clean.tcp_or_udp(), "noise": ~monitor.noise(F.col("resp_h")), "ready": clean.ready("ts_s", float(last or 0.0), 3600.0)}


@query("select filter, count(*) as rows, count(*) filter (where bad) as dropped from (" + " union all ".join(f"select '{n}' as filter, {c} as bad from v_flows" for n, c in {
    "addresses": "flow_id % 11 = 0 or flow_id % 13 = 0", "label": "flow_id % 19 = 0", "complete": "flow_id % 13 = 0", "protocol": "flow_id % 17 = 0", "noise": "flow_id % 7 = 0 and flow_id % 13 <> 0", "ready": "start_us / 1e6 > (select max(start_us) / 1e6 - 3600 from v_flows)"}.items()) + ") group by 1")
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each filter of the intake drops."""
    return clean.drop_counts(spoiled(spark, sf_dir), filters(spark, sf_dir))


@query("select count(*) as rows, count(*) filter (where flow_id % 11 = 0 or flow_id % 13 = 0 or flow_id % 17 = 0) as dropped, count(*) filter (where flow_id % 11 <> 0 and flow_id % 13 <> 0 and flow_id % 17 <> 0) as kept from v_flows")
def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are kept, beside the counts of what was read and dropped."""
    good, counts = clean.keep(spoiled(spark, sf_dir), clean.valid_addresses() & clean.tcp_or_udp(), "intake")
    return counts.crossJoin(good.agg(F.count(F.lit(1)).alias("kept")))  # one row each


RAW = """with r as (select flow_id, ts, case when hash_day = 4 then 'Friday-Afternoon.csv' else 'Monday-WorkingHours.csv' end as file from (select event_id as flow_id, ts, user_id % 5 as hash_day from events)),
m as (select file, quantile_cont(hour(ts)::double, 0.5) as median, avg((hour(ts) between 1 and 6)::int) as early from r group by 1)
"""


@query(RAW + """select f.flow_id, f.label_family, f.is_attack, case when f.flow_id % 4 = 3 then 17 else 6 end as proto_num, epoch_us(date_trunc('minute', ts)) + case when (file like '%Afternoon%' and median < 12) or (file like '%WorkingHours%' and hour(ts) between 1 and 6 and early >= 0.03) then 43200000000 else 0 end as ts_us
from r join m using (file) join v_flows f using (flow_id)""")
def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label logs as they come, with raw label names, protocol texts, and times as text without seconds, day first: read by vote, hours repaired, names made families."""
    ev = views.events(spark, sf_dir)
    name = F.when(F.col("event_type") == "error", "DoS Hulk").when(F.col("event_type") == "signup", " PortScan ").when(F.col("event_type") == "purchase", "Bot").otherwise("BENIGN")
    logs = ev.select(F.col("event_id").alias("flow_id"), name.alias("label"), F.date_format("ts", "d/M/yyyy H:mm").alias("timestamp"), F.when(F.col("event_id") % 4 == 3, "udp").otherwise("6").alias("protocol"), F.when(F.col("user_id") % 5 == 4, "Friday-Afternoon.csv").otherwise("Monday-WorkingHours.csv").alias("file"))
    read = label.parse_ts_vote(logs, "timestamp", "file").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    fixed = label.fix_hours(read, "file").withColumn("label_family", fn.label_family(F.col("label")))
    us = F.expr("timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', ts)")
    return fixed.select("flow_id", "label_family", fn.is_attack(F.col("label_family")).alias("is_attack"), fn.proto_num(F.col("protocol"), "label").alias("proto_num"), us.alias("ts_us"))


@query("""select case ebpf_pred when 1 then 'ATTACK' else 'BENIGN' end as label, case when ebpf_score_m / 1300.0::double >= 0.65 then 'high' when ebpf_score_m / 1300.0::double >= 0.35 then 'mid' else 'low' end as band, count(*) as events, round(avg(ebpf_score_m / 1300.0::double), 6) as mean_score, min(flow_id) as first_event from v_scores group by all""")
def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events written as JSON lines and replayed into the dashboard's form."""
    path = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"
    stored = views.scores(spark, sf_dir).select("flow_id", (F.col("start_us") / 1e6).alias("ts_s"), F.col("cluster_key").alias("saddr"), "ebpf_pred", (F.col("ebpf_score_m") / 1300.0).alias("ebpf_score"))
    sources.write_scored(stored, path)
    events = clean.normalise_event(sources.read_scored(spark, path, "flow_id long, ts_s double, saddr string, ebpf_pred int, ebpf_score double"))
    shown = events.select("flow_id", fn.event_label(events, "ebpf").alias("label"), fn.event_score(events, "ebpf").alias("s"))
    out = shown.groupBy("label", fn.score_band(F.col("s")).alias("band")).agg(F.count(F.lit(1)).alias("events"), F.avg("s").alias("mean_score"), F.min("flow_id").alias("first_event"))
    return rounded(out, "mean_score")


@query("select flow_id, round((base_score_m - (select min(base_score_m) from v_scores)) / ((select max(base_score_m) - min(base_score_m) from v_scores))::double, 6) as score from v_scores")
def margin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins between their ends."""
    return rounded(models.margin_scores(views.scores(spark, sf_dir), "base_score_m"), "score").select("flow_id", "score")
