"""Flow tables derived from the driver's ``events``, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOWS = """
select event_id as flow_id, {us} as start_us, {us} + cast(floor(value * 100000) as bigint) as end_us,
 concat('10.0.0.', cast(user_id % 20 as varchar(4))) as orig_h, concat('10.0.1.', cast((event_id * 7) % 16 as varchar(4))) as resp_h,
 1024 + user_id as orig_p, case event_id % 4 when 0 then 22 when 1 then 80 when 2 then 443 else 53 end as resp_p,
 case when event_id % 4 = 3 then 17 else 6 end as proto_num,
 cast(floor(value * 100) as bigint) as orig_bytes, cast(floor(value * 37) as bigint) as resp_bytes,
 case event_type when 'error' then 'DoS' when 'signup' then 'PortScan' when 'purchase' then 'Bot' else 'BENIGN' end as label_family,
 case when event_type in ('error', 'signup', 'purchase') then 1 else 0 end as is_attack,
 cast(floor({us} / 86400000000.0) as bigint) % 5 as day_ix
from {events}"""
KERNEL = """
select f.flow_id * 2 + p.part as part_id,
 case when f.flow_id % 5 = 0 then f.resp_h else f.orig_h end as saddr, case when f.flow_id % 5 = 0 then f.orig_h else f.resp_h end as daddr,
 case when f.flow_id % 5 = 0 then f.resp_p else f.orig_p end as sport, case when f.flow_id % 5 = 0 then f.orig_p else f.resp_p end as dport,
 f.proto_num as proto, f.start_us + p.part * 5000000 as first_us, f.end_us + p.part * 5000000 as last_us,
 f.flow_id % 50 + 1 + p.part as samples, f.orig_bytes + 40 as bytes_sent, f.resp_bytes + 20 as bytes_recv
from {v_flows} f join (select 0 as part union all select 1 as part) p on p.part = 0 or f.flow_id % 7 = 0
where f.flow_id % 3 <> 2"""
SCORES = """
select flow_id, label_family, is_attack as y_true, orig_h as cluster_key, day_ix, start_us,
 (flow_id * 7919) % 1000 + 300 * is_attack as base_score_m, (flow_id * 104729) % 1000 + 250 * is_attack as ebpf_score_m,
 case when (flow_id * 7919) % 1000 + 300 * is_attack >= 780 then 1 else 0 end as base_pred,
 case when (flow_id * 104729) % 1000 + 250 * is_attack >= 750 then 1 else 0 end as ebpf_pred
from {v_flows}"""
#: The three as common table expressions for the other engine.
CTES = "with v_flows as (" + FLOWS.format(us="epoch_us(ts)", events="events") + "),\nv_kernel as (" + KERNEL.format(v_flows="v_flows") + "),\nv_scores as (" + SCORES.format(v_flows="v_flows") + ")"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flows(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Of the table, or of a stream of its rows."""
    # A zoneless time minus the zoneless epoch: the same in any session zone.
    us = "timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', ts)"
    return spark.sql(FLOWS.replace("{us}", us), events=events(spark, sf_dir) if source is None else source)


def kernel(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    return spark.sql(KERNEL, v_flows=flows(spark, sf_dir, source))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORES, v_flows=flows(spark, sf_dir))


def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the attack rows, keyed by orig_h."""
    return flows(spark, sf_dir).where("is_attack = 1").select(F.col("flow_id").alias("label_id"), "orig_h", F.col("start_us").alias("ts_us"), "label_family")
