"""The registered queries of the flow operators, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.operators import enrich, evaluate, label, models, monitor, prepare, resample
from flowlab.plans import views
from flowlab.shared import shared_dir
from flowlab.streaming import flow_partials, matching, stream_enrich, with_final_pass

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED, SLOP, TOLERANCE, QUOTA = 104, 5_000_000, 600_000_000, 200
FAMILIES = ["Bot", "DoS", "PortScan"]
BEST, FIRST = ("samples", "last_us", "part_id"), ("first_us", "part_id")
TUPLE = "saddr, daddr, sport, dport, proto"


def query(sql: str | None = None):
    """Registers a query under its name; the SQL may use v_flows, v_kernel and v_scores."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (views.CTES + ",\n" + sql.strip()[5:]) if sql.strip().startswith("with ") else views.CTES + "\n" + sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def best_flows(order: str) -> str:
    return f"select * from (select *, row_number() over (partition by {TUPLE} order by {order}) as rn from v_kernel) where rn = 1"


def matched_sql(order: str) -> str:
    """CTEs k and m: one flow per key, and the match of every connection."""
    cols = ("part_id", "first_us", "last_us", "samples", "bytes_sent", "bytes_recv")
    picked = ", ".join(f"case when f.part_id is not null then f.{c} else r.{c} end as ebpf_{c}" for c in cols)
    return f"""with k as ({best_flows(order)}),
m as (select c.*, case when f.part_id is not null then 'fwd' when r.part_id is not null then 'rev' else 'none' end as match_dir, {picked}
 from v_flows c left join k f on c.orig_h = f.saddr and c.resp_h = f.daddr and c.orig_p = f.sport and c.resp_p = f.dport and c.proto_num = f.proto
 left join k r on c.resp_h = r.saddr and c.orig_h = r.daddr and c.resp_p = r.sport and c.orig_p = r.dport and c.proto_num = r.proto)
"""


LIVE, REPLAY = "samples desc, last_us desc, part_id desc", "first_us, part_id"
WINDOWED = f"(ebpf_first_us is null or (ebpf_first_us <= end_us + {SLOP} and ebpf_last_us >= start_us - {SLOP}))"
SHOWN = "flow_id, match_dir, ebpf_part_id, ebpf_samples, ebpf_bytes_sent, ebpf_bytes_recv"
STATS = """count(*) as total, count(*) filter (where match_dir <> 'none') as enriched, count(*) filter (where match_dir <> 'none' and ebpf_bytes_sent > 0) as with_data,
 round(100.0 * count(*) filter (where match_dir <> 'none') / count(*), 6) as enriched_pct, coalesce(sum(ebpf_bytes_sent), 0) as bytes_sent, coalesce(sum(ebpf_bytes_recv), 0) as bytes_recv"""


def live(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return enrich.in_window(enrich.match_live(views.flows(spark, sf_dir, events), views.kernel(spark, sf_dir, events), F.struct(*BEST)), SLOP)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrichment_stats(live(spark, sf_dir), ("label_family",))


# Enrichment


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as socket events: the event type's place in the alphabet is its kind."""
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    ev = views.events(spark, sf_dir).withColumn("evtype", kind)
    f = views.flows(spark, sf_dir).select(F.col("flow_id").alias("event_id"), F.col("start_us").alias("ts_us"), F.col("orig_h").alias("saddr"), F.col("resp_h").alias("daddr"), F.col("orig_p").alias("sport"), F.col("resp_p").alias("dport"), F.col("proto_num").alias("proto"), F.col("orig_bytes").alias("bytes"))
    return f.join(ev.select("event_id", "evtype", F.col("user_id").alias("pid")), "event_id").withColumn("outgoing", F.col("event_id") % 2 == 0)


EVENT_CTE = """with e as (select f.flow_id as event_id, f.start_us as ts_us, f.orig_h as saddr, f.resp_h as daddr, f.orig_p as sport, f.resp_p as dport, f.proto_num as proto, f.orig_bytes as bytes,
 case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as evtype, user_id as pid from v_flows f join events v on v.event_id = f.flow_id)
"""


@query(EVENT_CTE + f"""select cast(floor(ts_us / 5000000.0) as bigint) * 5000000 as flush_us, {TUPLE}, min(ts_us) as first_us, max(ts_us) as last_us,
 sum(case when evtype = 2 or (evtype = 5 and event_id % 2 = 0) then bytes else 0 end) as bytes_sent,
 sum(case when evtype = 3 or (evtype = 5 and event_id % 2 = 1) then bytes else 0 end) as bytes_recv,
 cast(sum(case when evtype = 4 then 1 else 0 end) as bigint) as retransmits, cast(sum(case when evtype = 1 then 1 else 0 end) as bigint) as state_changes, count(*) as samples, arg_max(pid, row(ts_us, event_id)) as pid
from e where evtype <> 3 or bytes > 0 group by all""")
def events_to_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flush = (F.floor(F.col("ts_us") / F.lit(5_000_000.0)) * 5_000_000).cast("long")
    return enrich.aggregate_events(raw_events(spark, sf_dir), flush, order=("ts_us", "event_id")).withColumnRenamed("flush", "flush_us")


@query(f"select {TUPLE}, part_id, samples, first_us, last_us, bytes_sent, bytes_recv from ({best_flows(LIVE)})")
def dedup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.dedup_max(views.kernel(spark, sf_dir), F.struct(*BEST))


@query(f"select {TUPLE}, part_id, samples, first_us, last_us, bytes_sent, bytes_recv from ({best_flows(REPLAY)})")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.dedup_first(views.kernel(spark, sf_dir), F.struct(*FIRST))


@query(f"select {TUPLE}, min(first_us) as first_us, max(last_us) as last_us, sum(bytes_sent) as bytes_sent, sum(bytes_recv) as bytes_recv, sum(samples) as samples, count(*) as partials from v_kernel group by all")
def rollup_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.rollup_partials(views.kernel(spark, sf_dir))


@query(matched_sql(REPLAY) + f"select {SHOWN} from m")
def match_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.match_replay(views.flows(spark, sf_dir), views.kernel(spark, sf_dir), F.struct(*FIRST)).select(*SHOWN.split(", "))


@query(matched_sql(LIVE) + f"select {SHOWN} from m where {WINDOWED}")
def match_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).select(*SHOWN.split(", "))


@query(f"""with b as (select c.flow_id, k.part_id, 'fwd' as match_dir from v_flows c join v_kernel k on c.orig_h = k.saddr and c.resp_h = k.daddr and c.orig_p = k.sport and c.resp_p = k.dport and c.proto_num = k.proto and k.first_us <= c.end_us + {SLOP} and k.last_us >= c.start_us - {SLOP}
union all select c.flow_id, k.part_id, 'rev' from v_flows c join v_kernel k on c.resp_h = k.saddr and c.orig_h = k.daddr and c.resp_p = k.sport and c.orig_p = k.dport and c.proto_num = k.proto and k.first_us <= c.end_us + {SLOP} and k.last_us >= c.start_us - {SLOP})
select * from b""")
def match_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.match_interval(views.flows(spark, sf_dir), views.kernel(spark, sf_dir), SLOP).select("flow_id", "part_id", "match_dir")


@query("""with c as (select (max(end_us) - min(start_us)) / 1e6 as conn_span_s from v_flows), k as (select (max(last_us) - min(first_us)) / 1e6 as kernel_span_s from v_kernel),
r as (select conn_span_s, kernel_span_s, conn_span_s / greatest(kernel_span_s, 1.0) as ratio from c, k)
select round(conn_span_s, 6) as conn_span_s, round(kernel_span_s, 6) as kernel_span_s, round(ratio, 6) as ratio, case when ratio > 500 then 'topspeed' when ratio > 100 then 'fast' when ratio > 10 then 'moderate' when ratio > 2 then 'realtime' else 'live' end as scenario from r""")
def replay_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(enrich.replay_scenario(views.flows(spark, sf_dir), views.kernel(spark, sf_dir)), "conn_span_s", "kernel_span_s", "ratio")


@query("select part_id, first_us + s as first_us, last_us + s as last_us, s as shift_us from v_kernel, (select (select min(start_us) from v_flows) - (select min(first_us) from v_kernel) as s)")
def align_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.align_clocks(views.flows(spark, sf_dir), views.kernel(spark, sf_dir)).select("part_id", "first_us", "last_us", "shift_us")


@query(matched_sql(LIVE) + f"select label_family, {STATS} from m where {WINDOWED} group by label_family")
def enrichment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


# Labels


@query("""with l as (select * from v_flows where is_attack = 1)
select flow_id, label_family, 'fwd' as dir, concat_ws('|', orig_h, resp_h, orig_p, resp_p, proto_num) as k from l
union all select flow_id, label_family, 'rev', concat_ws('|', resp_h, orig_h, resp_p, orig_p, proto_num) from l""")
def label_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.label_expand(views.flows(spark, sf_dir).where("is_attack = 1")).select("flow_id", "label_family", "dir", "k")


@query("""select orig_h, resp_p, day_ix, label_family, is_attack from (select *, row_number() over (partition by orig_h, resp_p, day_ix order by is_attack desc, label_family) as rn from v_flows) where rn = 1""")
def dedup_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.dedup_label(views.flows(spark, sf_dir), ("orig_h", "resp_p", "day_ix"))


def nearest_sql(probes: str) -> str:
    """CTE n: the nearest label of every probe (pid, orig_h, at)."""
    return f"""with p as ({probes}), l as (select flow_id as label_id, orig_h, start_us as ts_us, label_family from v_flows where is_attack = 1),
n as (select p.*, l.label_id, l.ts_us, l.label_family as found, row_number() over (partition by p.pid, p.pass order by abs(p.at - l.ts_us), l.ts_us, l.label_id desc) as rn
 from p left join l on p.orig_h = l.orig_h and l.ts_us between p.at - {TOLERANCE} and p.at + {TOLERANCE})
"""


@query(nearest_sql("select flow_id as pid, orig_h, start_us as at, 0 as pass from v_flows where is_attack = 0") + "select pid as flow_id, ts_us as m_time, label_id as m_label_id, found as m_label_family from n where rn = 1")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = views.flows(spark, sf_dir).where("is_attack = 0").select("flow_id", "orig_h", "start_us")
    return label.asof_nearest(probes, views.attacks(spark, sf_dir), "orig_h", "start_us", "ts_us", TOLERANCE, "label_id", ["label_id", "label_family"], "flow_id").select("flow_id", "m_time", "m_label_id", "m_label_family")


@query(nearest_sql("select flow_id as pid, orig_h, start_us as at, 0 as pass from v_flows union all select flow_id, orig_h, end_us, 1 from v_flows") + """select pid as flow_id, coalesce(arg_max(found, case when found is null then 0 when found = 'BENIGN' then 20 else 30 end - pass), 'Unknown') as label_family from n where rn = 1 group by pid""")
def label_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.label_two_pass(views.flows(spark, sf_dir), views.attacks(spark, sf_dir), "orig_h", TOLERANCE)


@query(nearest_sql("select flow_id as pid, orig_h, start_us as at, 0 as pass from v_flows union all select flow_id, orig_h, end_us, 1 from v_flows") + """, b as (select pid, max(case when found is null then 0 else 1 end) as hit from n where rn = 1 group by pid), a as (select sum(hit) as attacks, sum(hit) as known from b),
s as (select min(start_us) as f0, max(end_us) as f1, min(case when is_attack = 1 then start_us end) as l0, max(case when is_attack = 1 then start_us end) as l1 from v_flows),
c as (select shift, ord, cast(attacks as bigint) as attacks, cast(known as bigint) as known, greatest(0, least(f1, l1 + shift) - greatest(f0, l0 + shift)) as overlap_us from a, s, (values (0, 0), (43200000000, 1), (-43200000000, 2)) v(shift, ord))
select cast(shift // 1000000 as bigint) as shift_s, ord, attacks, known, overlap_us, ord = (select arg_max(ord, overlap_us * 10 - ord) from c) as chosen from c""")
def shift_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.choose_shift(views.flows(spark, sf_dir), views.attacks(spark, sf_dir), "orig_h", TOLERANCE)


# Preparation


@query("select label_family, count(*) as n from v_flows group by 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.label_counts(views.flows(spark, sf_dir), "label_family")


@query("""select day_ix, count(*) filter (where label_family = 'Bot') as "Bot", count(*) filter (where label_family = 'DoS') as "DoS", count(*) filter (where label_family = 'PortScan') as "PortScan", count(*) as total from v_flows where label_family in ('Bot', 'DoS', 'PortScan') group by 1""")
def attack_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.attack_pivot(views.flows(spark, sf_dir), "day_ix", "label_family", FAMILIES)


GROUPS = """with c as (select orig_h, resp_h, label_family, count(*) as n, max(is_attack) as a, sum(is_attack) as k from v_flows group by all),
r as (select *, row_number() over (partition by orig_h, resp_h order by a desc, n desc, label_family) as rn from c),
g as (select orig_h, resp_h, cast(sum(n) as bigint) as n_rows, cast(sum(k) as bigint) as attack_rows, cast(sum(n) - sum(k) as bigint) as benign_rows, max(case when rn = 1 then label_family end) as dom_label from r group by all)
"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.group_table(views.flows(spark, sf_dir), ("orig_h", "resp_h"), "label_family", "is_attack")


@query(GROUPS + "select * from g")
def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir)


@query("""with f as (select resp_p, count(*) / (select count(*) from v_flows where day_ix < 3)::double as freq from v_flows where day_ix < 3 group by 1)
select flow_id, round(coalesce(freq, 0), 6) as resp_p_freq from v_flows left join f using (resp_p)""")
def freq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flows(spark, sf_dir)
    return rounded(prepare.freq_encode(rows, "resp_p", prepare.fit_freq(rows.where("day_ix < 3"), "resp_p")), "resp_p_freq").select("flow_id", "resp_p_freq")


@query(" union all ".join(f"select '{c}' as \"column\", round(count(*) filter (where {c} is null) / count(*)::double, 6) as null_share, count(distinct {c}) as n_distinct, cast(min({c}) as varchar) as least, cast(max({c}) as varchar) as greatest from v_flows" for c in ("orig_h", "resp_p", "orig_bytes", "label_family")))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepare.profile(views.flows(spark, sf_dir), ["orig_h", "resp_p", "orig_bytes", "label_family"]), "null_share")


# Splits


def hashed(seed: int, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


RANKED = f"with r as (select *, row_number() over (partition by label_family order by {hashed(SEED, 'flow_id')}, flow_id) as rn, count(*) over (partition by label_family) as n from v_flows)\n"


@query(RANKED + f""", t as (select sum(least(n, {QUOTA})) as a from (select distinct label_family, n from r) where label_family <> 'BENIGN')
select flow_id, label_family from r, t where rn <= case when label_family = 'BENIGN' then least(n, floor(a * 1.5)) else least(n, {QUOTA}) end""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.quota_sample(views.flows(spark, sf_dir), "label_family", QUOTA, SEED, "flow_id", benign_ratio=1.5).select("flow_id", "label_family")


@query(RANKED + "select flow_id, label_family as stratum, case when (rn - 1) / n::double < 0.7 then 'train' when (rn - 1) / n::double < 0.7 + 0.15 then 'val' else 'test' end as role from r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.stratified_split(views.flows(spark, sf_dir), "label_family", SEED, "flow_id").select("flow_id", "stratum", "role")


CAP = "(select floor(count(distinct label_family) filter (where label_family <> 'BENIGN') * 1000 * 3.0) as cap from r)"
KEPT = f", kept as (select r.* from r, {CAP} where rn <= case when label_family = 'BENIGN' then least(n, cap) else 1000 end)\n"


@query(RANKED + KEPT + ", k as (select flow_id, label_family, case when n >= 1000 or label_family = 'BENIGN' then 1 else 1000 // n + case when rn <= 1000 % n then 1 else 0 end end as copies from kept)\nselect flow_id, label_family, cast(unnest(range(copies)) as integer) as copy from k")
def rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.rebalance(views.flows(spark, sf_dir), "label_family", 1000, SEED, "flow_id").select("flow_id", "label_family", "copy")


@query(RANKED + KEPT + f""", d as (select label_family, ('0x' || substr(md5(concat_ws('|', '{SEED}', label_family, d)), 1, 12))::bigint % n + 1 as pick, count(*) as times from (select distinct label_family, n from kept where n < 1000 and label_family <> 'BENIGN'), range(1, 1001) t(d) group by all),
k as (select flow_id, kept.label_family, case when n >= 1000 or kept.label_family = 'BENIGN' then 1 else coalesce(times, 0) end as copies from kept left join d on d.label_family = kept.label_family and pick = rn)
select flow_id, label_family, cast(unnest(range(copies)) as integer) as copy from k""")
def rebalance_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.rebalance(views.flows(spark, sf_dir), "label_family", 1000, SEED, "flow_id", mode="draw").select("flow_id", "label_family", "copy")


BALANCED = f""", q as (select min(least(n, {QUOTA})) as q, count(distinct label_family) as f from r where label_family <> 'BENIGN'),
s as (select flow_id from r, q where rn <= case when label_family = 'BENIGN' then least(n, q * f) else q end)
"""


@query(RANKED + BALANCED + """select flow_id, 'test_balanced' as role from s union all select flow_id, 'val' from v_flows where day_ix = 3 union all select flow_id, 'test_realistic' from v_flows where day_ix = 4
union all select flow_id, 'train' from v_flows where day_ix < 3 and flow_id not in (select flow_id from s)""")
def split_dual_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.split_by_day(views.flows(spark, sf_dir), "day_ix", "label_family", QUOTA, SEED, "flow_id").select("flow_id", "role")


@query(GROUPS + f""", h as (select *, row_number() over (partition by dom_label order by {hashed(SEED, 'orig_h', 'resp_h')}, orig_h, resp_h) as rn, count(*) over (partition by dom_label) as n from g)
select orig_h, resp_h, dom_label, case when (rn - 1) / n::double < 0.7 then 'train' when (rn - 1) / n::double < 0.7 + 0.15 then 'val' else 'test' end as role from h""")
def group_split_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).withColumn("gid", F.concat_ws("|", "orig_h", "resp_h"))
    return prepare.stratified_split(g, "dom_label", SEED, "gid", rare=1).select("orig_h", "resp_h", "dom_label", "role")


@query(GROUPS + """, h as (select *, row_number() over (partition by dom_label order by n_rows desc, orig_h, resp_h) as rn, sum(n_rows) over (partition by dom_label)::bigint as total from g),
w as (select dom_label, 0::bigint as rn, round_even(total * 0.7::double, 0)::bigint as a, round_even(total * 0.15::double, 0)::bigint as b, total - round_even(total * 0.7::double, 0)::bigint - round_even(total * 0.15::double, 0)::bigint as c, ''::varchar as orig_h, ''::varchar as resp_h, ''::varchar as role from h where rn = 1
 union all select x.dom_label, x.rn, a - case when role = 'train' then n_rows else 0 end, b - case when role = 'val' then n_rows else 0 end, c - case when role = 'test' then n_rows else 0 end, x.orig_h, x.resp_h, role from
 (select h.dom_label, h.rn, h.orig_h, h.resp_h, h.n_rows, w.a, w.b, w.c, case when w.a >= w.b and w.a >= w.c then 'train' when w.b >= w.c then 'val' else 'test' end as role from w join h on h.dom_label = w.dom_label and h.rn = w.rn + 1) x)
select g.*, w.role from g join w using (orig_h, resp_h)""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.group_split(groups(spark, sf_dir), "dom_label", "n_rows", ("orig_h", "resp_h"), SEED)


ORACLES["group_split"] = ORACLES["group_split"].replace("with v_flows", "with recursive v_flows", 1)


@query(GROUPS + f""", m as (select min(c) as rarest from (select count(*) as c from g group by dom_label)),
f as (select orig_h, resp_h, repeat, (row_number() over (partition by repeat, case when rarest >= 5 then dom_label end order by md5(concat_ws('|', '{SEED}', repeat, orig_h, resp_h)), orig_h, resp_h) - 1) % 5 as fold from g, m, range(3) t(repeat)),
t as (select label_family, count(*) as all_n, sum(is_attack) as all_a from v_flows group by 1),
x as (select repeat, fold, label_family, count(*) as n, sum(is_attack) as a from v_flows join f using (orig_h, resp_h) group by all),
z as (select d.repeat, d.fold, t.*, coalesce(n, 0) as n, coalesce(a, 0) as a from (select distinct repeat, fold from f) d cross join t left join x on x.repeat = d.repeat and x.fold = d.fold and x.label_family = t.label_family)
select cast(repeat as integer) as repeat, cast(fold as integer) as fold, cast(sum(n) as bigint) as test_rows, cast(sum(a) as bigint) as test_attacks, cast(sum(all_n - n) as bigint) as train_rows, cast(sum(all_a - a) as bigint) as train_attacks, count(*) filter (where n > 0 and n = all_n) as unseen_families from z group by repeat, fold""")
def kfold_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = prepare.kfold(groups(spark, sf_dir), ("orig_h", "resp_h"), 5, 3, SEED, "dom_label")
    return prepare.kfold_meta(views.flows(spark, sf_dir), folds, ["orig_h", "resp_h"], "label_family", "is_attack")


@query(f"""with r as (select *, row_number() over (partition by is_attack order by {hashed(SEED, 'flow_id')}, flow_id) as rn, count(*) over () as t, sum(is_attack) over () as p from v_flows)
select flow_id, is_attack from r where rn <= case when is_attack = 1 then least(p, greatest(1, round_even(p * 500 / t::double, 0))) else 500 - least(p, greatest(1, round_even(p * 500 / t::double, 0))) end""")
def ratio_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.ratio_sample(views.flows(spark, sf_dir), "is_attack", 500, SEED, "flow_id").select("flow_id", "is_attack")


def by_day(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    return views.flows(spark, sf_dir, source).withColumn("role", F.when(F.col("day_ix") < 3, "train").when(F.col("day_ix") == 3, "val").otherwise("test"))


DAYS = "with d as (select *, case when day_ix < 3 then 'train' when day_ix = 3 then 'val' else 'test' end as role from v_flows)\n"


@query(DAYS + """select role, count(*) as n_rows, cast(sum(is_attack) as bigint) as attacks, round(sum(is_attack) / count(*)::double, 6) as prevalence, count(distinct label_family) filter (where label_family <> 'BENIGN') as families,
 count(distinct label_family) filter (where label_family <> 'BENIGN' and label_family not in (select label_family from d where role = 'train')) as unseen from d group by role""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepare.split_report(by_day(spark, sf_dir), "role", "label_family", "is_attack"), "prevalence")


@query(DAYS + """, a as (select distinct orig_h, resp_h, proto_num from d where role = 'test'), b as (select distinct orig_h, resp_h, proto_num from d where role = 'train')
select count(*) as sessions, count(b.orig_h) as shared, round(100.0 * count(b.orig_h) / count(*), 1) as overlap_pct from a left join b using (orig_h, resp_h, proto_num)""")
def session_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = by_day(spark, sf_dir)
    return prepare.session_overlap(d.where("role = 'train'"), d.where("role = 'test'"), ["orig_h", "resp_h", "proto_num"])


@query("select distinct concat_ws('|', label_family, orig_h, resp_h, resp_p) as label_family from v_flows where day_ix = 4 except select concat_ws('|', label_family, orig_h, resp_h, resp_p) from v_flows where day_ix = 3")
def unseen_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of traffic, finer than families, that a day has and the day before has not."""
    d = views.flows(spark, sf_dir).withColumn("label_family", F.concat_ws("|", "label_family", "orig_h", "resp_h", "resp_p"))
    return prepare.unseen_families(d.where("day_ix = 3"), d.where("day_ix = 4"), "label_family")


# Evaluation


@query("""with c as (select count(*) filter (where y_true = 1 and base_pred = 1) as tp, count(*) filter (where y_true = 0 and base_pred = 1) as fp, count(*) filter (where y_true = 1 and base_pred = 0) as fn, count(*) filter (where y_true = 0 and base_pred = 0) as tn from v_scores)
select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(fp / (fp + tn)::double, 6) as fpr, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from c""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.binary_metrics(views.scores(spark, sf_dir), "y_true", "base_pred"), "accuracy", "precision", "recall", "fpr", "f1")


SUMS = """with g as (select ebpf_score_m as s, sum(y_true) as p, sum(1 - y_true) as n from v_scores group by 1),
x as (select s, p, n, sum(p) over (order by s desc) as tp, sum(n) over (order by s desc) as fp, sum(p) over () as pos, sum(n) over () as neg from g)
"""


@query(SUMS + "select round(sum(n * (tp - p + p / 2.0)) / (max(pos) * max(neg))::double, 6) as roc_auc from x")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.roc_auc(views.scores(spark, sf_dir), "y_true", "ebpf_score_m"), "roc_auc")


@query(SUMS + "select round(sum(p * tp / (tp + fp)::double) / max(pos), 6) as average_precision from x")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.average_precision(views.scores(spark, sf_dir), "y_true", "ebpf_score_m"), "average_precision")


@query(SUMS + "select s as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(tp / (tp + fp)::double, 6) as precision, round(tp / pos::double, 6) as recall from x")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.pr_points(views.scores(spark, sf_dir), "y_true", "ebpf_score_m"), "precision", "recall")


def threshold_sql(where: str, order: str) -> str:
    return SUMS + f"select cast(s as double) as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(pos as bigint) as pos, cast(neg as bigint) as neg from x where {where} order by {order} limit 1"


@query(threshold_sql("true", "2.0 * tp / (tp + fp + pos) desc, s desc"))
def threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_threshold(views.scores(spark, sf_dir), "y_true", "ebpf_score_m", "f1")


@query(threshold_sql("fp <= 0.01 * neg", "tp desc, s desc"))
def threshold_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_threshold(views.scores(spark, sf_dir), "y_true", "ebpf_score_m", "fpr", 0.01)


@query(threshold_sql("tp >= 0.4 * pos", "fp, s desc"))
def threshold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_threshold(views.scores(spark, sf_dir), "y_true", "ebpf_score_m", "recall", 0.4)


@query("select label_family, count(*) as support, cast(sum(ebpf_pred) as bigint) as detected, round(sum(ebpf_pred) / count(*)::double, 6) as rate from v_scores group by 1")
def family_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.family_rates(views.scores(spark, sf_dir), "label_family", "ebpf_pred"), "rate")


Z = 1.96


def wilson_sql(k: str, sign: str) -> str:
    return f"round((({k} / n + {Z * Z} / (2 * n)) {sign} {Z} * sqrt({k} / n * (1 - {k} / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n), 6)"


@query(f"""with c as (select label_family, count(*)::double as n, count(*) as support, sum(base_pred) as a, sum(ebpf_pred) as b, count(*) filter (where base_pred = 1 and ebpf_pred = 0) as only_a, count(*) filter (where base_pred = 0 and ebpf_pred = 1) as only_b from v_scores where y_true = 1 group by 1)
select label_family, support, cast(a as bigint) as a_detected, cast(b as bigint) as b_detected, only_a, only_b, round(a / n, 6) as a_rate, round(b / n, 6) as b_rate, {wilson_sql('a', '-')} as a_low, {wilson_sql('a', '+')} as a_high, {wilson_sql('b', '-')} as b_low, {wilson_sql('b', '+')} as b_high, round(b / n - a / n, 6) as delta from c""")
def paired_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.paired_family(views.scores(spark, sf_dir), "label_family", "y_true", "base_pred", "ebpf_pred").drop("p_exact", "p_holm")
    return rounded(got, "a_rate", "b_rate", "a_low", "a_high", "b_low", "b_high", "delta")


@query("""with c as (select label_family, count(*) filter (where base_pred = 1 and ebpf_pred = 0) as only_a, count(*) filter (where base_pred = 0 and ebpf_pred = 1) as only_b from v_scores where y_true = 1 group by 1),
t as (select label_family, only_a, only_b, sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) as tail from (select *, unnest(range(least(only_a, only_b) + 1)) as i from c) group by all),
p as (select *, case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * tail) end as p from t),
r as (select *, (count(*) over () - row_number() over (order by p) + 1) * p as s from p)
select label_family, only_a, only_b, round(p, 6) as p_exact, round(least(1.0, max(s) over (order by p rows unbounded preceding)), 6) as p_holm from r""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired_family(views.scores(spark, sf_dir), "label_family", "y_true", "base_pred", "ebpf_pred").select("label_family", "only_a", "only_b", F.round("p_exact", 6).alias("p_exact"), F.round("p_holm", 6).alias("p_holm"))


@query("""with t as (select orig_h as test, avg(is_attack) as p from v_flows group by 1), r as (select *, (count(p) over () - row_number() over (order by p, test) + 1) * p as s from t)
select test, round(p, 6) as p, round(least(1.0, max(s) over (order by p, test rows unbounded preceding)), 6) as p_holm from r""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = views.flows(spark, sf_dir).groupBy(F.col("orig_h").alias("test")).agg(F.avg("is_attack").alias("p"))
    return rounded(evaluate.holm(tests, "p", "p_holm"), "p", "p_holm")


@query(DAYS + "select label_family, count(*) filter (where role = 'train') as train, count(*) filter (where role = 'val') as val, count(*) filter (where role = 'test') as test from d group by 1")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage_pivot(by_day(spark, sf_dir), "label_family", "role", ["train", "val", "test"])


@query("select y_true, cast(least(floor(ebpf_score_m * 60 / 1300.0), 59) as integer) as bin, count(*) as count from v_scores where ebpf_score_m between 0 and 1300 group by all")
def score_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(views.scores(spark, sf_dir), "ebpf_score_m", 0.0, 1300.0, 60, ("y_true",))


@query("select label_family, count(*) as n, round(avg(ebpf_score_m), 6) as mean, round(quantile_cont(ebpf_score_m::double, 0.5), 6) as p50, round(quantile_cont(ebpf_score_m::double, 0.95), 6) as p95 from v_scores group by 1")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.score_summary(views.scores(spark, sf_dir), "ebpf_score_m", "label_family"), "mean", "p50", "p95")


IMPORTANCE = "with i as (select orig_h as feature, sum(orig_bytes) - 2 * sum(resp_bytes) as value from v_flows group by 1)\n"


@query(IMPORTANCE + "select feature, cast(value as bigint) as value, cast(greatest(value, 0) as bigint) as clipped, round(sum(greatest(value, 0)) over (order by greatest(value, 0) desc, feature rows unbounded preceding) / (sum(greatest(value, 0)) over ())::double, 6) as cum_share from i")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.flows(spark, sf_dir).groupBy(F.col("orig_h").alias("feature")).agg((F.sum("orig_bytes") - 2 * F.sum("resp_bytes")).alias("value"))
    return rounded(evaluate.cumulative_share(i, "value", "feature"), "cum_share")


def top_hosts(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    from pyspark.sql import Window

    sums = views.flows(spark, sf_dir).groupBy(F.col("orig_h").alias("feature")).agg(F.sum(by).alias("v"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("v"), "feature"))).where("rank <= 12").select("feature", "rank")


@query("""with a as (select orig_h as feature, row_number() over (order by sum(orig_bytes) desc, orig_h) as rank from v_flows group by 1), b as (select orig_h as feature, row_number() over (order by sum(is_attack) desc, orig_h) as rank from v_flows group by 1),
j as (select coalesce(a.feature, b.feature) as feature, coalesce(a.rank, 13) as rank_a, coalesce(b.rank, 13) as rank_b from (select * from a where rank <= 12) a full join (select * from b where rank <= 12) b using (feature))
select feature, cast(rank_a as integer) as rank_a, cast(rank_b as integer) as rank_b, (rank_a + rank_b) / 2.0::double as mean_rank from j""")
def rank_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rank_consensus(top_hosts(spark, sf_dir, "orig_bytes"), top_hosts(spark, sf_dir, "is_attack"), "feature")


@query("""with a as (select label_family, round(avg(base_pred), 6) as v from v_scores where day_ix < 4 group by 1), b as (select label_family, round(avg(ebpf_pred), 6) as v from v_scores where day_ix > 2 group by 1)
select coalesce(a.label_family, b.label_family) as label_family, a.v as a, b.v as b, round(b.v - a.v, 6) as delta from a full join b using (label_family)""")
def compare_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    side = lambda cond, c: s.where(cond).groupBy("label_family").agg(F.round(F.avg(c), 6).alias("v"))
    return rounded(evaluate.compare_outer(side("day_ix < 4", "base_pred"), side("day_ix > 2", "ebpf_pred"), "label_family", "v"), "delta")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    return evaluate.bootstrap_ci(s, "y_true", "ebpf_score_m", "roc_auc").unionByName(evaluate.bootstrap_ci(s, "y_true", "ebpf_score_m", "average_precision", cluster="cluster_key"))


WEIGHT = " + ".join(f"(u >= {t})::int" for t in resample.STEPS)
METRICS = ("f1", "precision", "recall", "fpr", "roc_auc", "pr_auc")


@query(f"""with w as (select c, r, case when r = 0 then 1 else {WEIGHT} end as w from (select c, r, ('0x' || substr(md5(concat_ws('|', '{SEED}', r // 8, c)), 1 + 4 * (r % 8)::int, 4))::bigint as u from (select distinct cluster_key as c from v_scores), range(0, 1001) t(r))),
x as (select 'a' as model, cluster_key as c, y_true as y, base_pred as pred, base_score_m as s from v_scores union all select 'b', cluster_key, y_true, ebpf_pred, ebpf_score_m from v_scores),
e as (select model, c, count(*) filter (where y = 1 and pred = 1) as tp, count(*) filter (where y = 0 and pred = 1) as fp, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from x group by all),
g as (select model, r, sum(tp * w)::double as tp, sum(fp * w)::double as fp, sum(pos * w)::double as pos, sum(neg * w)::double as neg from e join w using (c) group by all),
q as (select model, r, case when pos + neg > 0 then case when tp + fp + pos > 0 then 2 * tp / (tp + fp + pos) else 0 end end as f1, case when pos + neg > 0 then case when tp + fp > 0 then tp / (tp + fp) else 0 end end as precision, case when pos > 0 then tp / pos end as recall, case when neg > 0 then fp / neg end as fpr from g),
k as (select model, c, s, sum(y) as p, sum(1 - y) as n from x group by all), m as (select model, r, s, sum(p * w)::double as p, sum(n * w)::double as n from k join w using (c) group by all),
z as (select *, sum(p) over d as tp, sum(n) over d as fp, sum(p) over a as pos, sum(n) over a as neg from m window d as (partition by model, r order by s desc), a as (partition by model, r)),
o as (select model, r, case when max(pos) > 0 and max(neg) > 0 then sum(n * (tp - p / 2)) / (max(pos) * max(neg)) end as roc_auc, case when max(pos) > 0 and max(neg) > 0 then sum(case when tp + fp > 0 then p * tp / (tp + fp) else 0 end) / max(pos) end as pr_auc from z group by all),
l as ({" union all ".join(f"select '{m}' as metric, r, max({m}) filter (where model = 'b') - max({m}) filter (where model = 'a') as delta from q join o using (model, r) group by r" for m in METRICS)})
select metric, round(max(delta) filter (where r = 0), 6) as delta, count(delta) filter (where r > 0) as replicates, round(avg(delta) filter (where r > 0), 6) as mean, round(quantile_cont(delta, 0.025) filter (where r > 0), 6) as low, round(quantile_cont(delta, 0.975) filter (where r > 0), 6) as high, (select count(distinct cluster_key) from v_scores) as clusters from l group by 1""")
def paired_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.paired_cluster_bootstrap(views.scores(spark, sf_dir), "y_true", "base_pred", "ebpf_pred", "base_score_m", "ebpf_score_m", "cluster_key", n=1000, seed=SEED)
    return rounded(got, "delta", "mean", "low", "high")


# Monitoring


@query("select count(*) as events, cast(sum(ebpf_pred) as bigint) as alerts, round(100.0 * sum(ebpf_pred) / count(*), 6) as alert_pct, round(avg(ebpf_score_m), 6) as mean_score, max(ebpf_score_m) as max_score from v_scores")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.kpis(views.scores(spark, sf_dir), "ebpf_score_m", "ebpf_pred")


@query("""with w as (select * from v_scores where start_us >= (select max(start_us) from v_scores) - 86400000000), b as (select cast(floor(start_us / 900000000.0) as bigint) * 900000000 as bucket, count(*) as n, avg(ebpf_score_m) as m from w group by 1)
select bucket, n, round(m, 6) as mean_score, round(avg(m) over (order by bucket rows between 1 preceding and 1 following), 6) as smooth from b""")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = monitor.trailing(views.scores(spark, sf_dir), "start_us", 86_400_000_000)
    return rounded(monitor.score_buckets(recent, "start_us", "ebpf_score_m", 900_000_000), "mean_score", "smooth")


@query("select flow_id, start_us, ebpf_score_m from v_scores order by start_us desc, flow_id desc limit 300")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.recent(views.scores(spark, sf_dir), "start_us", "flow_id").select("flow_id", "start_us", "ebpf_score_m")


@query("select label_family, count(*) as n from v_scores group by 1 order by 2 desc, 1 limit 3")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.top_labels(views.scores(spark, sf_dir), "label_family", 3)


@query("select flow_id, round(avg(orig_bytes) over (partition by orig_h order by start_us, flow_id rows between 4 preceding and current row), 6) as moving_avg from v_flows")
def moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitor.moving_avg(views.flows(spark, sf_dir), "orig_bytes", ["start_us", "flow_id"], ["orig_h"]), "moving_avg").select("flow_id", "moving_avg")


# Streams


def streamed(spark: SparkSession, out: DataFrame) -> DataFrame:
    """All that a stream gives over the files there are, written by its own sink and read back."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    src = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders; a single file is taken by name.
    return src.option("pathGlobFilter", "*.parquet").parquet(path if path_is_dir(spark, path) else f"{sf_dir}/event[s].parquet")


def path_is_dir(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()


EPOCH = "timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', ts)"  # the same instant in any session zone


def packet_events(ev: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as socket events."""
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    rows = ev.withColumn("ts_us", F.expr(EPOCH)).withColumn("ts", F.timestamp_micros("ts_us"))
    return rows.select("ts", "event_id", "ts_us", F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")).alias("saddr"), F.concat(F.lit("10.0.1."), (F.col("event_id") * 7 % 16).cast("string")).alias("daddr"), (F.col("user_id") + 1024).alias("sport"), (F.col("event_id") % 4).alias("dport"), F.lit(6).alias("proto"), kind.alias("evtype"), F.floor(F.col("value") * 100).alias("bytes"), F.col("user_id").alias("pid"), (F.col("event_id") % 2 == 0).alias("outgoing"))


def flushed(rows: DataFrame) -> DataFrame:
    return flow_partials(rows).select(F.unix_micros("flush.start").alias("flush_us"), *enrich.TUPLE, "first_us", "last_us", "bytes_sent", "bytes_recv", "samples", "pid")


STREAMED = """with s as (select event_id, epoch_us(ts) as us, concat('10.0.0.', user_id % 20) as a, concat('10.0.1.', event_id * 7 % 16) as b, user_id + 1024 as port, event_id % 4 as dport, cast(floor(value * 100) as bigint) as bytes, value, user_id as pid,
 case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as evtype from events)
"""


@query(STREAMED + """select cast(floor(us / 5000000.0) as bigint) * 5000000 as flush_us, a as saddr, b as daddr, port as sport, dport, 6 as proto, min(us) as first_us, max(us) as last_us,
 sum(case when evtype = 2 or (evtype = 5 and event_id % 2 = 0) then bytes else 0 end) as bytes_sent, sum(case when evtype = 3 or (evtype = 5 and event_id % 2 = 1) then bytes else 0 end) as bytes_recv, count(*) as samples, arg_max(pid, row(us, event_id)) as pid
from s where evtype <> 3 or bytes > 0 group by all""")
def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flush-window partials of a stream; windows that were open when it stopped come from the final pass."""
    given = streamed(spark, flushed(packet_events(stream_source(spark, sf_dir))))
    return with_final_pass(given, flushed(packet_events(views.events(spark, sf_dir))), ("flush_us", *enrich.TUPLE))


def both_sides(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, of a table or a stream, as connections and as flows of two thirds of them, some the other way round."""
    ev = ev.withColumn("us", F.expr(EPOCH)).withColumn("start", F.timestamp_micros("us"))
    host = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    a, b, port = host("10.0.0.", F.col("user_id") % 20), host("10.0.1.", F.col("event_id") * 7 % 16), F.col("event_id") % 4
    end = F.timestamp_micros(F.col("us") + F.floor(F.col("value") * 100000))
    conn = ev.select(F.col("event_id").alias("conn_id"), "start", end.alias("end"), a.alias("orig_h"), b.alias("resp_h"), (F.col("user_id") + 1024).alias("orig_p"), port.alias("resp_p"), F.lit(6).alias("proto_num"))
    back = F.col("event_id") % 5 == 0
    either = lambda x, y: F.when(back, y).otherwise(x)
    flows = ev.where(F.col("event_id") % 3 != 2).select(either(a, b).alias("saddr"), either(b, a).alias("daddr"), either(F.col("user_id") + 1024, port).alias("sport"), either(port, F.col("user_id") + 1024).alias("dport"), F.lit(6).alias("proto"), F.col("start").alias("first"), end.alias("last"), (F.col("event_id") % 50 + 1).alias("samples"), F.floor(F.col("value") * 100).alias("bytes_sent"), F.floor(F.col("value") * 37).alias("bytes_recv"))
    return conn, flows


OVERLAPS = STREAMED + """, c as (select event_id as conn_id, us as start_us, us + cast(floor(value * 100000) as bigint) as end_us, a, b, port, dport, value from s),
f as (select *, conn_id % 50 + 1 as samples, cast(floor(value * 100) as bigint) as bytes_sent, cast(floor(value * 37) as bigint) as bytes_recv, conn_id % 5 = 0 as back from c where conn_id % 3 <> 2),
k as (select case when back then b else a end as sa, case when back then a else b end as da, case when back then dport else port end as sp, case when back then port else dport end as dp, start_us, end_us, samples, bytes_sent, bytes_recv from f),
j as (select c.conn_id, c.start_us, 1 as rank, samples, bytes_sent, bytes_recv from c join k on a = sa and b = da and port = sp and dport = dp and k.end_us >= c.start_us - 10000000 and k.start_us <= c.end_us + 10000000
 union all select c.conn_id, c.start_us, 0, samples, bytes_sent, bytes_recv from c join k on b = sa and a = da and dport = sp and port = dp and k.end_us >= c.start_us - 10000000 and k.start_us <= c.end_us + 10000000),
t as (select *, row_number() over (partition by conn_id order by rank desc, samples desc, bytes_sent desc) as rn from j)"""


@query(OVERLAPS + """
select c.conn_id, c.start_us, case rank when 1 then 'fwd' when 0 then 'rev' else 'none' end as match_dir, samples, bytes_sent, bytes_recv from c left join t on t.conn_id = c.conn_id and rn = 1""")
def stream_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of a stream with the best overlapping flow; those behind the last watermark come from the final pass."""
    whole = stream_enrich(*both_sides(views.events(spark, sf_dir)))
    return with_final_pass(streamed_enrichment(spark, sf_dir), whole.select("conn_id", F.unix_micros("start").alias("start_us"), "match_dir", "samples", "bytes_sent", "bytes_recv"), ("conn_id",))


@query(OVERLAPS + """, z as (select least(max(us), max(us) filter (where event_id % 3 <> 2)) // 1000 - 10000 as mark from s)
select c.conn_id, c.start_us, case rank when 1 then 'fwd' when 0 then 'rev' else 'none' end as match_dir, samples, bytes_sent, bytes_recv from c left join t on t.conn_id = c.conn_id and rn = 1, z where (end_us + 10000000) // 1000 + 1 <= mark""")
def streamed_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connections that the stream itself gives: those whose end and slop its watermark has passed."""
    with matching.rocks(spark):
        return streamed(spark, matching.stream_match(*both_sides(stream_source(spark, sf_dir))))


# Models


@query()
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_and_score(by_day(spark, sf_dir), "gbt")


@query()
def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_and_score(by_day(spark, sf_dir), "rf")


@query()
def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_and_score(by_day(spark, sf_dir), "logreg")


@query()
def iforest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_day(spark, sf_dir)
    forest = models.isolation_forest(rows.where("role = 'train' and is_attack = 0"), models.FEATURES, "flow_id")
    return models.isolation_scores(rows.where("role = 'test'"), forest, models.FEATURES, "flow_id")
