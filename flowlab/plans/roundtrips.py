"""Registered queries of scans, sinks and column functions: the flows of ``events`` are written in each format that the sources read, with the faults that such logs have, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab import functions as fn
from flowlab import sources
from flowlab.operators import prepare
from flowlab.plans import views
from flowlab.plans.catalogue import by_day, query, rounded
from flowlab.shared import new_path

CONN = "round(ts, 3) as ts, orig_h, resp_h, orig_p, resp_p, proto, round(duration, 6) as duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, conn_state"


def conn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as connections, all text; every fifth has no duration, every seventh no port."""
    n = F.col("flow_id")
    t = lambda c: c.cast("string")
    cols = {"ts": t(F.col("start_us") / 1e6), "orig_h": F.col("orig_h"), "resp_h": F.col("resp_h"), "orig_p": F.when(n % 7 != 0, t(F.col("orig_p"))), "resp_p": t(F.col("resp_p")), "proto": F.when(F.col("proto_num") == 6, "tcp").otherwise("udp"), "duration": F.when(n % 5 != 0, t((F.col("end_us") - F.col("start_us")) / 1e6)), "orig_bytes": t(F.col("orig_bytes")), "resp_bytes": t(F.col("resp_bytes")), "orig_pkts": t(n % 9), "resp_pkts": t(n % 4), "conn_state": F.lit("SF")}
    return views.flows(spark, sf_dir).select("flow_id", *[c.alias(k) for k, c in cols.items()])


CONN_SQL = """(select flow_id, start_us / 1e6 as ts, orig_h, resp_h, case when flow_id % 7 <> 0 then orig_p else 0 end::integer as orig_p, resp_p::integer as resp_p, case proto_num when 6 then 'tcp' else 'udp' end as proto,
 case when flow_id % 5 <> 0 then (end_us - start_us) / 1e6 else 0 end::double as duration, orig_bytes::double as orig_bytes, resp_bytes::double as resp_bytes, (flow_id % 9)::double as orig_pkts, (flow_id % 4)::double as resp_pkts, 'SF' as conn_state from v_flows)"""


def shown(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"round({c}, {n}) as {c}" if (n := {"ts": 3, "duration": 6}.get(c)) else c for c in sources.CONN_FIELDS])


def json_lines(rows: DataFrame, nested: Column) -> DataFrame:
    """Connections as JSON lines, with dotted keys or, where ``nested``, an object; every tenth line is cut off."""
    flat = F.to_json(F.struct(*[F.col(c).alias(sources.NESTED.get(c, c)) for c in sources.CONN_FIELDS]))
    deep = F.to_json(F.struct(F.struct(*sources.NESTED).alias("id"), *[c for c in sources.CONN_FIELDS if c not in sources.NESTED]))
    line = F.when(nested, deep).otherwise(flat)
    return rows.select("flow_id", F.when(F.col("flow_id") % 10 == 9, F.substring(line, 1, 40)).otherwise(line).alias("value"))


@query(f"select {CONN} from {CONN_SQL} where flow_id % 10 <> 9")
def conn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "conn-json")
    json_lines(conn_rows(spark, sf_dir), F.col("flow_id") % 2 == 0).select("value").write.text(path)
    return shown(sources.read_conn_json(spark, path))


def tsv_lines(rows: DataFrame, groups: int = 4) -> DataFrame:
    """Connections as lines of several files, each with a #fields line, the columns of odd files the other way round."""
    fields = list(sources.CONN_FIELDS)
    heads = ["#fields\t" + "\t".join(sources.NESTED.get(c, c) for c in order) for order in (fields, fields[::-1])]
    cells = [F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("-")) for c in order]) for order in (fields, fields[::-1])]
    g = F.col("flow_id") % groups
    body = rows.select(g.alias("g"), "flow_id", F.when(g % 2 == 0, cells[0]).otherwise(cells[1]).alias("value"))
    first = rows.select(g.alias("g")).distinct().select("g", F.lit(None).cast("long").alias("flow_id"), F.when(F.col("g") % 2 == 0, heads[0]).otherwise(heads[1]).alias("value"))
    end = first.select("g", F.lit(1 << 62).alias("flow_id"), F.lit("#close").alias("value"))
    return body.unionByName(first).unionByName(end)


@query(f"select {CONN} from {CONN_SQL}")
def conn_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "conn-tsv")
    lines = tsv_lines(conn_rows(spark, sf_dir))
    for parity in (0, 1):  # files of one layout each
        lines.where(F.col("g") % 2 == parity).repartition(2, "g").sortWithinPartitions("g", F.col("flow_id").asc_nulls_first()).select("value").write.mode("append").text(path)
    return shown(sources.read_conn_tsv(spark, path))


@query(f"select {CONN} from {CONN_SQL}")
def conn_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a header and files without one."""
    path = new_path(spark, "conn-csv")
    rows = conn_rows(spark, sf_dir)
    for parity in (0, 1):
        rows.where(F.col("flow_id") % 2 == parity).select(*sources.CONN_FIELDS).write.mode("append").option("header", parity == 0).csv(path)
    return shown(sources.read_conn_csv(spark, path))


@query(f"select {CONN} from {CONN_SQL} where flow_id % 3 <> 0 or flow_id % 10 <> 9")
def conn_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder with files of all three formats, each read by its own."""
    path = new_path(spark, "conn-mixed")
    rows = conn_rows(spark, sf_dir)
    json_lines(rows.where("flow_id % 3 = 0"), F.lit(False)).select("value").sortWithinPartitions(F.length("value").desc()).write.text(path)
    tsv_lines(rows.where("flow_id % 3 = 1"), 1).repartition(1, "g").sortWithinPartitions(F.col("flow_id").asc_nulls_first()).select("value").write.mode("append").text(path)
    rows.where("flow_id % 3 = 2").select(*sources.CONN_FIELDS).write.mode("append").option("header", True).csv(path)
    return shown(sources.read_conn(spark, path))


@query("""select flow_id::bigint * 1000 as ts_ns, flow_id as pid, orig_h as saddr_str, orig_p::integer as sport, (flow_id % 5 + 1)::integer as evtype, orig_bytes as bytes from v_flows where flow_id % 8 <> 7""")
def kernel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel events as JSON lines; every eighth line is no JSON."""
    path = new_path(spark, "kernel-events")
    n = F.col("flow_id")
    line = F.to_json(F.struct((n * 1000).alias("ts_ns"), n.alias("pid"), F.col("orig_h").alias("saddr_str"), F.col("orig_p").alias("sport"), (n % 5 + 1).alias("evtype"), F.col("orig_bytes").alias("bytes"), F.lit("x").alias("other")))
    views.flows(spark, sf_dir).select(F.when(n % 8 == 7, "{" + "broken").otherwise(line).alias("value")).write.text(path)
    return sources.read_kernel_events(spark, path).select("ts_ns", "pid", "saddr_str", "sport", "evtype", "bytes")


U32 = "({o}[1]::bigint * 16777216 + {o}[2]::bigint * 65536 + {o}[3]::bigint * 256 + {o}[4]::bigint)"


@query(f"""select flow_id as samples, {U32.format(o="string_split(orig_h, '.')")} as saddr, case when flow_id % 3 = 0 then 77 else {U32.format(o="string_split(resp_h, '.')")} end as daddr, orig_p::integer as sport from v_flows where flow_id % 4 <> 1""")
def kernel_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow partials as JSON lines: the address text where it is one, else the number; without either the row goes."""
    path = new_path(spark, "kernel-flows")
    n = F.col("flow_id")
    rows = views.flows(spark, sf_dir).select(F.col("flow_id").alias("samples"), F.col("orig_h").alias("saddr_str"), F.when(n % 4 == 1, "fe80::1").when(n % 3 == 0, "?").otherwise(F.col("resp_h")).alias("daddr_str"), F.when((n % 3 == 0) & (n % 4 != 1), 77).alias("daddr"), F.lit(5).alias("saddr"), F.col("orig_p").alias("sport"))
    rows.write.json(path)
    return sources.read_kernel_flows(spark, path).select("samples", "saddr", "daddr", "sport")


@query("""select orig_h as source_ip, orig_p::varchar as source_port, resp_h as destination_ip, resp_p::varchar as destination_port, proto_num::varchar as protocol, flow_id::varchar as timestamp, case label_family when 'BENIGN' then 'BENIGN' else concat('Web Attack – ', label_family) end as label from v_flows where flow_id % 2 = 0""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of two days in windows-1252, with blanks in their headers and columns between; those of Friday are read."""
    path = new_path(spark, "labels")
    label = F.when(F.col("label_family") == "BENIGN", "BENIGN").otherwise(F.concat(F.lit("Web Attack \x96 "), "label_family"))  # the dash's byte
    columns = {"Flow ID": F.lit("x"), "Source IP": "orig_h", "Source Port": "orig_p", "Destination IP": "resp_h", "Other": F.lit("0"), "Destination Port": "resp_p", "Protocol": "proto_num", "Timestamp": "flow_id", "Label": label}
    rows = views.flows(spark, sf_dir)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for day, parity in (("Friday", 0), ("Monday", 1)):
        part = new_path(spark, "label-part")
        own = rows.where(F.col("flow_id") % 2 == parity).select(*[(F.col(c) if isinstance(c, str) else c).alias(f" {n}") for n, c in columns.items()])
        own.write.option("header", True).option("encoding", "iso-8859-1").option("ignoreLeadingWhiteSpace", False).csv(part)
        files = hadoop(part).getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(hadoop(path))
        for status in files.listStatus(hadoop(part)):
            name = status.getPath().getName()
            if name.startswith("part-"):
                files.rename(status.getPath(), hadoop(f"{path}/{day}-WorkingHours-{name[5:10]}.csv"))
    return sources.read_labels(spark, path, "Friday").drop("file")


@query("""select flow_id, case when day_ix < 3 then 'train' else 'val' end as split from v_flows where day_ix < 4""")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by split, of which two splits are read."""
    path = new_path(spark, "splits")
    sources.write_table(by_day(spark, sf_dir).select("flow_id", F.col("role").alias("split")), path, ("split",))
    return sources.load_split(spark, path, ("train", "val"))


@query("""select flow_id::double as ts, orig_h, case when flow_id % 2 = 0 then orig_bytes end as ebpf_bytes_sent, case when flow_id % 2 = 1 then 'tc' end as run_iface from v_flows""")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with other columns, combined by name and brought into the merged layout."""
    rows = views.flows(spark, sf_dir).select(F.col("flow_id").cast("double").alias("ts"), "orig_h", F.col("orig_bytes").alias("ebpf_bytes_sent"), F.lit("x").alias("scratch"), F.lit("tc").alias("run_iface"), "flow_id")
    one, two = rows.where("flow_id % 2 = 0").drop("run_iface"), rows.where("flow_id % 2 = 1").drop("ebpf_bytes_sent")
    return sources.to_merged_layout(sources.combine_runs([one, two]))


@query("select flow_id % 3 as fold, count(*) as n, sum(flow_id)::bigint as ids from v_flows group by 1")
def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows of folds, written by fold and read back."""
    path, rows = new_path(spark, "folds"), views.flows(spark, sf_dir).select("flow_id")
    sources.write_folds(rows, rows.select("flow_id", F.lit(0).alias("repeat"), (F.col("flow_id") % 3).alias("fold")), ["flow_id"], path)
    return spark.read.parquet(path).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("flow_id").alias("ids"))


@query("select label_family, count(*) as n from v_flows group by 1")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as one CSV file with a header, read back."""
    path = new_path(spark, "report")
    sources.write_report(prepare.label_counts(views.flows(spark, sf_dir), "label_family"), path, "csv")
    return spark.read.schema("label_family string, n long").option("header", True).csv(path)


@query("""select flow_id, orig_h as run_meta_host, resp_p as run_meta_replay_port, concat('[', flow_id % 3, ',', flow_id % 5, ']') as run_tags from v_flows""")
def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metadata as columns, lists as JSON."""
    rows = views.flows(spark, sf_dir)
    meta = rows.select("flow_id", F.struct(F.col("orig_h").alias("host"), F.struct(F.col("resp_p").alias("port")).alias("replay")).alias("meta"), F.array(F.col("flow_id") % 3, F.col("flow_id") % 5).alias("tags"))
    return sources.flatten_struct(meta).withColumnRenamed("run_flow_id", "flow_id")


@query("""select flow_id % 4 as kind, count(*) as lines, count(*) filter (where flow_id % 6 = 5) as bad from v_flows group by 1""")
def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each kind of log are no JSON."""
    path = new_path(spark, "bad-lines")
    n = F.col("flow_id")
    views.flows(spark, sf_dir).select((n % 4).alias("kind"), F.when(n % 6 == 5, '{"sport": 1,').otherwise(F.to_json(F.struct(F.col("orig_p").alias("sport")))).alias("value")).write.partitionBy("kind").text(path)
    kinds = [sources.bad_json_lines(spark, f"{path}/kind={k}", sources.FLOW_DDL).agg(F.lit(k).cast("long").alias("kind"), F.sum("lines").alias("lines"), F.sum("bad").alias("bad")) for k in range(4)]
    return kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3]).where("lines is not null")


@query("""select flow_id, case flow_id % 4 when 0 then orig_bytes when 1 then 0 when 2 then 0 else -5 end::double as lenient, case flow_id % 3 when 0 then 'sshd' when 1 then '' else concat('a', flow_id) end as trimmed,
 case flow_id % 4 when 0 then 'Monday' when 1 then 'Friday' when 2 then 'Unknown' else 'Sunday' end as day from v_flows""")
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient numbers, texts up to their first NUL, weekdays of paths."""
    n = F.col("flow_id")
    raw = F.when(n % 4 == 0, F.concat(F.lit(" "), F.col("orig_bytes").cast("string"), F.lit(" "))).when(n % 4 == 1, "-").when(n % 4 == 3, "-5")
    comm = F.when(n % 3 == 0, F.concat(F.lit("sshd"), F.lit("\x00"), F.lit("junk"))).when(n % 3 == 1, F.lit("\x00")).otherwise(F.concat(F.lit("a"), n.cast("string")))
    path = F.when(n % 4 == 0, "/friday/x/MONDAY-a.pcap").when(n % 4 == 1, "Friday-WorkingHours.pcap").when(n % 4 == 2, "/monday/none.pcap").otherwise("sunday")
    return views.flows(spark, sf_dir).select("flow_id", fn.num(raw).alias("lenient"), fn.trim_nul(comm).alias("trimmed"), fn.day_from_path(path).alias("day"))


@query("""select flow_id, round(1000 + greatest(flow_id - 500, 0) * 2.0, 6) as epoch, round(start_us / 1e6 - flow_id * 2.0, 3) as offset_s, round(start_us / 1e6, 3) as start_ts, round(start_us / 1e6 + greatest(case when flow_id % 5 = 0 then 0 else flow_id % 7 - 3 end, 0), 3) as end_ts,
 strftime(make_timestamp((start_us // 900000000) * 900000000), '%m-%d %H:%M') as long_label, strftime(make_timestamp((start_us // 60000000) * 60000000), '%H:%M:%S') as short_label from v_flows""")
def clock_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotonic clocks, offsets without an anchor, intervals with negative durations clipped, labels of chart buckets."""
    n = F.col("flow_id")
    rows = views.flows(spark, sf_dir).select("flow_id", "start_us", (F.col("start_us") / 1e6).alias("ts"), F.when(n % 5 != 0, (n % 7 - 3).cast("double")).alias("duration"))
    bucket = lambda step: F.floor(F.col("start_us") / (step * 1_000_000)) * step
    out = fn.with_interval(rows, True).withColumns({"epoch": fn.mono_to_epoch(n * 2_000_000_000, F.lit(1_000_000_000_000), F.lit(1000.0)), "offset_s": fn.flow_offset(F.col("ts"), n * 2_000_000_000), "long_label": fn.bucket_label(bucket(900), 86_400), "short_label": fn.bucket_label(bucket(60), 3600)})
    return out.select("flow_id", F.round("epoch", 6).alias("epoch"), *[F.round(c, 3).alias(c) for c in ("offset_s", "start_ts", "end_ts")], "long_label", "short_label")


@query("""select flow_id, orig_bytes::double as sent, -1::double as gone, resp_bytes::double as resp_bytes, 0::double as lacking, round(coalesce(case when flow_id % 3 <> 0 then orig_bytes end, 0)::double, 6) as filled from v_flows""")
def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns under either of two names or a default, and a model's feature list filled up."""
    rows = views.flows(spark, sf_dir).withColumns({"ebpf_sent": F.col("orig_bytes"), "sent": F.lit(5), "filled": F.when(F.col("flow_id") % 3 != 0, F.col("orig_bytes"))})
    named = rows.select("flow_id", fn.resolve(rows, "sent", 0, "double").alias("sent"), fn.resolve(rows, "none", -1, "double").alias("gone"), "resp_bytes", "filled")
    return rounded(fn.align(named, ["resp_bytes", "lacking", "filled"]), "filled")


@query("""select 'baseline' as kind, unnest(['orig_bytes', 'resp_bytes', 'proto_num', 'is_attack', 'resp_p_freq']) as feature union all select 'enhanced', unnest(['orig_bytes', 'resp_bytes', 'proto_num', 'is_attack', 'resp_p_freq', 'ebpf_samples', 'comm'])
union all select 'selected', unnest(['orig_bytes', 'resp_bytes', 'proto_num', 'ebpf_samples', 'resp_p_freq']) union all select 'rows', count(*)::varchar from v_flows where flow_id % 4 <> 3""")
def feature_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of both feature sets by their names, the numeric ones that are not all null, and how many rows have a known label."""
    n = F.col("flow_id")
    rows = views.flows(spark, sf_dir).select("orig_bytes", "resp_bytes", "proto_num", F.when(n % 4 == 3, "unknown").otherwise(F.col("label_family")).alias("label_family"), "is_attack", (n % 50).alias("ebpf_samples"), F.lit(None).cast("string").alias("comm"), F.col("day_ix").alias("day"), "resp_p")
    known, base, enhanced = prepare.build_feature_sets(rows, "label_family", ["resp_p"])
    told = [("baseline", [c for c in base if c != "resp_p"]), ("enhanced", [c for c in enhanced if c != "resp_p"]), ("selected", [c for c in prepare.select_features(known) if c != "resp_p"])]
    names = spark.createDataFrame([(kind, c) for kind, columns in told for c in columns], "kind string, feature string")
    return names.union(known.agg(F.lit("rows"), F.count(F.lit(1)).cast("string")))


@query("""with g as (select orig_h, case when orig_h in ('10.0.0.1', '10.0.0.2') then 'test' else 'val' end as role from (select distinct orig_h from v_flows) where orig_h <> '10.0.0.3')
select flow_id, coalesce(role, 'train') as role from v_flows left join g using (orig_h)""")
def group_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their group's role; a group that is not listed trains."""
    rows = views.flows(spark, sf_dir)
    listed = rows.select("orig_h").distinct().where("orig_h <> '10.0.0.3'").withColumn("role", F.when(F.col("orig_h").isin("10.0.0.1", "10.0.0.2"), "test").otherwise("val"))
    return prepare.assign_roles(rows.select("flow_id", "orig_h"), listed, ["orig_h"]).select("flow_id", "role")


@query("""select 'ip' as call, count(*) as n from v_flows where flow_id % 3 = 0 union all select 'family', count(*) from v_flows where flow_id % 2 = 0 union all select 'band', count(*) from v_scores where ebpf_score_m / 1300.0 >= 0.65""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions as SQL users call them."""
    fn.register_sql(spark)
    f, s = views.flows(spark, sf_dir), views.scores(spark, sf_dir)
    return spark.sql("""select 'ip' as call, count(*) as n from {f} where u32_to_ipv4(ipv4_to_u32(case when flow_id % 3 = 0 then orig_h else 'x' end)) = orig_h
        union all select 'family', count(*) from {f} where label_family(case when flow_id % 2 = 0 then 'DDoS LOIT' else 'normal' end) = 'DDoS' union all select 'band', count(*) from {s} where score_band(ebpf_score_m / 1300.0) = 'high'""", f=f, s=s)  # fmt: skip
