"""Scans, sinks, filters and event forms on files and hand-made rows."""

import json

import pytest
from flowlab import functions as fn
from flowlab import sources
from flowlab.operators import clean, enrich, models, monitor, prepare
from flowlab.streaming import flow_partials, run_to_end, stream_enrich, stream_json, with_final_pass
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kernel_scans_and_stream(spark, tmp_path):
    (tmp_path / "flows").mkdir()
    flow = {"saddr": 1, "daddr": 2, "saddr_str": "10.0.0.1", "daddr_str": "x", "sport": 1, "dport": 2, "proto": 6}
    (tmp_path / "flows" / "a.json").write_text("\n".join([json.dumps(flow), json.dumps({"saddr_str": "bad", "daddr_str": "10.0.0.2"}), "{no json"]))
    got = sources.read_kernel_flows(spark, str(tmp_path / "flows")).select("saddr", "daddr")
    assert rows(got) == [(167772161, 2)]
    assert sources.read_kernel_events(spark, str(tmp_path / "flows")).count() == 2
    assert rows(sources.bad_json_lines(spark, str(tmp_path / "flows"), sources.FLOW_DDL)) == [("a.json", 3, 1)]
    stream = stream_json(spark, str(tmp_path / "flows"), sources.FLOW_DDL).where("sport is not null").observe("seen", F.count(F.lit(1)).alias("rows"))
    counts = run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert counts == {"late": 0, "seen.rows": 1} and spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_each_file_by_its_format(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tts\tid.orig_h\tproto\n1.5\t10.0.0.1\ttcp\n")
    (tmp_path / "b.log").write_text('{"ts": 2.5, "id.orig_h": "10.0.0.2", "proto": "udp"}\n{"ts": 3.5, "id": {"orig_h": "10.0.0.3"}}\n')
    (tmp_path / "c.log").write_text(",".join(sources.CONN_FIELDS) + "\n4.5,10.0.0.4,10.0.0.5,1,2,tcp,0,0,0,0,0,S1\n")
    assert sorted(rows(sources.read_conn(spark, str(tmp_path)).select("ts", "orig_h"))) == [(1.5, "10.0.0.1"), (2.5, "10.0.0.2"), (3.5, "10.0.0.3"), (4.5, "10.0.0.4")]


def test_label_files_with_other_columns_and_encodings(spark, tmp_path):
    a = "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Label\nx,1.1.1.1,1,2.2.2.2,2,6,3/7/2017 9:00,Web Attack – XSS\n"
    b = "Label,Timestamp,Protocol,Destination Port,Destination IP,Source Port,Source IP\r\nBENIGN,3/7/2017 9:01,17,4,4.4.4.4,3,\"3.3.3.3\"\r\n\r\n"
    (tmp_path / "friday-a.csv").write_bytes(a.encode("cp1252"))
    (tmp_path / "Friday-b.csv").write_bytes(b"\xef\xbb\xbf" + b.encode())
    (tmp_path / "Monday-c.csv").write_text("nothing\n")
    wide = [f"f{k}" for k in range(300)]
    (tmp_path / "Tuesday-d.csv").write_text(",".join([*wide, *sources.LABEL_COLUMNS]) + "\n" + ",".join(["0"] * 300 + ["5.5.5.5", "1", "6.6.6.6", "2", "6", "3/7/2017 9:00", "Bot"]) + "\n")
    assert rows(sources.read_labels(spark, str(tmp_path), "Tuesday").select("source_ip", "label")) == [("5.5.5.5", "Bot")]
    got = sources.read_labels(spark, str(tmp_path), "Friday").orderBy("source_ip")
    assert rows(got.select("source_ip", "destination_port", "protocol", "label", "file")) == [("1.1.1.1", "2", "6", "Web Attack – XSS", "friday-a.csv"), ("3.3.3.3", "4", "17", "BENIGN", "Friday-b.csv")]
    with pytest.raises(ValueError, match="Label"):
        sources.read_labels(spark, str(tmp_path), "Monday")


def test_weekday_of_a_run(spark, tmp_path):
    (tmp_path / "x.log").write_text("start\nreading /data/Tuesday-WorkingHours.pcap\n")
    run = str(tmp_path)
    assert sources.infer_day(spark, run) == "Tuesday"
    (tmp_path / "thursday.pcap").write_text("x")
    assert sources.infer_day(spark, run) == "Thursday"
    (tmp_path / "two").mkdir()
    for name in ("a-Monday.pcap", "b-Friday.pcap", "0.pcap"):
        (tmp_path / "two" / name).write_text("x")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("nothing\nWednesday.pcap then\nFriday.pcap\n")
    (tmp_path / "logs" / "b.log").write_text("Friday.pcap\n")
    assert sources.infer_day(spark, str(tmp_path / "two")) == "Monday" and sources.infer_day(spark, str(tmp_path / "logs")) == "Wednesday"
    assert sources.infer_day(spark, run, "a/friday.pcap") == "Friday" and sources.infer_day(spark, run, None, "Monday") == "Monday"
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no weekday"):
        sources.infer_day(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a"), (2, "test", "b")], "flow_id long, split string, ebpf_comm string")
    sources.write_table(df, str(tmp_path / "t"), ("split",))
    assert rows(sources.load_split(spark, str(tmp_path / "t"), ("test",)).select("flow_id")) == [(2,)]
    assert sources.to_merged_layout(df.withColumn("run_x", F.lit(1)).withColumn("ts", F.lit(1.0))).columns == ["ts", "ebpf_comm", "run_x"]
    assert sorted(sources.combine_runs([df, df.select("flow_id", F.lit(5).alias("more"))]).columns) == ["ebpf_comm", "flow_id", "more", "split"]
    for _ in range(2):
        sources.write_scored(df, str(tmp_path / "s"))
    assert sources.read_scored(spark, str(tmp_path / "s"), "flow_id long").count() == 4
    sources.write_report(df, str(tmp_path / "r"), "csv")
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    folds = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "flow_id long, repeat int, fold int")
    sources.write_folds(df, folds, ["flow_id"], str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("fold = 1").count() == 1


def test_columns(spark):
    df = spark.createDataFrame([(1_500_000_000, 1_000_000_000, 100.0, None, -2.0)], "ns long, anchor long, ts double, duration double, x double")
    assert rows(df.select(fn.mono_to_epoch(F.col("ns"), F.col("anchor"), F.col("ts")), fn.mono_to_epoch(F.lit(5), F.col("anchor"), F.col("ts")), fn.flow_offset(F.col("ts"), F.col("ns")))) == [(100.5, 100.0, 98.5)]
    assert rows(fn.with_interval(df, True).select("start_ts", "end_ts")) == [(100.0, 100.0)]
    assert rows(fn.with_interval(df, False, "ts", "x").select("end_ts")) == [(98.0,)]
    assert rows(df.select(fn.resolve(df, "duration", 7, "double"), fn.resolve(df, "gone", 8, "int"))) == [(7.0, 8)]
    assert rows(fn.align(df, ["duration", "other"]).select("duration", "other", "x")) == [(0.0, 0.0, -2.0)]
    scores = spark.createDataFrame([(None, 1, None), (0.0001, 0, "BENIGN"), (0.5, None, "odd")], "ebpf_score double, ebpf_pred int, label string")
    assert rows(scores.select(fn.score_text(F.col("ebpf_score")), fn.event_score(scores, "ebpf"), fn.event_label(scores, "ebpf"))) == [("N/A", 0.0, "ATTACK"), ("1.00e-04", 0.0001, "BENIGN"), ("0.500", 0.5, "odd")]
    t = spark.range(1).select(fn.bucket_label(F.lit(86_461), 60), fn.bucket_label(F.lit(86_461), 86_400))
    assert rows(t) == [("00:01:01", "01-02 00:01")]
    assert rows(spark.createDataFrame([("Friday",), ("x",)], "d string").select(prepare.week_order("d"))) == [(5,), (0,)]


def test_feature_roles(spark):
    names = ["orig_bytes", "pid_mode", "comm", "label_family", "day", "ebpf_samples", "proto_num", "is_attack"]
    assert prepare.split_feature_columns(names) == (["orig_bytes", "proto_num", "is_attack"], ["orig_bytes", "proto_num", "is_attack", "pid_mode", "comm", "ebpf_samples"])
    df = spark.createDataFrame([(1, 1.0, None, "a", 1)], "orig_bytes long, x double, empty double, s string, is_attack int")
    assert prepare.select_features(df) == ["orig_bytes", "x"]


def test_samples_and_aborts(spark):
    df = spark.range(1000).select(F.col("id").alias("flow_id"), F.when(F.col("id") < 900, "BENIGN").when(F.col("id") < 990, "DoS").otherwise("Bot").alias("label"), (F.col("id") % 5).alias("day"))
    got = prepare.quota_sample(df, "label", 50, 1, "flow_id", benign_ratio=0.5).groupBy("label").count()
    assert dict(rows(got)) == {"BENIGN": 30, "DoS": 50, "Bot": 10}
    for mode in ("cycle", "draw"):
        out = prepare.rebalance(df, "label", 50, 1, "flow_id", benign_ratio=2.0, mode=mode)
        assert dict(rows(out.groupBy("label").count())) == {"BENIGN": 200, "DoS": 50, "Bot": 50}
        assert out.where("label = 'BENIGN' and copy > 0").count() == 0
    parts = dict(rows(prepare.split_by_day(df, "day", "label", 50, 1, "flow_id").where("role = 'test_balanced'").groupBy("label").count()))
    assert parts == {"BENIGN": 20, "DoS": 10, "Bot": 10}
    with pytest.raises(ValueError, match="fewer than the quota"):
        prepare.split_by_day(df, "day", "label", 50, 1, "flow_id", min_quota=11)
    some = prepare.stratified_split(df, "label", 1, "flow_id", per_bucket=5)  # more hash digits, same roles
    assert sorted(rows(some.select("flow_id", "role"))) == sorted(rows(prepare.stratified_split(df, "label", 1, "flow_id").select("flow_id", "role")))


def test_filters_and_forms(spark):
    df = spark.createDataFrame([("10.0.0.1", "10.0.0.2", 6, "DoS", 1.0), ("x", "10.0.0.2", 17, "unknown", 9.0), ("10.0.0.1", None, 1, None, None)], "orig_h string, resp_h string, proto_num int, label_family string, ts double")
    got, counts = clean.keep(df, clean.valid_addresses() & clean.known_label() & clean.tcp_or_udp() & clean.complete("ts"), "x")
    assert got.count() == 1 and rows(counts) == [(3, 2)]
    assert rows(df.select(clean.ready("ts", 10.0, 5.0))) == [(True,), (False,), (True,)]
    raw = spark.createDataFrame([(0.0, "", "10.0.0.9", "none", "17.0"), (None, "10.0.0.8", "10.0.0.9", "ssh", None), (3661.0, None, None, None, "47")], "ts_s double, saddr_str string, saddr string, exe string, proto string")
    shown = clean.normalise_event(raw)
    assert rows(shown.select("time", "src_ip", "dst_ip", "src_port", "exe", "pid", "proto")) == [("00:00:00", "10.0.0.9", "?", "?", "", 0, "UDP"), (None, "10.0.0.8", "?", "?", "ssh", 0, "TCP"), ("01:01:01", "?", "?", "?", "", 0, "47")]
    kernel = spark.createDataFrame([(5, 0x0100000A, 1), (2, 0x0A000001, 1)], "evtype int, saddr long, daddr long")
    assert [r["saddr_str"] for r in clean.normalise_event_ips(kernel).collect()] == ["10.0.0.1", "10.0.0.1"]
    assert monitor.noise(F.lit("224.0.0.1")) is not None


def test_interval_matches_over_bins(spark):
    """Intervals longer than bins meet once; a hot tuple is compared bin by bin; all pairs by brute force."""
    conn = spark.range(40).select(F.col("id").alias("flow_id"), F.lit("a").alias("orig_h"), F.lit("b").alias("resp_h"), F.lit(1).alias("orig_p"), F.lit(2).alias("resp_p"), F.lit(6).alias("proto_num"), (F.col("id") * 37 % 500).alias("start_us"), (F.col("id") * 37 % 500 + F.col("id") * 11 % 120).alias("end_us"))
    flows = spark.range(60).select(F.col("id").alias("part_id"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("saddr"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("daddr"), F.when(F.col("id") % 4 == 0, 2).otherwise(1).alias("sport"), F.when(F.col("id") % 4 == 0, 1).otherwise(2).alias("dport"), F.lit(6).alias("proto"), (F.col("id") * 13 % 550 - 20).alias("first_us"), (F.col("id") * 13 % 550 - 20 + F.col("id") * 7 % 90).alias("last_us"))
    got = sorted(rows(enrich.match_interval(conn, flows, 5, bin_us=25).select("flow_id", "part_id", "match_dir")))
    want = sorted((c["flow_id"], k["part_id"], "rev" if k["saddr"] == "b" else "fwd") for c in conn.collect() for k in flows.collect() if k["first_us"] <= c["end_us"] + 5 and k["last_us"] >= c["start_us"] - 5)
    assert got == want and len(want) > 100


def test_long_connection_and_final_pass(spark, tmp_path):
    """A ten-minute connection is matched on a stream whose ``longest_s`` allows it, and by the final pass in any case."""
    at = lambda s: F.timestamp_seconds(F.lit(s))
    ev = spark.range(40).select((F.col("id") * 60).alias("s"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))

    def sides(src):
        conn = src.select(F.col("s").alias("conn_id"), F.timestamp_seconds("s").alias("start"), F.timestamp_seconds(F.col("s") + 600).alias("end"), F.lit("a").alias("orig_h"), F.lit("b").alias("resp_h"), F.col("s").alias("orig_p"), F.lit(2).alias("resp_p"), F.lit(6).alias("proto_num"))
        flow = src.select(F.lit("a").alias("saddr"), F.lit("b").alias("daddr"), F.col("s").alias("sport"), F.lit(2).alias("dport"), F.lit(6).alias("proto"), F.timestamp_seconds(F.col("s") + 500).alias("first"), F.timestamp_seconds(F.col("s") + 590).alias("last"), F.lit(1).alias("samples"), F.lit(1).alias("bytes_sent"), F.lit(1).alias("bytes_recv"))
        return conn, flow

    stream = lambda: spark.readStream.schema("s long").parquet(str(tmp_path / "ev"))
    whole = stream_enrich(*sides(spark.read.parquet(str(tmp_path / "ev"))))
    assert {r["match_dir"] for r in whole.collect()} == {"fwd"} and at(0) is not None
    for longest, name in ((600, "long"), (120, "short")):
        run_to_end(stream_enrich(*sides(stream()), longest_s=longest), str(tmp_path / name), str(tmp_path / f"{name}-state"))
    given = spark.read.parquet(str(tmp_path / "long"))
    assert given.count() > 0 and {r["match_dir"] for r in given.collect()} == {"fwd"}
    assert {r["match_dir"] for r in spark.read.parquet(str(tmp_path / "short")).collect()} == {"none"}
    done = with_final_pass(given, whole, ("conn_id",))
    assert done.count() == done.select("conn_id").distinct().count() == 40


def test_late_rows_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, event_id long, ts_us long, saddr string, daddr string, sport int, dport int, proto int, evtype int, bytes long, pid long"
    row = lambda k, s: (k, s)
    for n, (k, s) in enumerate((row(1, 1000), row(2, 5000), row(3, 1001), row(4, 9000))):  # the third comes after its window's watermark
        df = spark.createDataFrame([(k, s)], "event_id long, s long").select(F.timestamp_seconds("s").alias("ts"), "event_id", (F.col("s") * 1000000).alias("ts_us"), F.lit("a").alias("saddr"), F.lit("b").alias("daddr"), F.lit(1).alias("sport"), F.lit(2).alias("dport"), F.lit(6).alias("proto"), F.lit(2).alias("evtype"), F.lit(10).cast("long").alias("bytes"), F.lit(1).cast("long").alias("pid"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        counts = run_to_end(flow_partials(src), str(tmp_path / "out"), str(tmp_path / "state"))
        assert counts["late"] == (1 if n == 2 else 0)


def test_margins_and_forest_samples(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 0.0), (3, 2.0)], "id long, margin double")
    assert rows(models.margin_scores(df).select("score")) == [(0.0,), (0.5,), (1.0,)]
    assert rows(models.margin_scores(df.limit(1)).select("score")) == [(0.0,)]
    table = spark.range(20_000).select(F.col("id").alias("flow_id"), F.rand(1).alias("x"))
    forest = models.isolation_forest(table, ["x"], "flow_id", trees=5, sample=64)
    roots = {r["tree"]: r["size"] for r in forest.where("node = 1").collect()}
    assert roots == dict.fromkeys(range(5), 64)
