"""The flow operators on hand-made cases, and properties of the splits and metrics."""

import math

import pytest
from flowlab import functions as fn
from flowlab import sources
from flowlab.operators import enrich, evaluate, label, models, monitor, prepare
from flowlab.plans import catalogue, views
from pyspark.sql import functions as F


def one(df):
    return [tuple(r) for r in df.collect()]


def values(spark, rows, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()]


def test_addresses(spark):
    texts = ["10.0.0.1", " 10.0.0.1 ", "::1", "300.1.1.1", "x", None, "255.255.255.255", "01.1.1.1"]
    assert values(spark, texts, fn.ipv4_to_u32) == [167772161, 167772161, None, None, None, None, 4294967295, None]
    assert values(spark, [167772161], fn.u32_to_ipv4, "long") == ["10.0.0.1"]
    assert values(spark, [167772161], lambda c: fn.u32_to_ipv4(c, "network"), "long") == ["1.0.0.10"]
    assert values(spark, [0x0A000001], fn.byteswap32, "long") == [0x0100000A]


def test_sql_functions(spark):
    fn.register_sql(spark)
    row = spark.sql("select ipv4_to_u32('10.0.0.1'), ipv4_to_u32('::1'), u32_to_ipv4(167772161), label_family('DoS Hulk'), label_family('BENIGN'), proto_num('tcp'), score_band(0.5)").first()
    assert tuple(row) == (167772161, None, "10.0.0.1", "DoS", "BENIGN", 6, "mid")


def test_taxonomy(spark):
    raw = ["DDoS", "DoS Hulk", "FTP-Patator", "Web Attack – XSS", "Heartbleed", None, "BENIGN", "Bot", "PortScan", "Infiltration", "odd"]
    assert values(spark, raw, fn.label_family) == ["DDoS", "DoS", "BruteForce", "WebAttack", "Heartbleed", "Other", "BENIGN", "Bot", "PortScan", "Infiltration", "Other"]


def test_small_functions(spark):
    assert values(spark, ["TCP", "udp", "icmp", "6", None, "x"], fn.proto_num) == [6, 17, 0, 0, 0, 0]
    assert values(spark, ["TCP", "icmp", "47", "x", None], lambda c: fn.proto_num(c, "label")) == [6, 1, 47, -1, -1]
    assert values(spark, ["TCP", "6.0", "x", None], lambda c: fn.proto_num(c, "live")) == [6, 6, 0, 0]
    assert values(spark, ["6", "17.0", "tcp"], fn.proto_name) == ["TCP", "UDP", "TCP"]
    assert values(spark, ["1.5", "-", None, " 2 "], fn.num) == [1.5, 0.0, 0.0, 2.0]
    assert values(spark, [0.1, 0.35, 0.65, None], fn.score_band, "double") == ["low", "mid", "high", "low"]
    assert values(spark, ["a/Friday-x.csv", "b/none"], fn.day_from_path) == ["Friday", "Unknown"]
    assert values(spark, ["224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "ff02::1"], monitor.noise) == [True, True, False, True, True]
    assert values(spark, ["sh\x00junk", "sh"], fn.trim_nul) == ["sh", "sh"]
    assert [fn.bucket_seconds(x) for x in (60, 300, 900, 3600, 21600, 99999)] == [2, 10, 15, 60, 300, 900]


FLOW = "part_id long, saddr string, daddr string, sport int, dport int, proto int, first_us long, last_us long, samples long, bytes_sent long, bytes_recv long"
CONN = "flow_id long, orig_h string, resp_h string, orig_p int, resp_p int, proto_num int, start_us long, end_us long"


def test_matching(spark):
    flows = spark.createDataFrame([(1, "a", "b", 1, 2, 6, 0, 9, 5, 10, 20), (2, "a", "b", 1, 2, 6, 10, 19, 9, 11, 21), (3, "a", "b", 1, 2, 6, 20, 29, 2, 12, 22), (4, "d", "c", 4, 3, 6, 0, 9, 1, 30, 40)], FLOW)
    conn = spark.createDataFrame([(1, "a", "b", 1, 2, 6, 5, 25), (2, "c", "d", 3, 4, 6, 5, 25), (3, "x", "y", 1, 1, 6, 0, 1), (4, "a", "b", 1, 2, 6, 900, 999)], CONN)
    live = enrich.match_live(conn, flows, F.struct("samples", "part_id"))
    got = {r["flow_id"]: (r["match_dir"], r["ebpf_samples"], r["ebpf_bytes_sent"]) for r in live.collect()}
    assert got == {1: ("fwd", 9, 11), 2: ("rev", 1, 30), 3: ("none", None, None), 4: ("fwd", 9, 11)}  # counters of a reverse match are not swapped
    replay = enrich.match_replay(conn, flows, F.struct("first_us", "part_id"))
    assert {r["flow_id"]: r["ebpf_samples"] for r in replay.collect()}[1] == 5
    assert {r["samples"] for r in enrich.rollup_partials(flows).where("saddr = 'a'").collect()} == {16}
    assert {r["flow_id"] for r in enrich.in_window(live, 5).collect()} == {1, 2, 3}  # a match outside the window removes the row
    assert {r["flow_id"]: r["match_dir"] for r in enrich.in_window(live, 5, "unmatch").collect()}[4] == "none"
    assert sorted((r["flow_id"], r["part_id"]) for r in enrich.match_interval(conn, flows, 0).collect()) == [(1, 1), (1, 2), (1, 3), (2, 4)]


@pytest.mark.parametrize(("span", "kernel", "name"), [(2.0, 1.0, "live"), (2.1, 1.0, "realtime"), (10.5, 1.0, "moderate"), (101.0, 1.0, "fast"), (501.0, 1.0, "topspeed"), (3.0, 0.2, "realtime")])
def test_scenario(spark, span, kernel, name):
    conn = spark.createDataFrame([(0, int(span * 1e6))], "start_us long, end_us long")
    flows = spark.createDataFrame([(0, int(kernel * 1e6))], "first_us long, last_us long")
    assert enrich.replay_scenario(conn, flows).first()["scenario"] == name


def nearest(spark, t, labels, tol):
    left = spark.createDataFrame([(1, "k", t)], "id long, k string, t long")
    right = spark.createDataFrame([(n, "k", at, v) for n, (at, v) in enumerate(labels)], "n long, k string, at long, v string")
    return label.asof_nearest(left, right, "k", "t", "at", tol, "n", ["v"], "id").first()["m_v"]


def test_asof(spark):
    assert nearest(spark, 10, [(8, "p"), (12, "q")], 5) == "p"
    assert nearest(spark, 20, [(20, "r"), (20, "s")], 5) == "s"
    assert nearest(spark, 18, [(20, "r"), (20, "s")], 5) == "s"
    assert nearest(spark, 30, [(25, "a"), (36, "b")], 5) == "a"
    assert nearest(spark, 30, [(25, "a"), (36, "b")], 4) is None


def test_two_pass(spark):
    labels = spark.createDataFrame([(1, "k", 0, "BENIGN"), (2, "k", 100, "DoS")], "label_id long, k string, ts_us long, label_family string")
    flows = spark.createDataFrame([(1, "k", 0, 100), (2, "k", 100, 0), (3, "k", 0, 50), (4, "z", 0, 1)], "flow_id long, k string, start_us long, end_us long")
    assert dict(one(label.label_two_pass(flows, labels, "k", 10))) == {1: "DoS", 2: "DoS", 3: "BENIGN", 4: "Unknown"}


def test_offset_rounds_half_to_even(spark):
    for gap, want in ((2_500_000, 2), (3_500_000, 4)):
        run, labels = spark.createDataFrame([(gap,)], "start_us long"), spark.createDataFrame([(0,)], "ts_us long")
        assert label.label_offset(run, labels).first()[0] == want


def test_date_vote_and_hours(spark):
    rows = spark.createDataFrame([("3/7/2017 8:55", "f"), ("13/07/2017 1:05:01", "f"), ("bad", "f"), ("7/3/2017 8:55", "m"), ("7/13/2017 9:00", "m")], "t string, file string")
    got = sorted((r["file"], str(r["ts"])) for r in label.parse_ts_vote(rows, "t", "file").collect())
    assert got == [("f", "2017-07-03 08:55:00"), ("f", "2017-07-13 01:05:01"), ("f", "None"), ("m", "2017-07-03 08:55:00"), ("m", "2017-07-13 09:00:00")]
    hours = [("Friday-Afternoon", 3)] * 3 + [("A-WorkingHours", 9)] * 98 + [("A-WorkingHours", 2)] * 2 + [("B-WorkingHours", 9)] * 96 + [("B-WorkingHours", 2)] * 4
    ts = spark.createDataFrame(hours, "file string, h int").withColumn("ts", F.make_timestamp(F.lit(2017), F.lit(7), F.lit(3), F.col("h"), F.lit(0), F.lit(0)))
    fixed = {(r["file"], r["h"], r["x"]) for r in label.fix_hours(ts, "file").withColumn("x", F.hour("ts")).collect()}
    assert fixed == {("Friday-Afternoon", 3, 15), ("A-WorkingHours", 9, 9), ("A-WorkingHours", 2, 2), ("B-WorkingHours", 9, 9), ("B-WorkingHours", 2, 14)}


def test_statistics(spark):
    p = spark.createDataFrame([(1, 3.288579594489766e-22), (2, 0.0009765625), (3, 1.0), (4, None)], "i int, p double")
    got = {r["i"]: r["h"] for r in evaluate.holm(p, "p", "h").collect()}
    assert got[1] == pytest.approx(9.865738783469299e-22) and got[2] == pytest.approx(0.001953125) and got[3] == 1.0 and got[4] is None
    low, high = spark.range(1).select(*fn.wilson(F.lit(4), F.lit(5))).first()
    assert (low, high) == pytest.approx((0.3755282641185388, 0.9637768390302125))
    for b, c, want in ((0, 11, 0.0009765625), (1, 7, 0.0703125), (0, 0, 1.0), (5, 5, 1.0)):
        assert spark.range(1).select(fn.mcnemar_p(F.lit(b), F.lit(c))).first()[0] == pytest.approx(want)


def test_ranking_metrics(spark):
    tied = spark.createDataFrame([(1, 5), (0, 5), (1, 5), (0, 5)], "y int, s int")
    assert evaluate.roc_auc(tied, "y", "s").first()[0] == 0.5
    rows = spark.createDataFrame([(int(k % 3 == 0), (k * 37) % 101) for k in range(100)], "y int, s int")
    a = evaluate.roc_auc(rows, "y", "s").first()[0]
    assert a + evaluate.roc_auc(rows.withColumn("s", -F.col("s")), "y", "s").first()[0] == pytest.approx(1.0)
    assert evaluate.roc_auc(rows.where("y = 1"), "y", "s").first()[0] is None
    few = rows.where("y = 0").union(rows.where("y = 1").limit(5))
    assert evaluate.select_threshold(few, "y", "s", "f1").first()["threshold"] == 0.5
    assert evaluate.select_threshold(rows.where("y = 1"), "y", "s", "fpr", 0.1).first()["threshold"] == 0.5
    by = evaluate.prefix_sums(evaluate.score_counts(rows.withColumn("g", F.lit(1)), "y", "s", ("g",)), ("g",)).drop("g")
    assert sorted(one(by)) == sorted(one(evaluate.prefix_sums(evaluate.score_counts(rows, "y", "s"))))
    m = spark.createDataFrame([(1, 1, 91239), (0, 1, 18324), (1, 0, 156714), (0, 0, 279930)], "y int, p int, n long").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    r = evaluate.binary_metrics(m, "y", "p").first()
    assert (r["precision"], r["recall"], r["fpr"]) == pytest.approx((0.832753759, 0.367968928, 0.061437567), abs=1e-8)


def test_bootstrap_holds_the_estimate(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    auc = evaluate.roc_auc(s, "y_true", "ebpf_score_m").first()[0]
    for cluster in (None, "cluster_key"):
        ci = evaluate.bootstrap_ci(s, "y_true", "ebpf_score_m", n=60, cluster=cluster).first()
        assert ci["low"] < auc < ci["high"] and ci["replicates"] == 60 and ci["high"] - ci["low"] < 0.2


def test_quota_and_rebalance(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(["a"] * 3 + ["b"] * 10 + ["c"] * 100)], "id long, c string")
    count = lambda df: dict(one(df.groupBy("c").count()))
    assert count(prepare.quota_sample(rows, "c", 5, 1, "id")) == {"a": 3, "b": 5, "c": 5}
    assert count(prepare.quota_sample(rows, "c", 5, 1, "id", equal=True)) == {"a": 3, "b": 3, "c": 3}
    assert count(prepare.rebalance(rows.where("c <> 'c'"), "c", 5, 1, "id")) == {"a": 5, "b": 5}


def test_splits_are_disjoint_and_complete(spark, sf_dir):
    flows = views.flows(spark, sf_dir)
    roles = prepare.stratified_split(flows, "label_family", 1, "flow_id")
    assert roles.count() == roles.select("flow_id").distinct().count() == flows.count()
    groups = prepare.group_table(flows, ("orig_h", "resp_h"), "label_family", "is_attack")
    split = prepare.group_split(groups, "dom_label", "n_rows", ("orig_h", "resp_h"), 1)
    assert split.count() == groups.count()
    dealt = prepare.assign_roles(flows, split, ["orig_h", "resp_h"])
    assert dealt.groupBy("orig_h", "resp_h").agg(F.count_distinct("role").alias("n")).where("n > 1").count() == 0
    folds = prepare.kfold(groups.limit(3), ("orig_h", "resp_h"), 5, 2, 1)
    assert folds.count() == 6 and folds.agg(F.max("fold")).first()[0] == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"ts": 1.5, "id.orig_h": "10.0.0.1", "id.orig_p": 5, "proto": "tcp"}\n{bad\n{"ts": 2, "id": {"orig_h": "10.0.0.2", "resp_p": "7"}}\n')
    got = one(sources.read_conn_json(spark, str(tmp_path / "a.log")).select("ts", "orig_h", "orig_p", "resp_p"))
    assert got == [(1.5, "10.0.0.1", 5, 0), (2.0, "10.0.0.2", 0, 7)]
    (tmp_path / "b.log").write_text("#separator\n#fields\tts\tid.resp_h\tduration\n1.0\t10.0.0.3\t-\n")
    assert one(sources.read_conn_tsv(spark, str(tmp_path / "b.log")).select("ts", "orig_h", "resp_h", "duration")) == [(1.0, None, "10.0.0.3", 0.0)]
    (tmp_path / "c.csv").write_text("ts,orig_h\n1,10.0.0.4\nts,orig_h\n2,10.0.0.5\n")
    assert [r[0] for r in sources.read_conn_csv(spark, str(tmp_path / "c.csv")).select("ts").collect()] == [1.0, 2.0]
    kinds = {r["file"][-5:]: r["format"] for r in sources.detect_conn_format(spark, str(tmp_path / "*")).collect()}
    assert kinds == {"a.log": "json", "b.log": "tsv", "c.csv": "csv"}
    nested = spark.createDataFrame([((1, (2, [3, 4])),)], "m struct<a: int, b: struct<c: int, d: array<int>>>")
    assert sources.flatten_struct(nested).first().asDict() == {"run_m_a": 1, "run_m_b_c": 2, "run_m_b_d": "[3,4]"}
    (tmp_path / "Monday-x.csv").write_text("Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Label\na,1,b,2,6,3/7/2017 8:55,BENIGN\n")
    assert sources.read_labels(spark, str(tmp_path), "Monday").first()["source_port"] == "1"


def test_stream_equals_batch(spark, sf_dir):
    batch = {(r["saddr"], r["first_us"], r["samples"]) for r in catalogue.events_to_flows(spark, sf_dir).collect()}
    stream = {(r["saddr"], r["first_us"], r["samples"]) for r in catalogue.stream_flows(spark, sf_dir).collect()}
    assert stream <= batch and len(batch) - len(stream) <= 5  # the last windows wait


def test_isolation_forest_finds_the_odd_one(spark):
    rows = spark.range(500).select(F.col("id").alias("flow_id"), F.when(F.col("id") == 7, 1000.0).otherwise(F.col("id") % 10).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    forest = models.isolation_forest(rows, ["a", "b"], "flow_id", trees=20, sample=128)
    scores = models.isolation_scores(rows, forest, ["a", "b"], "flow_id")
    assert scores.orderBy(F.desc("score")).first()["flow_id"] == 7
    assert not math.isnan(scores.agg(F.sum("score")).first()[0])


def test_entry_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalogue.QUERIES)
    sys.modules.pop("__spark_entry__", None)
