"""Streams: growing logs, counters over hundreds of batches and restarts, matching with timers, the final pass, the rolling dashboard."""

import json
import os

import pytest
from flowlab.operators import monitor
from flowlab.sources import growing
from flowlab.streaming import counters, matching, run_to_end, stream_enrich, with_final_pass
from flowlab.streaming.dashboard import dashboard, keep_buckets
from pyspark.sql import functions as F


def append(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text.encode() if isinstance(text, str) else text)


def lines_of(spark, out):
    return sorted((r["file"], r["value"]) for r in spark.read.schema(growing.SCHEMA).parquet(out).collect())


@pytest.mark.parametrize("range_bytes", [5, 1 << 20])
def test_growing_logs(spark, tmp_path, range_bytes):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()

    def step():
        return run_to_end(growing.stream_log(spark, str(logs), ".log", range_bytes), out, state)

    append(logs / "a.log", "head a\none\ntwo\nhal")
    append(logs / "b.log", "no end yet")
    append(logs / "other.txt", "not read\n")
    step()
    assert lines_of(spark, out) == [("a.log", "head a"), ("a.log", "one"), ("a.log", "two")]
    append(logs / "a.log", "f\r\n\n  \nü\xff\n".encode("utf-8").replace(b"\xc3\xbf", b"\xff"))
    append(logs / "b.log", "\n")
    step()
    want = [("a.log", "half"), ("a.log", "head a"), ("a.log", "one"), ("a.log", "two"), ("a.log", "ü�"), ("b.log", "no end yet")]
    assert lines_of(spark, out) == want
    step()  # nothing new
    assert lines_of(spark, out) == want
    os.rename(logs / "a.log", logs / "a.1.log")  # rolled, with a last line that nobody has read
    append(logs / "a.1.log", "last\n")
    append(logs / "a.log", "head a2\nnew\n")
    append(logs / "b.log", "b\n", "wb")  # cut off and written anew
    step()
    want = sorted([*want, ("a.1.log", "last"), ("a.log", "head a2"), ("a.log", "new"), ("b.log", "b")])
    assert lines_of(spark, out) == want
    append(logs / "a.log", "".join(f"row {k}\n" for k in range(200)))
    step()
    assert lines_of(spark, out) == sorted([*want, *(("a.log", f"row {k}") for k in range(200))])


def test_rows_of_logs(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}', "f", 0), ("{bad", "f", 9), ("[]", "f", 12), ("a,b", "f", 20), ("1,x", "f", 24), ("a,b", "f", 30)], growing.SCHEMA)
    assert [tuple(r) for r in growing.json_rows(lines, "a int, b string", ("file",)).where("a is not null").collect()] == [("f", 1, "x")]
    assert [tuple(r) for r in growing.csv_rows(lines.where("at > 15"), ("a", "b")).collect()] == [("1", "x")]


def test_counters_of_three_hundred_batches(spark, tmp_path):
    """One file a batch, each tenth row late; stopped and begun again in between. All batches are counted, and each late row."""
    (tmp_path / "in").mkdir()
    for k in range(300):
        at = 1_000_000 + k * 60 - (100_000 if k % 10 == 9 else 0)
        (tmp_path / "in" / f"{k:04d}.json").write_text(json.dumps({"id": k, "s": at}) + "\n")
        os.utime(tmp_path / "in" / f"{k:04d}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        def stream(glob):
            src = spark.readStream.schema("id long, s long").option("maxFilesPerTrigger", 1).option("pathGlobFilter", glob).json(str(tmp_path / "in"))
            seen = src.observe("seen", F.count(F.lit(1)).alias("rows")).withColumn("at", F.timestamp_seconds("s")).withWatermark("at", "10 seconds")
            return seen.dropDuplicatesWithinWatermark(["id"])

        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        first = run_to_end(stream("00*.json"), out, state)
        second = run_to_end(stream("0*.json"), out, state)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (first["seen.rows"], second["seen.rows"]) == (100, 200) and (first["late"], second["late"]) == (10, 20)
    assert counters.totals(spark, state) == {"input": 300, "late": 30, "seen.rows": 300}
    assert counters.missing_batches(spark, state) == [] and counters.batch_counts(spark, state).where("name = 'input' and value = 1").count() == 300
    assert spark.read.schema("id long").parquet(out).count() == 270
    os.remove(sorted((tmp_path / "state-counts").glob("*.json"))[7])
    assert counters.missing_batches(spark, state) == [7]


def sides(src, length=600):
    """Connections of ``length`` seconds, each with a flow near its end."""
    key = lambda a, b, p, q, r: (F.lit("a").alias(a), F.lit("b").alias(b), F.col("s").alias(p), F.lit(2).alias(q), F.lit(6).alias(r))
    conn = src.select(F.col("s").alias("conn_id"), F.timestamp_seconds("s").alias("start"), F.timestamp_seconds(F.col("s") + length).alias("end"), *key("orig_h", "resp_h", "orig_p", "resp_p", "proto_num"))
    flow = src.select(*key("saddr", "daddr", "sport", "dport", "proto"), F.timestamp_seconds(F.col("s") + length - 100).alias("first"), F.timestamp_seconds(F.col("s") + length - 10).alias("last"), F.lit(1).alias("samples"), F.lit(1).alias("bytes_sent"), F.lit(1).alias("bytes_recv"))
    return conn, flow


@pytest.fixture
def rocks(spark):
    with matching.rocks(spark):
        yield


def test_long_connections_match_on_the_stream(spark, tmp_path, rocks):
    """Connections of ten minutes and of a day, without a parameter; what the watermark has not passed waits for the next run."""
    for k in range(2):
        spark.range(k * 20 + 1, k * 20 + 21).select((F.col("id") * 60).alias("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    ev = lambda: spark.readStream.schema("s long").parquet(str(tmp_path / "ev"))
    whole = stream_enrich(*sides(spark.read.parquet(str(tmp_path / "ev"))))
    run_to_end(matching.stream_match(*sides(ev())), str(tmp_path / "out"), str(tmp_path / "state"))
    given = spark.read.schema(matching.OUT).parquet(str(tmp_path / "out"))
    assert given.count() > 20 and {r["match_dir"] for r in given.collect()} == {"fwd"}
    spark.createDataFrame([(1_000_000,)], "s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    counts = run_to_end(matching.stream_match(*sides(ev())), str(tmp_path / "out"), str(tmp_path / "state"))
    given = spark.read.schema(matching.OUT).parquet(str(tmp_path / "out"))
    assert counts["late"] == 0 and given.count() == given.select("conn_id").distinct().count() == 40
    assert {r["match_dir"] for r in given.collect()} == {"fwd"}
    run_to_end(matching.stream_match(*sides(ev(), 86_400)), str(tmp_path / "day"), str(tmp_path / "day-state"))
    assert {r["match_dir"] for r in spark.read.schema(matching.OUT).parquet(str(tmp_path / "day")).collect()} == {"fwd"}
    assert whole.count() == 40


def test_matches_are_those_of_the_tables(spark, tmp_path, rocks):
    """Both directions, several flows a connection, none, ties; batches in any cut."""
    h = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(n))
    spark.range(300).select("id").repartition(3).write.parquet(str(tmp_path / "ids"))

    def both(src):
        at = F.col("id") * 20 + 20
        ends = (F.lit("x"), F.lit("y"), (h(1, 6) + 1000), F.lit(5), F.lit(6))
        conn = src.select(F.col("id").alias("conn_id"), F.timestamp_seconds(at).alias("start"), F.timestamp_seconds(at + h(2, 50)).alias("end"), *[c.alias(n) for c, n in zip(ends, ("orig_h", "resp_h", "orig_p", "resp_p", "proto_num"), strict=True)])
        back = h(3, 3) == 0
        turned = (F.when(back, ends[1]).otherwise(ends[0]), F.when(back, ends[0]).otherwise(ends[1]), F.when(back, ends[3]).otherwise(ends[2]), F.when(back, ends[2]).otherwise(ends[3]), ends[4])
        flow = src.where(h(4, 5) > 1).select(*[c.alias(n) for c, n in zip(turned, ("saddr", "daddr", "sport", "dport", "proto"), strict=True)], F.timestamp_seconds(at + h(5, 30)).alias("first"), F.timestamp_seconds(at + h(5, 30) + h(6, 90)).alias("last"), h(7, 9).alias("samples"), h(8, 9).alias("bytes_sent"), h(8, 9).alias("bytes_recv"))
        return conn, flow

    spark.createDataFrame([(100_000,)], "id long").write.mode("append").parquet(str(tmp_path / "ids"))  # the watermark passes all others
    whole = stream_enrich(*both(spark.read.parquet(str(tmp_path / "ids")))).where("conn_id < 1000")
    run_to_end(matching.stream_match(*both(spark.readStream.schema("id long").parquet(str(tmp_path / "ids")))), str(tmp_path / "out"), str(tmp_path / "state"))
    given = spark.read.schema(matching.OUT).parquet(str(tmp_path / "out"))
    cols = ["conn_id", "match_dir", "samples", "bytes_sent"]
    want = sorted(map(str, whole.select(*cols).collect()))
    assert sorted(map(str, given.select(*cols).collect())) == want and len({r["match_dir"] for r in given.collect()}) == 3


def test_the_final_pass_replaces(spark, tmp_path):
    """What a stream gave wrongly does not stay: here connections longer than its assumed longest."""
    spark.range(40).select((F.col("id") * 60).alias("s")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    run_to_end(stream_enrich(*sides(spark.readStream.schema("s long").parquet(str(tmp_path / "ev")))), str(tmp_path / "out"), str(tmp_path / "state"))
    short = spark.read.parquet(str(tmp_path / "out"))
    assert {r["match_dir"] for r in short.collect()} == {"none"}
    done = with_final_pass(short, stream_enrich(*sides(spark.read.parquet(str(tmp_path / "ev")))), ("conn_id",)).collect()
    assert [r["match_dir"] for r in done] == ["fwd"] * 40


def test_dashboard_over_restarts(spark, tmp_path):
    src = lambda: spark.readStream.schema("at timestamp, us long, score double, pred int").parquet(str(tmp_path / "in"))
    for part in range(3):
        rows = spark.range(part * 400, part * 400 + 400).withColumn("us", F.lit(1_700_000_000_000_000) + F.col("id") * 7_000_000 - (F.col("id") % 3) * 500_000_000)
        rows.select(F.timestamp_micros("us").alias("at"), "us", (F.col("id") % 17).cast("double").alias("score"), (F.col("id") % 2).cast("int").alias("pred")).write.mode("append").parquet(str(tmp_path / "in"))
        keep_buckets(src(), "at", "score", "pred", 900_000_000, str(tmp_path / "kept"), str(tmp_path / "state")).awaitTermination()
        want = {r["bucket"]: r for r in monitor.score_buckets(spark.read.parquet(str(tmp_path / "in")), "us", "score", 900_000_000).collect()}
        got = {r["bucket"]: r for r in dashboard(spark, str(tmp_path / "kept")).collect()}
        assert set(got) == set(want)
        for b, r in got.items():
            assert (r["n"], r["mean_score"], r["smooth"]) == pytest.approx((want[b]["n"], want[b]["mean_score"], want[b]["smooth"]))
    assert len({r["batch"] for r in spark.read.parquet(str(tmp_path / "kept")).select("batch").collect()}) >= 3
    near = dashboard(spark, str(tmp_path / "kept"), 1_800_000_000)
    assert near.count() == 2
