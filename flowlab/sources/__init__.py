"""Scans and sinks of connection logs, kernel logs and label files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from flowlab.functions import day_from_path, ipv4_to_u32, num

CONN_FIELDS = ("ts", "orig_h", "resp_h", "orig_p", "resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "conn_state")
CONN_TYPES = {"ts": "double", "orig_h": "string", "resp_h": "string", "orig_p": "int", "resp_p": "int", "proto": "string", "conn_state": "string"}
NESTED = {"orig_h": "id.orig_h", "resp_h": "id.resp_h", "orig_p": "id.orig_p", "resp_p": "id.resp_p"}
EVENT_DDL = "ts_ns long, ts_s double, pid long, uid long, comm string, saddr long, daddr long, sport int, dport int, proto int, saddr_str string, daddr_str string, evtype int, state_old long, state_new long, bytes long, retransmits long"
FLOW_DDL = "first_ts_ns long, last_ts_ns long, first_ts_s double, last_ts_s double, flush_ts_s double, saddr long, daddr long, sport int, dport int, proto int, saddr_str string, daddr_str string, bytes_sent long, bytes_recv long, retransmits long, state_changes long, samples long, pid_mode long, uid_mode long, comm_mode string"
#: What windows-1252 has in the place of control characters.
CONTROLS = {chr(k): bytes([k]).decode("cp1252", "replace").replace("\ufffd", chr(k)) for k in range(0x80, 0xA0)}
LABEL_COLUMNS = ("Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Timestamp", "Label")


def _typed(rows: DataFrame) -> DataFrame:
    """Text columns as the connection's types: bad, blank and '-' numbers become 0."""
    return rows.select(*[F.col(c) if CONN_TYPES.get(c) == "string" else num(F.col(c), CONN_TYPES.get(c, "double")).alias(c) for c in CONN_FIELDS])


def read_conn_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with dotted keys or nested objects; bad lines are skipped."""
    flat = ", ".join(f"`{NESTED.get(c, c)}` string" for c in CONN_FIELDS)
    raw = spark.read.schema(f"{flat}, id struct<orig_h: string, resp_h: string, orig_p: string, resp_p: string>").option("mode", "DROPMALFORMED").json(path)
    pick = [F.coalesce(F.col(f"`{NESTED[c]}`"), F.col(f"id.{c}")).alias(c) if c in NESTED else F.col(c) for c in CONN_FIELDS]
    return _typed(raw.select(*pick))


def read_conn_tsv(spark: SparkSession, path: str) -> DataFrame:
    """TSV whose ``#fields`` line names the columns of its file; other lines with # are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.col("value").startswith("#fields")).groupBy("file").agg(F.min("value").alias("head"))  # one row per file
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).join(heads, "file")
    names = F.filter(F.split("head", "\t"), lambda _, k: k > 0)  # the first is #fields itself
    cells = F.split("value", "\t")
    at = lambda c: F.try_element_at(cells, F.nullif(F.array_position(names, NESTED.get(c, c)), F.lit(0)).cast("int"))
    return _typed(body.select(*[F.when(at(c) != "-", at(c)).alias(c) for c in CONN_FIELDS]))


def read_conn_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, without one, or with repeated ones."""
    return _typed(spark.read.schema(", ".join(f"{c} string" for c in CONN_FIELDS)).csv(path).where("ts is null or ts <> 'ts'"))


def detect_conn_format(spark: SparkSession, path: str) -> DataFrame:
    """(file, format) by the first line that is not blank."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    first = lines.groupBy("file").agg(F.trim(F.min_by("value", "n")).alias("line"))
    return first.select("file", F.when(F.col("line").startswith("{"), "json").when(F.col("line").startswith("#") | F.col("line").contains("\t"), "tsv").otherwise("csv").alias("format"))


def read_kernel_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_DDL).option("mode", "DROPMALFORMED").json(path)


def read_kernel_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow partials; the address text is preferred, the number is the fallback; rows without two valid addresses go."""
    raw = spark.read.schema(FLOW_DDL).option("mode", "DROPMALFORMED").json(path)
    out = raw.withColumns({c: F.coalesce(ipv4_to_u32(F.col(f"{c}_str")), F.col(c)) for c in ("saddr", "daddr")})
    return out.where("saddr is not null and daddr is not null")


def read_labels(spark: SparkSession, path: str, day: str) -> DataFrame:
    """All label files of a weekday. Every file's own header says where its columns are; headers are trimmed and the required columns checked.

    Bytes are read as UTF-8; a file that is not valid UTF-8 is read as windows-1252. Fields hold no line ends. Columns: those of LABEL_COLUMNS in lower case, and file."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" for c in day) + "*.csv"
    # The text source hands lines over as they are, so each file's own bytes can be judged.
    raw = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    lines = raw.select(F.col("value").cast("binary").alias("b"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    valid = F.try_validate_utf8(F.col("b").cast("string"))
    judged = lines.groupBy("path").agg(F.bool_and(valid.isNotNull()).alias("utf8"), F.min_by("b", F.struct("at", "n")).alias("head"))  # one row per file
    text = lambda c: F.when(F.col("utf8"), F.col(c).cast("string")).otherwise(F.translate(F.decode(c, "iso-8859-1"), "".join(CONTROLS), "".join(CONTROLS.values())))
    heads = judged.select("path", "utf8", F.regexp_replace(text("head"), "^\ufeff|\r$", "").alias("head"))
    # As wide as the widest header; commas inside quotes only make it wider.
    width = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or len(LABEL_COLUMNS)
    cells = lambda line: F.from_csv(line, F.lit(", ".join(f"c{k} string" for k in range(width))))
    named = heads.select("path", "utf8", F.transform(F.array(*[cells(F.col("head"))[f"c{k}"] for k in range(width)]), lambda x: F.trim(x)).alias("names"))
    lacking = named.select(F.array_except(F.array(*[F.lit(c) for c in LABEL_COLUMNS]), "names").alias("x")).where(F.size("x") > 0).first()
    if lacking:
        raise ValueError(f"label files lack {lacking['x']}")
    body = lines.join(F.broadcast(judged.select("path", F.struct("head", "utf8").alias("j"))), "path")  # files
    body = body.where(F.col("b") != F.col("j.head")).where(F.col("b").cast("string").rlike(r"\S")).select("path", "file", F.col("j.utf8").alias("utf8"), "b")
    parsed = body.join(F.broadcast(named.select("path", "names")), "path").withColumn("row", cells(F.regexp_replace(text("b"), "\r$", "")))
    values = F.array(*[F.col("row")[f"c{k}"] for k in range(width)])
    at = lambda c: F.trim(F.element_at(values, F.array_position("names", c).cast("int")))
    return parsed.select(*[at(c).alias(c.lower().replace(" ", "_")) for c in LABEL_COLUMNS], "file")


def infer_day(spark: SparkSession, run: str, recorded: str | None = None, override: str | None = None) -> str:
    """The weekday of a run's folder: the given one, else the one in the recorded capture's name, else that of the least name of a *.pcap file which has one, else of the first line that has one in the least named *.log file with such a line."""
    if override:
        return override
    named = spark.createDataFrame([(recorded,)], "p string").select(F.lit(0).alias("at"), day_from_path(F.col("p")).alias("d"))
    known = lambda df: df.where("d <> 'Unknown'").agg(F.min_by("d", "at")).first()[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(run).select(F.col("path").alias("at"), day_from_path(F.regexp_extract("path", "[^/]*$", 0)).alias("d"))
    lines = spark.read.option("pathGlobFilter", "*.log").text(run)
    logs = lines.select(F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), day_from_path(F.col("value")).alias("d"))
    for source in (named, files, logs):
        if day := known(source):
            return day
    raise ValueError(f"no weekday in the names and logs of {run}")


def read_conn(spark: SparkSession, path: str) -> DataFrame:
    """The connections of all files of a folder, each by the reader of its own format."""
    readers = {"json": read_conn_json, "tsv": read_conn_tsv, "csv": read_conn_csv}
    out = None
    for kind, reader in readers.items():
        # File names are metadata of a folder, not rows.
        files = [r["file"] for r in detect_conn_format(spark, path).where(F.col("format") == kind).select("file").collect()]
        if files:
            out = reader(spark, files) if out is None else out.unionByName(reader(spark, files))
    return out if out is not None else read_conn_csv(spark, path)


def bad_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, lines, bad): how many lines of each file are no JSON of this schema."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("x._bad").alias("bad"))


def flatten_struct(df: DataFrame, prefix: str = "run_") -> DataFrame:
    """Nested fields as a_b, lists as JSON text, all with the prefix."""

    def walk(schema: StructType, path: tuple[str, ...]) -> list:
        out = []
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, here)
            else:
                c = F.col(".".join(f"`{x}`" for x in here))
                out.append((F.to_json(c) if isinstance(f.dataType, ArrayType) else c).alias(prefix + "_".join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


MERGED = ("ts", "duration", "orig_h", "resp_h", "orig_p", "resp_p", "proto", "conn_state", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "start_ts", "end_ts", "ebpf_bytes_sent", "ebpf_bytes_recv", "ebpf_retransmits", "ebpf_state_changes", "ebpf_samples", "ebpf_pid", "ebpf_uid", "ebpf_comm")


def to_merged_layout(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in MERGED if c in df.columns], *[c for c in df.columns if c.startswith("run_")])


def combine_runs(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def load_split(spark: SparkSession, path: str, roles: tuple[str, ...]) -> DataFrame:
    """Rows of these roles of a table partitioned by split; other partitions are not read."""
    return spark.read.parquet(path).where(F.col("split").isin(*roles))


def write_scored(scored: DataFrame, path: str, checkpoint: str | None = None):
    """Appends scored events as JSON lines; a stream needs a checkpoint folder and gives back its query."""
    if scored.isStreaming:
        return scored.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    return scored.write.mode("append").json(path)


def read_scored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored scored events, for the dashboard's queries; bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """A small report (one row per step, class or fold) as one file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).format(kind).save(path)


def write_folds(df: DataFrame, folds: DataFrame, keys: list[str], path: str) -> None:
    """Every fold's test rows, by repeat and fold; the row table is joined once."""
    df.join(folds, keys).repartition("repeat", "fold", *keys).write.mode("errorifexists").partitionBy("repeat", "fold").parquet(path)
