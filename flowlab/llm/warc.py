"""WARC archives: writing captures with revisits, reading records back, and assembling transactions.

A capture is three records: a response (or a revisit of an earlier response with the same payload), and a request and a metadata
record that name the first by WARC-Concurrent-To. Files are WARC/1.1 with one gzip member per record, so readers can seek to single
records. Spark's text sink writes them, committed: a row is the bytes of one archive, and what the sink puts after a row is an empty
gzip member. They are read as binary files and streamed record by record by their content lengths, so payloads may hold any bytes
and no task holds more than an archive's compressed bytes and one record.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

END = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # fixed: archives of the same rows are the same
LEAST_REVISIT = 100  # bytes from which an equal payload is recorded as a revisit
ARCHIVE = 8_000_000  # compressed bytes after which an archive is closed; a larger record makes one of its own
NO_MEMBER = gzip.compress(b"", mtime=0)
RECORD = StructType([StructField(name, StringType()) for name in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest", "header")] + [StructField("payload", BinaryType())])
FIELDS = {"warc-type": 0, "warc-record-id": 1, "warc-concurrent-to": 2, "warc-refers-to": 3, "warc-target-uri": 4, "warc-payload-digest": 5}


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The pages (id, seq, payload, ...) with digest (hex SHA-256), n_bytes and first: the (none, id, seq) of the response that a
    revisit repeats, null for responses. Of equal payloads the least (id, seq) is the response, null ids last.

    Digests are aggregated before the shuffle, and only repeated ones reach the join, which may be split."""
    sized = pages.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "seq")
    firsts = sized.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return sized.join(firsts, "digest", "left").withColumn("first", F.when(~F.col("first").eqNullSafe(own), F.col("first")))


def _urn(kind: str, page: Column, seq: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), seq.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, content_type: str, block: Column, **more: Column) -> Column:
    """A record without the separator that follows it. Lines with a null value are left out."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    head = [line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri)]
    extra = [line("WARC-" + n.replace("_", "-"), v) for n, v in more.items()]
    return F.concat(F.lit("WARC/1.1" + END), *head, *extra, line("Content-Type", F.lit(content_type)), line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One column ``value``: the three records of every row. Null payloads are empty, null ids have no page-id field, null URLs no target; line ends in
    URLs become %0D and %0A; repeated rows are captures of their own, told apart by the row's number in the scan. Other columns are not read. An
    empty table gives no records."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    planned = plan_revisits(rows.withColumn("seq", F.monotonically_increasing_id()))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = _urn("response", F.col("id"), F.col("seq"))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END + END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    main = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), own, uri, "application/http; msgtype=response", block,
        Payload_Digest=F.concat(F.lit("sha256:"), F.col("digest")),
        Refers_To=F.when(revisit, _urn("response", F.col("first.id"), F.col("first.seq"))),
        Profile=F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}"))
    request = _record(F.lit("request"), _urn("request", F.col("id"), F.col("seq")), uri, "application/http; msgtype=request", asked, Concurrent_To=own)
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(END)), F.lit(END))
    metadata = _record(F.lit("metadata"), _urn("metadata", F.col("id"), F.col("seq")), uri, "application/warc-fields", fields, Concurrent_To=own)
    return planned.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write_warc(records: DataFrame, path: str, archive: int = ARCHIVE) -> None:
    """Archives of about ``archive`` compressed bytes, one gzip member per record, by Spark's committed text output. No records: an empty folder."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                members.append(gzip.compress(record.as_py(), 6, mtime=0))
                size += len(members[-1])
                if size >= archive:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    closed = records.select(F.concat("value", F.lit(END + END)).cast("binary").alias("value")).mapInArrow(archives, "value binary")
    # Cast without a check of the bytes; the sink writes them as they are, one row a file.
    out = closed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    out.option("lineSep", NO_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def parse_warc(archive: BinaryIO) -> Iterator[tuple]:
    """The records of an archive, as in RECORD. Requests and responses are cut into HTTP header and payload."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            continue  # the line ends that close a record
        row: list = [None] * 8
        length = 0
        while (line := archive.readline()).strip():
            name, _, value = line.partition(b":")
            key, text = name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace")
            if key == "content-length":
                length = int(text)
            elif key in FIELDS:
                row[FIELDS[key]] = text
        block = archive.read(length)
        if row[0] in ("response", "revisit", "request"):
            top, _, body = block.partition(b"\r\n\r\n")
            row[6], row[7] = top.decode("utf-8", "replace"), body
        else:
            row[7] = block
        yield tuple(row)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` (schema RECORD), with or without gzip. One archive is streamed at a time."""
    schema = to_arrow_schema(RECORD)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                data = io.BytesIO(raw.as_py())
                rows, size = [], 0
                for row in parse_warc(gzip.GzipFile(fileobj=data) if data.getbuffer()[:2] == b"\x1f\x8b" else data):
                    rows.append(row)
                    size += len(row[7] or b"")
                    if size > 4_000_000:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (of type response or revisit), request, metadata, n_requests, n_metadata.

    ``records`` needs record_type, record_id and concurrent_to; what else it has goes into the structs. Of several requests or metadata
    records of one capture the one with the least id stands in the row and the count tells; a capture without one has a
    null there. Records that name no known capture are left out.
    """
    columns = ["record_id", *[c for c in records.columns if c != "record_id"]]
    main = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*columns).alias("response"))

    def beside(kind: str, count: str) -> DataFrame:
        rows = records.where(F.col("record_type") == kind).where(F.col("concurrent_to").isNotNull())
        return rows.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct(*columns)).alias(kind), F.count(F.lit(1)).alias(count))

    out = main.join(beside("request", "n_requests"), "capture_id", "left").join(beside("metadata", "n_metadata"), "capture_id", "left")
    return out.fillna(0, ["n_requests", "n_metadata"])


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """The captures with ``original``: the capture (capture_id, response, metadata) that a revisit refers to, null for others."""
    firsts = captures.where(F.col("response.record_type") == "response").select(F.col("capture_id").alias("__first"), F.struct("capture_id", "response", "metadata").alias("original"))
    plain = captures.where(F.col("response.refers_to").isNull()).withColumn("original", F.lit(None).cast(firsts.schema["original"].dataType))
    again = captures.where(F.col("response.refers_to").isNotNull()).join(firsts, F.col("response.refers_to") == F.col("__first"), "left").drop("__first")
    return plain.unionByName(again)
