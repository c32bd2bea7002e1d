"""Growing append-only logs as a stream: each complete line once, while files grow, are cut off, replaced or rolled.

The stream's offset is, for every file, how many bytes of complete lines it has, and a digest of its first line, by which the file is known
again under another name. Each batch's new bytes are dealt to tasks in ranges; a task reads the lines that begin in its range. The offsets lie in the
stream's checkpoint, so a restarted stream goes on behind the last complete line that it has given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, at long"
BLOCK = 1 << 20  # bytes that are read at once


class Range(InputPartition):
    """The lines of a file that begin in [begin, end)."""

    def __init__(self, path: str, begin: int, end: int, first: bool, head: str) -> None:
        self.path, self.begin, self.end, self.first, self.head = path, begin, end, first, head


def _line_end(f, limit: int, block: int = BLOCK) -> int:
    """Behind the last line end before ``limit``, found from there backwards."""
    high = limit
    while high > 0:
        low = max(0, high - block)
        f.seek(low)
        at = f.read(high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return 0


def _head(f, limit: int) -> str:
    """A digest of the first line, of 64 KB at most; it stays when the file grows."""
    f.seek(0)
    return hashlib.md5(f.read(min(limit, 1 << 16)).split(b"\n", 1)[0]).hexdigest()


class GrowingLogReader(DataSourceStreamReader):
    """``path``: a folder; ``suffix``: of the names that are read; ``range_bytes``: bytes of a task."""

    def __init__(self, options: dict) -> None:
        self.files, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
        self.suffix, self.range_bytes = options.get("suffix", ""), int(options.get("range_bytes", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(self.suffix) and info.base_name[0] not in "._":
                with self.files.open_input_file(info.path) as f:
                    if end := _line_end(f, f.size()):
                        out[info.base_name] = {"end": end, "head": _head(f, end)}
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        gone = {o["head"]: o["end"] for name, o in start.items() if end.get(name, {}).get("head") != o["head"]}
        for name, now in sorted(end.items()):
            before = start.get(name)
            if before and before["head"] == now["head"]:
                begin = before["end"] if before["end"] <= now["end"] else 0  # shorter: it was cut off and written anew
            else:  # another file under this name: one that was rolled goes on where it was, all others are new
                begin = gone.get(now["head"], 0)
                begin = begin if begin <= now["end"] else 0
            for low in range(begin, now["end"], self.range_bytes):
                out.append(Range(f"{self.root}/{name}", low, min(now["end"], low + self.range_bytes), low == begin, now["head"]))
        return out or [Range("", 0, 0, True, "")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with self.files.open_input_file(partition.path) as f:
            if f.size() < partition.end or _head(f, f.size()) != partition.head:
                raise OSError(f"{partition.path} was cut off or replaced before its lines up to byte {partition.end} were read")
            at, rest, name = partition.begin, b"", partition.path.rsplit("/", 1)[-1]
            if not partition.first:  # a line that began before this range is the range's before
                f.seek(at - 1)
                while (lead := f.read(BLOCK)) and b"\n" not in lead:
                    at += len(lead)
                at += lead.find(b"\n")
            f.seek(at)
            while at < partition.end:
                data = f.read(BLOCK)
                rest += data
                lines = rest.split(b"\n")
                rest = lines.pop() if data else b""
                values, places = [], []
                for line in lines:
                    if at < partition.end and line.strip():
                        values.append(line.decode("utf-8", "replace").removesuffix("\r"))
                        places.append(at)
                    at += len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([name] * len(values)), pa.array(places, pa.int64())], names=["value", "file", "at"])
                if not data:
                    break


class GrowingLog(DataSource):
    """The format ``growing_log``: a stream of (value, file, at), the lines and the bytes they begin at."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(dict(self.options))


def stream_log(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = 32 << 20) -> DataFrame:
    """The lines (value, file, at) of a folder's growing files as a stream. Lines without an end wait for it; blank ones are left out; bytes that are no UTF-8
    become U+FFFD. A file is known by its first line: it goes on where it was under its own name or a new one, and is read from the
    start when it is shorter than before or begins otherwise. If it is cut off between a batch's planning and its reading, the batch
    fails, and a restarted stream fails with it until the checkpoint is given up: nothing is skipped silently."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("path", path).option("suffix", suffix).option("range_bytes", range_bytes).load()


def json_rows(lines: DataFrame, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The lines that are JSON objects of this schema, as rows; others are skipped. ``keep``: columns of the lines that stay."""
    parsed = lines.select(*keep, F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x")).where("x is not null and x._bad is null")
    return parsed.select(*keep, "x.*").drop("_bad")


def csv_rows(lines: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """The lines as text columns of these names; header lines, also repeated ones, are skipped."""
    parsed = lines.select(*keep, F.from_csv("value", F.lit(", ".join(f"`{f}` string" for f in fields))).alias("x"))
    return parsed.select(*keep, "x.*").where(F.coalesce(F.col(fields[0]) != fields[0], F.lit(True)))
