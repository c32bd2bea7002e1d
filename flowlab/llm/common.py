"""What the operators share: table access and written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without that setting, a folder of this run."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-flowlab-")
    return "file://" + _own_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    return len(_made)


def drop_tables(spark: SparkSession, since: int) -> None:
    """Deletes the tables that ``written`` has made since there were ``since`` of them, the last one excepted. For callers that have nothing more to read of the others."""
    for path in _made[since:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[since:-1]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere the allocator's own ways do


def give_back() -> None:
    """Returns to the system what Arrow and the C heap keep of earlier batches."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, text_at: int, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of text: what a task holds of a batch is bounded but for single texts."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    begin = 0
    while begin < batch.num_rows:
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
        give_back()


_kept: list = []


def keeps_tables(make):
    """Caches what ``make`` returns in a Python worker, from task to task, until a task of an operator that does not need it begins there."""
    cached = lru_cache(maxsize=2)(make)
    _kept.append(cached)
    return cached


def release_tables() -> None:
    for cached in _kept:
        cached.cache_clear()


def map_texts(docs: DataFrame, id_col: str, text_col: str, fields: str, fn, keep: bool = False) -> DataFrame:
    """(id, fields) for every row, in one pass: ``fn`` takes a batch's texts (null: empty) and returns its columns, or
    (row of each output, columns). Ids pass as Arrow arrays, so nulls and large values stay as they are.
    ``keep``: tables of ``keeps_tables`` stay in the workers."""
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, {fields}"

    def run(batches):
        if not keep:
            release_tables()
        for batch in (part for b in batches for part in slices(b, 1)):
            got = fn(batch.column(1).to_pylist())
            ids = batch.column(0)
            if isinstance(got, tuple):
                ids, got = ids.take(pa.array(got[0], pa.int64())), got[1]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) if not isinstance(v, pa.Array) else v for v, t in zip(got, types, strict=True))], names=names)

    struct = StructType.fromDDL(out)
    arrow = to_arrow_schema(struct)
    names, types = arrow.names, [f.type for f in arrow][1:]
    return rows.mapInArrow(run, struct)
