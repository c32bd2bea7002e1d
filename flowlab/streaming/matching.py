"""Connections matched with kernel flows on a stream, exactly as on tables, with state that event time bounds.

Rows of both kinds meet by their 5-tuple, taken without direction. A connection waits until no flow that overlaps it can come any more, which is when the watermark has
passed its end and the slop, and a flow is kept until no connection that it overlaps can come, its end and the slop: a timer says so, and no longest duration is
assumed. The event time of both is their start.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlab.operators.enrich import FORWARD, TUPLE

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with that state store, for the streams that are begun inside."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


OUT = "conn_id long, start_us long, match_dir string, samples long, bytes_sent long, bytes_recv long"


CONNS = ["key", "way", "conn_id", "start_us", "end_us", "matched", "same", "samples", "bytes_sent", "bytes_recv"]
FLOWS = ["key", "way", "start_us", "end_us", "samples", "bytes_sent", "bytes_recv"]
#: Pairs of a connection and a flow that are compared at once.
PAIRS = 1 << 20


def _meet(conns: pd.DataFrame, flows: pd.DataFrame, slop: int) -> pd.DataFrame:
    """The connections with the greatest (same direction, samples, sent, received) of the flows of their key that overlap them and of what they had. Flows stand in the order of
    key and start, so a connection's lie in one range: it begins where the latest end so far reaches the connection, and ends with the last that starts in time."""
    if not len(conns) or not len(flows):
        return conns
    flows = flows.sort_values(["key", "start_us"], ignore_index=True)
    names = pd.Index(flows["key"].unique())
    code, own = names.get_indexer(flows["key"]), names.get_indexer(conns["key"])
    first, last = flows["start_us"].to_numpy(), flows["end_us"].to_numpy()
    reach = flows.groupby("key", sort=False)["end_us"].cummax().to_numpy()
    late, soon = (conns["end_us"] + slop).to_numpy(), (conns["start_us"] - slop).to_numpy()
    times = np.unique(np.concatenate([first, reach, late, soon]))
    place = lambda c, t: c.astype(np.int64) * len(times) + np.searchsorted(times, t)
    low, high = np.searchsorted(place(code, reach), place(own, soon)), np.searchsorted(place(code, first), place(own, late), "right")
    count = np.where(own < 0, 0, np.maximum(0, high - low))
    values = ["matched", "same", "samples", "bytes_sent", "bytes_recv"]
    best = conns[values].to_numpy(np.int64).copy()
    counts, way, other = flows[values[2:]].to_numpy(np.int64), conns["way"].to_numpy(bool), flows["way"].to_numpy(bool)
    total = np.concatenate([[0], np.cumsum(count)])
    for begin in range(0, int(total[-1]), PAIRS):
        pair = np.arange(begin, min(begin + PAIRS, int(total[-1])))
        i = np.searchsorted(total, pair, "right") - 1
        j = low[i] + pair - total[i]
        meets = (last[j] >= soon[i]) & (first[j] <= late[i])
        i, j = i[meets], j[meets]
        found = np.column_stack([np.ones(len(i), np.int64), way[i] == other[j], counts[j]])
        touched = np.unique(i)
        every, at = np.concatenate([best[touched], found]), np.concatenate([touched, i])
        order = np.lexsort((*every.T[::-1], at))
        top = order[np.flatnonzero(np.diff(at[order], append=-1))]
        best[at[top]] = every[top]
    return conns.assign(**dict(zip(values, best.T, strict=True)))


class Matcher(StatefulProcessor):
    """State of a bucket of keys: its waiting connections with what they have met, and its flows, as two tables. One timer a bucket, for the first of them whose time is over."""

    def __init__(self, slop_us: int) -> None:
        self.slop = slop_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rows", "rows binary")

    def _load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        return pickle.loads(self.state.get()[0]) if self.state.exists() else (pd.DataFrame(columns=CONNS), pd.DataFrame(columns=FLOWS))  # noqa: S301 (our own state)

    def _over(self, rows: pd.DataFrame) -> pd.Series:
        return (rows["end_us"] + self.slop) // 1000 + 1

    def _keep(self, conns: pd.DataFrame, flows: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer))
        if not len(conns) and not len(flows):
            self.state.clear()
            return
        self.state.update((pickle.dumps((conns, flows)),))
        self.handle.registerTimer(int(min(self._over(x).min() for x in (conns, flows) if len(x))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        conns, flows = self._load()
        new = pd.concat(list(rows), ignore_index=True)
        now = new[new["is_conn"]].assign(matched=0, same=0)[CONNS]
        came = new[~new["is_conn"].astype(bool)][FLOWS]
        join = lambda a, b: pd.concat([x for x in (a, b) if len(x)] or [a], ignore_index=True)
        conns, every = _meet(conns, came, self.slop), join(flows, came)
        self._keep(join(conns, _meet(now, every, self.slop)), every)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        conns, flows = self._load()
        if len(conns) or len(flows):
            over = self._over(conns) <= mark
            done = conns[over]
            self._keep(conns[~over], flows[self._over(flows) > mark])
            if len(done):
                met = done["matched"].astype(bool)
                counts = {c: done[c].astype("Int64").where(met) for c in ("samples", "bytes_sent", "bytes_recv")}
                way = np.where(met, np.where(done["same"].astype(bool), "fwd", "rev"), "none")
                yield pd.DataFrame({"conn_id": done["conn_id"].astype("int64"), "start_us": done["start_us"].astype("int64"), "match_dir": way, **counts})

    def close(self) -> None: ...


def _side(rows: DataFrame, columns: tuple[str, ...], is_conn: bool, start: str, end: str, values: dict[str, Column], delay: str) -> DataFrame:
    """Rows of a side with the 5-tuple's ends in order, and ``way``: whether they are as given."""
    a, b = (F.struct(*[F.col(c).cast("string") for c in pair]) for pair in ((columns[0], columns[2]), (columns[1], columns[3])))
    way = a <= b
    ends = F.to_json(F.struct(F.when(way, a).otherwise(b).alias("a"), F.when(way, b).otherwise(a).alias("b"), F.col(columns[4]).cast("string").alias("p")))
    shown = rows.select(ends.alias("key"), way.alias("way"), F.lit(is_conn).alias("is_conn"), F.unix_micros(start).alias("start_us"), F.unix_micros(end).alias("end_us"), *[v.cast("long").alias(n) for n, v in values.items()], F.col(start).cast("timestamp").alias("at"))
    return shown.withWatermark("at", delay)


def stream_match(conn: DataFrame, flows: DataFrame, slop_s: int = 10, delay: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """Connections (conn_id, start, end) with the best of the flows (first, last, samples, ...) that overlap them give or take the slop, either way round (forward first, then
    most samples, bytes sent and received), ``none`` without any: (conn_id, start_us, match_dir, samples, bytes_sent, bytes_recv).

    ``delay``: how long after its start a row may come and still count; rows behind the watermark are dropped and counted by Spark. A connection comes out when the watermark
    passes its end and the slop. Keys lie in ``buckets`` by their hash, each a call of Python. Rows with a null in the 5-tuple are keys like others. Needs the RocksDB state store (``STATE_STORE``)."""
    none = F.lit(0)
    both = _side(conn, FORWARD, True, "start", "end", {"conn_id": F.col("conn_id"), "samples": none, "bytes_sent": none, "bytes_recv": none}, delay)
    both = both.union(_side(flows, TUPLE, False, "first", "last", {"conn_id": none, **{c: F.col(c) for c in ("samples", "bytes_sent", "bytes_recv")}}, delay))
    both = both.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return both.groupBy("bucket").transformWithStateInPandas(Matcher(slop_s * 1_000_000), OUT, "Append", "EventTime")
