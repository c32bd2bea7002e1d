"""The flow operators on streams: flush-window partials and enrichment by a range join."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlab.operators.enrich import FORWARD, REVERSE, TUPLE, aggregate_events
from flowlab.streaming import counters


def stream_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of rolled JSON files as a stream; bad lines are skipped. Files must be complete when they appear."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def flow_partials(events: DataFrame, time: str = "ts", flush: str = "5 seconds", delay: str = "5 seconds") -> DataFrame:
    """Flow partials per flush window; on a stream, events later than the watermark are dropped and counted by Spark."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return aggregate_events(rows, F.window(time, flush), at="ts_us", order=("ts_us", "event_id"))


def stream_enrich(conn: DataFrame, flows: DataFrame, slop_s: int = 10, delay: str = "10 seconds", longest_s: int = 120) -> DataFrame:
    """Connections (conn_id, start, end) with the best of the flows (first, last) that overlap them, either way round; left semantics.

    Flows stand twice, forward and reversed. The joined rows of a connection are reduced to its best (forward first, then most samples) by
    an aggregate on the connection and its time; watermarks are declared at the sources only. A connection without a flow comes out once the
    watermark has passed it.

    A stream must forget: there, a flow that ends over ``longest_s`` plus the slop after the connection's start is not matched, so ``longest_s`` is to be the
    longest connection, at the price of as much state. Tables have no such limit; a pass over the stored rows with this function is exact for longer ones."""
    lag = F.expr(f"interval {slop_s} seconds")
    side = lambda rank, cols: F.struct(F.lit(rank).alias("rank"), *[F.col(dict(zip(cols, TUPLE, strict=True))[c]).cast("string").alias(f"k_{c}") for c in FORWARD])
    both = F.explode(F.array(side(1, FORWARD), side(0, REVERSE)))
    right = flows.withWatermark("last", delay).withColumn("d", both).select("d.*", "first", "last", "samples", "bytes_sent", "bytes_recv")
    left = conn.withWatermark("start", delay)
    on = [F.col(c).cast("string") == F.col(f"k_{c}") for c in FORWARD] + [F.col("last") >= F.col("start") - lag, F.col("first") <= F.col("end") + lag]
    if conn.isStreaming or flows.isStreaming:
        on.append(F.col("last") <= F.col("start") + F.expr(f"interval {longest_s} seconds") + lag)
    joined = left.join(right, on, "leftOuter")
    best = F.max_by(F.struct("rank", "samples", "bytes_sent", "bytes_recv"), F.struct(F.coalesce("rank", F.lit(-1)), F.coalesce("samples", F.lit(-1)), F.coalesce("bytes_sent", F.lit(-1))))
    return joined.groupBy("conn_id", "start").agg(best.alias("b")).select("conn_id", "start", F.when(F.col("b.rank") == 1, "fwd").when(F.col("b.rank") == 0, "rev").otherwise("none").alias("match_dir"), "b.samples", "b.bytes_sent", "b.bytes_recv")


def with_final_pass(streamed: DataFrame, whole: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What a last pass over the stored history gives (the same function on tables), which stands for what the stream gave of the same keys, right or wrong;
    of other keys the stream's rows stay. One anti-join on the keys."""
    return whole.unionByName(streamed.join(whole.select(*keys).distinct(), list(keys), "left_anti"))


def run_to_end(out: DataFrame, path: str, state: str) -> dict[str, int]:
    """Appends what a stream gives over what there is, and returns this run's counters: the sums over all its micro-batches of what ``observe`` counted on the way (as
    observation.column), and late, the rows that came after their watermark. ``counters.totals`` has those of all runs with this checkpoint."""
    counts = counters.totals(out.sparkSession, state, counters.run_counted(out, path, state))
    return {"late": counts.pop("late", 0), **{k: v for k, v in counts.items() if k != "input"}}


CACHED = ("samples", "last_us", "part_id", "first_us", "bytes_sent", "bytes_recv")


def flow_state(flows: DataFrame, ttl_s: int = 3600, delay: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """The flow cache on a stream: per 5-tuple the partial with most samples (then the latest), given out when it changes (``expired`` false)
    and once more when event time has passed its last packet by ``ttl_s`` (``expired`` true), after which it is forgotten. The expiry per key bounds
    the state where a batch keeps the newest keys. Keys lie in ``buckets`` by their hash, a bucket's as one table, so a call of Python serves many of them."""
    rows = flows.withColumn("at", F.timestamp_micros("last_us")).withWatermark("at", delay).withColumn("bucket", F.pmod(F.xxhash64(*TUPLE), F.lit(buckets)))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in flows.select(*TUPLE).schema)}, {', '.join(f'{c} long' for c in CACHED)}, expired boolean"
    columns = [*TUPLE, *CACHED]

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = pickle.loads(state.get[0]) if state.exists else None  # noqa: S301 (our own state)
        if state.hasTimedOut:
            due = have["last_us"] // 1000 + ttl_s * 1000 < state.getCurrentWatermarkMs()
            yield have[due].assign(expired=True)
            have = have[~due]
        else:
            parts = [f[columns].assign(fresh=True) for f in frames]
            every = pd.concat(([] if have is None else [have.assign(fresh=False)]) + parts, ignore_index=True)
            # Of a key's rows the greatest; an equal one that was there before stays, as nothing has changed.
            best = every.sort_values([*CACHED, "fresh"], ascending=[False] * len(CACHED) + [True]).drop_duplicates(TUPLE)
            have = best[columns]
            yield best.loc[best["fresh"], columns].assign(expired=False)
        if len(have):
            state.update((pickle.dumps(have),))
            state.setTimeoutTimestamp(max(int(have["last_us"].min()) // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()

    grouped = rows.select("bucket", *TUPLE, *CACHED, "at").groupBy("bucket")
    return grouped.applyInPandasWithState(keep, schema, "cache binary", "append", GroupStateTimeout.EventTimeTimeout)
