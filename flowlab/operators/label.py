"""Labelling flows from ground-truth logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a task that sorts.
SORTED = 250_000


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows dealt by their keys over as many tasks as keep each at ``SORTED``; fewer than the session's shuffles have are left to it."""
    parts = -(-n // SORTED)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def label_expand(labels: DataFrame) -> DataFrame:
    """Forward and reversed keys of every label, in one scan."""
    key = lambda a, b, c, d: F.concat_ws("|", *[F.col(x).cast("string") for x in (a, b, c, d, "proto_num")])
    both = F.array(F.struct(F.lit("fwd").alias("dir"), key("orig_h", "resp_h", "orig_p", "resp_p").alias("k")), F.struct(F.lit("rev").alias("dir"), key("resp_h", "orig_h", "resp_p", "orig_p").alias("k")))
    return labels.withColumn("__e", F.explode(both)).select("*", "__e.dir", "__e.k").drop("__e")


def dedup_label(labels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One label per key: an attack before a benign one, then by family name. An aggregate, so a hot key is one row per task."""
    return labels.groupBy(*keys).agg(F.min_by(F.struct("label_family", "is_attack"), F.struct(-F.col("is_attack"), F.col("label_family"))).alias("r")).select(*keys, "r.*")


def asof_nearest(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, tolerance: int, right_order: str, values: list[str], left_id: str) -> DataFrame:
    """Each left row with the nearest right row of its key within the tolerance (inclusive): m_time and m_values, null if there is none.

    Ties go to the earlier one; of equal times the last by ``right_order``. Times are dealt into bins as wide as the tolerance and a right
    row stands in its own and both neighbouring bins, so a window holds a key's rows of one bin, never a whole hot key."""
    width = max(1, tolerance)
    bin_of = lambda t: F.floor(F.col(t) / F.lit(width)).cast("long")
    payload = F.struct(F.col(right_time).alias("t"), *[F.col(v).alias(f"v_{v}") for v in values])
    cols = left.columns
    probes = left.select(F.col(by).alias("__k"), bin_of(left_time).alias("__b"), F.col(left_time).alias("__t"), F.lit(1).alias("__probe"), F.lit(None).cast("long").alias("__o"), F.struct(*cols).alias("__l"))
    near = F.explode(F.array(*[bin_of(right_time) + d for d in (-1, 0, 1)]))
    events = right.where(F.col(right_time).isNotNull()).select(F.col(by).alias("__k"), near.alias("__b"), F.col(right_time).alias("__t"), F.lit(0).alias("__probe"), F.col(right_order).cast("long").alias("__o"), payload.alias("__m"))
    n = left.count() + 3 * right.count()
    all_rows = spread(probes.unionByName(events, allowMissingColumns=True), n, "__k", "__b")
    part = Window.partitionBy("__k", "__b")
    back = part.orderBy("__t", "__probe", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Forward: the last of the rows with the next time, hence descending time, ascending order, read from behind.
    ahead = part.orderBy(F.desc("__t"), F.desc("__probe"), F.asc("__o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = all_rows.withColumn("__p", F.last("__m", ignorenulls=True).over(back)).withColumn("__n", F.last("__m", ignorenulls=True).over(ahead)).where("__probe = 1")
    dp, dn = F.col("__t") - F.col("__p.t"), F.col("__n.t") - F.col("__t")
    fit_p, fit_n = F.coalesce(dp <= tolerance, F.lit(False)), F.coalesce(dn <= tolerance, F.lit(False))
    best = F.when(fit_p & (~fit_n | (dp <= dn)), F.col("__p")).when(fit_n, F.col("__n"))
    return seen.withColumn("__best", best).select("__l.*", F.col("__best.t").alias("m_time"), *[F.col(f"__best.v_{v}").alias(f"m_{v}") for v in values])


def rank_of(family: Column) -> Column:
    return F.when(family.isNull() | (family == "Unknown"), 0).when(family == "BENIGN", 2).otherwise(3)


def label_two_pass(flows: DataFrame, labels: DataFrame, by: str, tolerance: int, flow_id: str = "flow_id", start: str = "start_us", end: str = "end_us", label_time: str = "ts_us", label_order: str = "label_id", offset: Column | int = 0) -> DataFrame:
    """(flow_id, label_family): the nearest label at the flow's start, or the one at its end where that ranks strictly better
    (none < benign < attack). Both probes of a flow share one pass."""
    off = offset if isinstance(offset, Column) else F.lit(offset)
    probes = flows.select(flow_id, by, F.explode(F.array(F.struct(F.lit(0).alias("pass"), (F.col(start) - off).alias("at")), F.struct(F.lit(1).alias("pass"), (F.col(end) - off).alias("at")))).alias("p")).select(flow_id, by, "p.pass", "p.at")
    got = asof_nearest(probes, labels, by, "at", label_time, tolerance, label_order, ["label_family"], flow_id)
    ranked = F.struct(rank_of(F.col("m_label_family")).alias("r"), (-F.col("pass")).alias("first"), F.col("m_label_family"))
    return spread(got, 2 * flows.count(), flow_id).groupBy(flow_id).agg(F.max(ranked).alias("b")).select(flow_id, F.coalesce("b.m_label_family", F.lit("Unknown")).alias("label_family"))


def label_offset(run: DataFrame, labels: DataFrame, start: str = "start_us", label_time: str = "ts_us") -> DataFrame:
    """One row: whole seconds between the first flow and the first label, rounded half to even."""
    return run.agg(F.min(start).alias("a")).crossJoin(F.broadcast(labels.agg(F.min(label_time).alias("b")))).select(F.bround((F.col("a") - F.col("b")) / 1e6).cast("long").alias("offset_s"))


def choose_shift(flows: DataFrame, labels: DataFrame, by: str, tolerance: int, mode: str = "reported", half_day_us: int = 43_200_000_000) -> DataFrame:
    """(shift_s, ord, attacks, known, overlap_us, chosen) of the three half-day candidates; the best is the greatest by (attacks, known, overlap), the first
    candidate winning ties. In mode ``reported`` the shift cancels out of the alignment and moves only the overlap; in mode ``effective`` it moves the labels."""
    spans = flows.agg(F.min("start_us").alias("f0"), F.max("end_us").alias("f1")).crossJoin(F.broadcast(labels.agg(F.min("ts_us").alias("l0"), F.max("ts_us").alias("l1"))))
    count = lambda got: got.agg(F.count_if(~F.col("label_family").isin("Unknown", "BENIGN")).alias("attacks"), F.count_if(F.col("label_family") != "Unknown").alias("known"))
    out, same = None, count(label_two_pass(flows, labels, by, tolerance)) if mode != "effective" else None  # one plan, which its three uses share
    for k, shift in enumerate((0, half_day_us, -half_day_us)):
        counts = same if same is not None else count(label_two_pass(flows, labels.withColumn("ts_us", F.col("ts_us") + shift), by, tolerance))
        overlap = F.greatest(F.lit(0), F.least("f1", F.col("l1") + shift) - F.greatest("f0", F.col("l0") + shift))
        row = counts.crossJoin(F.broadcast(spans)).select(F.lit(shift // 1_000_000).cast("long").alias("shift_s"), F.lit(k).alias("ord"), "attacks", "known", overlap.cast("long").alias("overlap_us"))
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.max(F.struct("attacks", "known", "overlap_us", -F.col("ord"))).alias("b")).select((-F.col("b.col4")).alias("__ord"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("ord") == F.col("__ord")).drop("__ord")


def label_stats(labelled: DataFrame) -> DataFrame:
    known = F.count_if(F.coalesce(F.col("label_family"), F.lit("Unknown")) != "Unknown")
    attacks = F.count_if(~F.coalesce(F.col("label_family"), F.lit("Unknown")).isin("Unknown", "BENIGN"))
    return labelled.agg(F.count(F.lit(1)).alias("total"), known.alias("known"), attacks.alias("attacks"), F.round(100.0 * attacks / F.count(F.lit(1)), 6).alias("attack_pct"))


def parse_ts_vote(df: DataFrame, col: str, by: str) -> DataFrame:
    """Adds ts: the text read day first or month first, whichever parses more rows of a file (a tie: day first).
    The votes are a row per file and go to the rows, so a file's rows never meet in one task."""
    read = lambda order: F.coalesce(*[F.try_to_timestamp(F.trim(F.col(col)), F.lit(f"{order} H:m{s}")) for s in (":s", "")])
    both = df.withColumn("__d", read("d/M/y")).withColumn("__m", read("M/d/y"))
    votes = both.groupBy(by).agg((F.count("__m") > F.count("__d")).alias("__month"))
    return both.join(F.broadcast(votes), by).withColumn("ts", F.when(F.col("__month"), F.col("__m")).otherwise(F.col("__d"))).drop("__d", "__m", "__month")


def fix_hours(df: DataFrame, by: str, ts: str = "ts", share: float = 0.03) -> DataFrame:
    """Twelve hours more for all rows of an afternoon file whose median hour is before noon, and for hours 1 to 6 of a working-hours
    file of which at least ``share`` have such an hour."""
    early = F.hour(ts).between(1, 6)
    seen = df.groupBy(by).agg(F.percentile(F.hour(ts), 0.5).alias("__median"), F.avg(early.cast("double")).alias("__early"))
    name = F.lower(F.col(by))
    add = (name.contains("afternoon") & (F.col("__median") < 12)) | (name.contains("workinghours") & early & (F.col("__early") >= share))
    return df.join(F.broadcast(seen), by).withColumn(ts, F.when(add, F.col(ts) + F.expr("interval 12 hours")).otherwise(F.col(ts))).drop("__median", "__early")
