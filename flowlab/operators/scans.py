"""Prefix sums, exact quantiles and sliding windows over groups of any size.

Rows are dealt into ranges by group and order, as many as their number asks for, and written once with the range's number. A window runs inside a range only; what it
needs of the ranges before (totals, the last rows) is a few rows per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.shared import written

#: Rows of a range.
PER_RANGE = 250_000


def in_ranges(rows: DataFrame, by: tuple[str, ...], order: list[Column], per_range: int = PER_RANGE) -> DataFrame:
    """The rows, written, with ``part``: ranges by (``by``, ``order``) in that order, of about ``per_range`` rows. Rows of equal keys share one."""
    rows = written(rows, "ranged")
    parts = -(-rows.count() // per_range)
    if parts <= 1:
        return rows.withColumn("part", F.lit(0))
    keyed = rows.repartitionByRange(parts, *[F.col(c) for c in by], *order)
    return written(keyed.withColumn("part", F.spark_partition_id()), "ranged")


def prefix_sums(counts: DataFrame, by: tuple[str, ...] = (), per_range: int = PER_RANGE) -> DataFrame:
    """Of counts (by, s, p, n; one row for each s of a group) tp, fp at or above every s, and pos, neg in all; also next_p, next_n of the next lower s (null at the least)."""
    ranged = in_ranges(counts, by, [F.desc("s")], per_range)
    inside = Window.partitionBy(*by, "part").orderBy(F.desc("s"))
    down = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy(*by, "part").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"), F.max_by(F.struct("p", "n"), "s").alias("first"))
    parts = Window.partitionBy(*by).orderBy("part")
    before, every = parts.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero = F.lit(0)
    offsets = totals.select(*by, "part", F.coalesce(F.sum("rp").over(before), zero).alias("op"), F.coalesce(F.sum("rn").over(before), zero).alias("on"), F.sum("rp").over(every).alias("pos"), F.sum("rn").over(every).alias("neg"), F.lead("first").over(parts).alias("after"))
    local = ranged.select(*by, "part", "s", "p", "n", F.sum("p").over(down).alias("lp"), F.sum("n").over(down).alias("ln"), F.lead(F.struct("p", "n")).over(inside).alias("near"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "part")]
    joined = local.alias("l").join(offsets.alias("o"), same)
    follows = F.coalesce("near", "after")
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in by], "s", "p", "n", (F.col("lp") + F.col("op")).alias("tp"), (F.col("ln") + F.col("on")).alias("fp"), "pos", "neg", follows["p"].alias("next_p"), follows["n"].alias("next_n"))


def percentiles(rows: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = (), per_range: int = PER_RANGE) -> DataFrame:
    """(by, n, q0, q1, ...): exact percentiles, linear between neighbours, of the values that are not null, for groups of any size: equal values are counted first, and the wanted
    ranks are found in the counts' prefix sums. Groups without values have null percentiles."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("p"), F.lit(0).cast("long").alias("n"))
    sums = prefix_sums(counts, by, per_range)
    aggs = []
    for k, q in enumerate(probs):
        at = (F.col("pos") - 1) * F.lit(float(q))
        covers = lambda rank: F.max(F.when((F.col("pos") - F.col("tp") <= rank) & (rank < F.col("pos") - F.col("tp") + F.col("p")), F.col("s")))
        part = F.max(at - F.floor(at))
        aggs.append(F.when(part == 0, covers(F.floor(at))).otherwise((1 - part) * covers(F.floor(at)) + part * covers(F.ceil(at))).alias(f"q{k}"))
    return sums.groupBy(*by).agg(F.max("pos").alias("n"), *aggs)


def trailing_rows(rows: DataFrame, by: list[str], order: list[str], keep: int, per_range: int = PER_RANGE) -> tuple[DataFrame, str]:
    """The rows and, in each range of a group, copies of the group's last ``keep`` rows before it, so that a window of ``keep`` rows and the current one sees in
    (by, part) what it would see in the group. Columns part and (second result) the name of the flag that copies have."""
    flag = "__copy"
    ranged = in_ranges(rows, tuple(by), [F.col(c) for c in order], per_range)
    own = Window.partitionBy(*by, "part")
    columns = [c for c in ranged.columns if c != "part"]
    last = ranged.withColumn("__r", F.row_number().over(own.orderBy(*[F.desc(c) for c in order]))).where(F.col("__r") <= keep).drop("__r")
    # Of the last rows of all earlier ranges the last ones are the group's: they stand before the first of these in each range.
    ahead = Window.partitionBy(*by).orderBy("part", *order)
    seen = last.withColumns({"__before": F.collect_list(F.struct(*columns)).over(ahead.rowsBetween(-keep, -1)), "__first": F.row_number().over(own.orderBy(*order))})
    copies = seen.where("__first = 1").select("part", F.explode("__before").alias("x")).select("x.*", "part").withColumn(flag, F.lit(True))
    return ranged.withColumn(flag, F.lit(False)).unionByName(copies), flag
