"""Connected components of an edge list: alternating large-star and small-star rounds of joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every greater neighbour of a node points to the least of its neighbourhood; small: every smaller one, and the node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: longs) but the roots themselves: root is the least node of its component.

    Every round is written to the shared folder; a fixed point is reached after a number of rounds logarithmic in the
    components' size. Hot nodes pass through partial minima and through joins that can be split."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign
        now = written(_star(_star(now, True), False), "edges")
