"""Matching connections with kernel flows, and the aggregates around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TUPLE = ("saddr", "daddr", "sport", "dport", "proto")
#: The same columns of a connection, forward and reversed.
FORWARD = ("orig_h", "resp_h", "orig_p", "resp_p", "proto_num")
REVERSE = ("resp_h", "orig_h", "resp_p", "orig_p", "proto_num")


def attribute_bytes(events: DataFrame) -> DataFrame:
    """Counters of an event by its type: 1 state change, 2 sent, 3 received (positive sizes only), 4 retransmit, 5 packet (sent if outgoing)."""
    t, n, out = F.col("evtype"), F.col("bytes"), F.coalesce(F.col("outgoing"), F.lit(False)) if "outgoing" in events.columns else F.lit(False)
    keep = (t != 3) | (n > 0)
    sent = F.when((t == 2) | ((t == 5) & out), n).otherwise(0)
    received = F.when((t == 3) | ((t == 5) & ~out), n).otherwise(0)
    return events.where(keep).withColumns({"sent": sent, "received": received, "changes": (t == 1).cast("long"), "retrans": F.when(t == 4, F.lit(1)).otherwise(0).cast("long")})


def aggregate_events(events: DataFrame, window: Column, keys: tuple[str, ...] = TUPLE, at: str = "ts_us", order: tuple[str, ...] = ("ts_us",)) -> DataFrame:
    """Flow partials of a flush window: times, counters by type, number of events, and the last pid by arrival. Partial aggregates run before
    the shuffle, so a hot flow is one row per task."""
    last = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return attribute_bytes(events).groupBy(window.alias("flush"), *keys).agg(F.min(at).alias("first_us"), F.max(at).alias("last_us"), F.sum("sent").alias("bytes_sent"), F.sum("received").alias("bytes_recv"), F.sum("retrans").alias("retransmits"), F.sum("changes").alias("state_changes"), F.count(F.lit(1)).alias("samples"), F.max_by("pid", last).alias("pid"))


def rollup_partials(flows: DataFrame, keys: tuple[str, ...] = TUPLE) -> DataFrame:
    """The whole flow from its partials: counters added, times widened."""
    return flows.groupBy(*keys).agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("bytes_sent").alias("bytes_sent"), F.sum("bytes_recv").alias("bytes_recv"), F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("partials"))


def dedup_max(flows: DataFrame, order: Column, keys: tuple[str, ...] = TUPLE) -> DataFrame:
    """Per key the row that is greatest by ``order`` (a struct that no two rows share)."""
    return flows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in flows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def dedup_first(flows: DataFrame, order: Column, keys: tuple[str, ...] = TUPLE) -> DataFrame:
    return flows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in flows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def match(conn: DataFrame, flows: DataFrame, keys: tuple[str, ...] = TUPLE, best: Column | None = None) -> DataFrame:
    """Each connection with the flow of its 5-tuple, else of the reversed 5-tuple (counters as they are), else none.

    ``flows`` has one row per key, or ``best`` (a struct that no two rows of a key share) says which of a key's rows counts: the greatest. Adds ebpf_ columns and match_dir (fwd, rev, none). Both directions of a 5-tuple are one key, its ends in order, so flows and connections
    are shuffled once: a key's flows become one row with either direction's values, and one left join on columns brings them to the connections."""
    values = [c for c in flows.columns if c not in keys]
    ends = lambda a, b, p, q: (F.struct(F.col(a).alias("h"), F.col(p).cast("long").alias("p")), F.struct(F.col(b).alias("h"), F.col(q).cast("long").alias("p")))

    def keyed(df: DataFrame, a: str, b: str, p: str, q: str, proto: str) -> tuple[list[Column], Column]:
        x, y = ends(a, b, p, q)
        low, high = F.least(x, y), F.greatest(x, y)
        return [low["h"].alias("__h"), low["p"].alias("__p"), high["h"].alias("__g"), high["p"].alias("__q"), F.col(proto).alias("__t")], x <= y

    names = ["__h", "__p", "__g", "__q", "__t"]
    cols, way = keyed(flows, keys[0], keys[1], keys[2], keys[3], keys[4])
    complete = flows.where(" and ".join(f"`{k}` is not null" for k in keys))
    side = lambda is_way: F.max_by(F.struct(*values), F.when(F.col("__way") == is_way, F.col("__best")))
    both = complete.select(*cols, way.alias("__way"), (F.struct(*values) if best is None else best).alias("__best"), *values).groupBy(*names).agg(side(True).alias("__a"), side(False).alias("__b"))
    own, way = keyed(conn, FORWARD[0], FORWARD[1], FORWARD[2], FORWARD[3], FORWARD[4])
    whole = F.lit(True)
    for c in FORWARD:
        whole = whole & F.col(c).isNotNull()
    asked = conn.select(F.struct(*conn.columns).alias("__c"), *[F.when(whole, c).alias(n) for c, n in zip(own, names, strict=True)], way.alias("__way"))
    out = asked.join(both, names, "left").select("__c.*", F.when(F.col("__way"), F.col("__a")).otherwise(F.col("__b")).alias("fwd"), F.when(F.col("__way"), F.col("__b")).otherwise(F.col("__a")).alias("rev"))
    hit = F.coalesce("fwd", "rev")
    direction = F.when(F.col("fwd").isNotNull(), "fwd").when(F.col("rev").isNotNull(), "rev").otherwise("none")
    return out.select(*conn.columns, direction.alias("match_dir"), *[hit[v].alias(f"ebpf_{v}") for v in values])


def match_live(conn: DataFrame, flows: DataFrame, order: Column) -> DataFrame:
    return match(conn, flows, best=order)


def match_replay(conn: DataFrame, flows: DataFrame, order: Column) -> DataFrame:
    return match(conn, dedup_first(flows, order))


def in_window(matched: DataFrame, slop_us: int, on_miss: str = "drop") -> DataFrame:
    """Unmatched rows and those whose flow overlaps the connection, give or take the slop. A flow outside removes the row, or with
    ``on_miss='unmatch'`` its match."""
    good = F.col("ebpf_first_us").isNull() | ((F.col("ebpf_first_us") <= F.col("end_us") + slop_us) & (F.col("ebpf_last_us") >= F.col("start_us") - slop_us))
    if on_miss == "drop":
        return matched.where(good)
    return matched.select(*[F.when(good, F.col(c)).alias(c) if c.startswith("ebpf_") else F.when(good, F.col(c)).otherwise("none").alias(c) if c == "match_dir" else F.col(c) for c in matched.columns])


def match_interval(conn: DataFrame, flows: DataFrame, slop_us: int, bin_us: int = 600_000_000) -> DataFrame:
    """All partials of a connection's 5-tuple, either way round, that overlap it: (connection, partial) rows, inner.

    Both stand in every time bin that they touch, and meet in the first that they share, so a hot tuple is dealt by time and only neighbours are compared. Rows of
    which an interval ends before it begins match nothing."""
    bin_of = lambda c: F.floor(c / F.lit(bin_us)).cast("long")
    begin, end = F.col("start_us") - slop_us, F.col("end_us") + slop_us
    left = conn.where(begin <= end).withColumn("__b", F.explode(F.sequence(bin_of(begin), bin_of(end))))
    right = flows.where("first_us <= last_us").withColumn("__c", F.explode(F.sequence(bin_of(F.col("first_us")), bin_of(F.col("last_us")))))
    within = [F.col("__b") == F.col("__c"), F.col("first_us") <= end, F.col("last_us") >= begin, F.col("__b") == F.greatest(bin_of(begin), bin_of(F.col("first_us")))]
    both = [left.join(right, [F.col(c) == F.col(k) for c, k in zip(cols, TUPLE, strict=True)] + within).withColumn("match_dir", F.lit(name)) for name, cols in (("fwd", FORWARD), ("rev", REVERSE))]
    return both[0].unionByName(both[1]).drop("__b", "__c")


def replay_scenario(conn: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: spans, their ratio (the kernel's at least one second), and the scenario it means."""
    c = conn.agg(((F.max("end_us") - F.min("start_us")) / 1e6).alias("conn_span_s"))
    k = flows.agg(((F.max("last_us") - F.min("first_us")) / 1e6).alias("kernel_span_s"))
    ratio = F.col("conn_span_s") / F.greatest(F.col("kernel_span_s"), F.lit(1.0))
    name = F.when(F.col("ratio") > 500, "topspeed").when(F.col("ratio") > 100, "fast").when(F.col("ratio") > 10, "moderate").when(F.col("ratio") > 2, "realtime").otherwise("live")
    return c.crossJoin(F.broadcast(k)).withColumn("ratio", ratio).withColumn("scenario", name)  # one row each


def align_clocks(conn: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows moved so that the first one begins with the first connection."""
    shift = conn.agg(F.min("start_us").alias("c0")).crossJoin(F.broadcast(flows.agg(F.min("first_us").alias("k0")))).select((F.col("c0") - F.col("k0")).alias("shift_us"))
    moved = flows.crossJoin(F.broadcast(shift))  # one row
    return moved.withColumns({"first_us": F.col("first_us") + F.col("shift_us"), "last_us": F.col("last_us") + F.col("shift_us")})


def enrichment_stats(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hit = F.col("match_dir") != "none"
    total = F.count(F.lit(1))
    sent = F.coalesce(F.sum("ebpf_bytes_sent"), F.lit(0))
    return matched.groupBy(*by).agg(total.alias("total"), F.count_if(hit).alias("enriched"), F.count_if(hit & (F.col("ebpf_bytes_sent") > 0)).alias("with_data"), F.round(100.0 * F.count_if(hit) / total, 6).alias("enriched_pct"), sent.alias("bytes_sent"), F.coalesce(F.sum("ebpf_bytes_recv"), F.lit(0)).alias("bytes_recv"))


def occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A stable row identity: 60 bits of a hash of the natural key (null: empty) and the number of the occurrence, which other engines can repeat."""
    w = Window.partitionBy(*keys).orderBy(*order)
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.row_number().over(w).cast("string"))
    return df.withColumn("flow_id", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))


def newest_keys(flows: DataFrame, order: list[str], n: int = 50_000) -> DataFrame:
    """The flow cache's bound on a table: the n rows that are newest by ``order``, taken per task before they meet."""
    return flows.orderBy(*[F.desc(c) for c in order]).limit(n)
