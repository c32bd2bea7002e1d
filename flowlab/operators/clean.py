"""Filters that say what they dropped, event forms, and columns that tell where rows come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions import byteswap32, ipv4_to_u32, proto_name, u32_to_ipv4
from flowlab.sources import flatten_struct


def valid_addresses(src: str = "orig_h", dst: str = "resp_h") -> Column:
    """Both addresses are dotted IPv4."""
    return ipv4_to_u32(F.col(src)).isNotNull() & ipv4_to_u32(F.col(dst)).isNotNull()


def known_label(label: str = "label_family") -> Column:
    """Any label but Unknown, in whatever case; a null label is none."""
    return F.col(label).isNotNull() & (F.lower(F.trim(F.col(label))) != "unknown")


def complete(*cols: str) -> Column:
    """None of the columns is null, and no text among them blank."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return out


def tcp_or_udp(proto: str = "proto_num") -> Column:
    return F.col(proto).isin(6, 17)


def ready(ts_s: str, now_s: Column | float, flush_s: float = 5.0) -> Column:
    """Older than a flush period at ``now_s``: by then the kernel's partials of the row are written. A time that is no number counts as 0."""
    return F.coalesce(F.col(ts_s).cast("double"), F.lit(0.0)) <= (now_s if isinstance(now_s, Column) else F.lit(now_s)) - F.lit(flush_s)


def keep(rows: DataFrame, good: Column, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows for which ``good`` holds (null: not), and (rows, dropped) in one row. On a stream the counts come with its progress, observed under ``name`` in
    the same pass, and the second is None."""
    holds = F.coalesce(good, F.lit(False))
    counts = (F.count(F.lit(1)).alias("rows"), F.count_if(~holds).alias("dropped"))
    if rows.isStreaming:
        return rows.observe(name, *counts).where(holds), None
    return rows.where(holds), rows.agg(*counts)


def drop_counts(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(filter, rows, dropped), each filter on its own, from one pass."""
    cells = [F.struct(F.lit(n).alias("filter"), F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(c, F.lit(False))).alias("dropped")) for n, c in filters.items()]
    return rows.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _first_of(df: DataFrame, names: tuple[str, ...], kind: str, empty: tuple[str, ...] = ("",)) -> Column:
    """The first of the columns that is there and holds something."""
    have = [F.when(~F.col(n).cast("string").isin(*empty), F.col(n).cast("string")) for n in names if n in df.columns]
    return (F.coalesce(*have) if have else F.lit(None)).cast(kind)


def normalise_event(df: DataFrame) -> DataFrame:
    """Adds or mends the columns that the dashboard's queries use: time (HH:MM:SS in the session's zone), src_ip, dst_ip, src_port, dst_port, exe, pid, proto.

    A column that is there already stays; else it is the first alias that holds something. An exe of "nan" or "none" is empty. Protocols are names: numbers become
    TCP, UDP, ICMP or their digits, no protocol is TCP."""
    out = df
    if "time" not in df.columns:
        out = out.withColumn("time", F.date_format(F.timestamp_seconds(F.col("ts_s").try_cast("double")), "HH:mm:ss") if "ts_s" in df.columns else F.lit(None).cast("string"))
    for name, aliases, missing in (("src_ip", ("saddr_str", "saddr"), "?"), ("dst_ip", ("daddr_str", "daddr"), "?"), ("src_port", ("sport",), "?"), ("dst_port", ("dport",), "?")):
        if name not in df.columns:
            out = out.withColumn(name, F.coalesce(_first_of(df, aliases, "string"), F.lit(missing)))
    exe = F.col("exe") if "exe" in df.columns else _first_of(df, ("comm", "comm_mode", "ebpf_comm", "process_name"), "string")
    out = out.withColumn("exe", F.when(~F.lower(exe).isin("nan", "none"), exe).otherwise(""))
    if "pid" not in df.columns:
        out = out.withColumn("pid", F.coalesce(_first_of(df, ("pid_mode", "ebpf_pid"), "long", ("", "0")), F.lit(0).cast("long")))
    proto = _first_of(df, ("proto",), "string")
    return out.withColumn("proto", F.coalesce(proto_name(proto), F.lit("TCP")))


def normalise_event_ips(df: DataFrame) -> DataFrame:
    """Addresses of packet events (type 5), which come in network order, in host order like the others', and all of them as text."""
    fixed = {c: F.when(F.col("evtype") == 5, byteswap32(F.col(c))).otherwise(F.col(c)) for c in ("saddr", "daddr")}
    return df.withColumns(fixed).withColumns({f"{c}_str": u32_to_ipv4(F.col(c)) for c in ("saddr", "daddr")})


def with_run_meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """The rows with the fields of a run's metadata (a table of one row) as run_ columns."""
    return df.crossJoin(F.broadcast(flatten_struct(meta.limit(1))))  # one row


def with_provenance(df: DataFrame, day: str, run_id: str, offset_s: int = 0, halfday_shift_s: int = 0, pre_slop_s: int = 0, post_slop_s: int = 0) -> DataFrame:
    """Where a labelled row comes from: its day and run, and how labels and clocks were brought together."""
    return df.withColumns(
        {"day": F.lit(day), "run_id": F.lit(run_id)} | {f"label_{n}_sec": F.lit(int(v)) for n, v in (("time_offset", offset_s), ("halfday_shift", halfday_shift_s), ("window_pre_slop", pre_slop_s), ("window_post_slop", post_slop_s))}
    )
