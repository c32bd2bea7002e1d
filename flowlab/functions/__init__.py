"""Column functions of the flow model: projections B1 to B27 of the survey, all JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def num(c: Column, kind: str = "double", default=0) -> Column:
    """Lenient numeric cast: whatever does not parse becomes the default."""
    return F.coalesce(F.trim(c.cast("string")).try_cast(kind), F.lit(default).cast(kind))


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def ipv4_to_u32(c: Column) -> Column:
    """Dotted IPv4 text (outer blanks ignored) as a long; null for anything else, IPv6 included."""
    t = F.trim(c)
    parts = F.split(t, r"\.")
    value = sum((parts[k].cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), parts[0].cast("long") * (1 << 24))
    return F.when(t.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), value)


def u32_to_ipv4(c: Column, byte_order: str = "host") -> Column:
    shifts = (24, 16, 8, 0) if byte_order == "host" else (0, 8, 16, 24)
    return F.concat_ws(".", *[F.shiftrightunsigned(c, s).bitwiseAND(F.lit(255)).cast("string") for s in shifts])


def byteswap32(c: Column) -> Column:
    x = c.cast("long")
    byte = lambda s: F.shiftrightunsigned(x, s).bitwiseAND(F.lit(255))
    return F.shiftleft(byte(0), 24) + F.shiftleft(byte(8), 16) + F.shiftleft(byte(16), 8) + byte(24)


def proto_num(c: Column, dialect: str = "enrich") -> Column:
    """enrich: TCP and UDP, else 0. label: names (ICMP too) or digits, else -1. live: names or any number, else 0."""
    name = F.lower(F.trim(c.cast("string")))
    known = F.when(name == "tcp", 6).when(name == "udp", 17)
    if dialect == "enrich":
        return known.otherwise(0)
    known = known.when(name == "icmp", 1)
    if dialect == "label":
        return known.when(name.rlike(r"^\d+$"), name.try_cast("int")).otherwise(-1)
    return F.coalesce(known.otherwise(name.try_cast("double").cast("int")), F.lit(0))


def proto_name(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    n = t.try_cast("double").cast("int")
    return F.when(n == 6, "TCP").when(n == 17, "UDP").when(n == 1, "ICMP").otherwise(F.upper(t))


def mono_to_epoch(ns: Column, anchor_ns: Column, anchor_s: Column) -> Column:
    """Monotonic nanoseconds as epoch seconds; what lies before the anchor becomes the anchor."""
    return anchor_s + F.greatest(ns - anchor_ns, F.lit(0)) / F.lit(1e9)


def flow_offset(flush_s: Column, last_ns: Column) -> Column:
    """Clock offset in seconds when there is no anchor."""
    return flush_s - last_ns / F.lit(1e9)


def with_interval(df: DataFrame, clip: bool, ts: str = "ts", duration: str = "duration") -> DataFrame:
    d = F.coalesce(F.col(duration), F.lit(0.0))
    return df.withColumn("start_ts", F.col(ts)).withColumn("end_ts", F.col(ts) + (F.greatest(d, F.lit(0.0)) if clip else d))


# Substrings in the order in which they are tried, and the family of each.
BENIGN_NAMES = ("benign", "normal")
TAXONOMY = (("ddos", "DDoS"), ("dos", "DoS"), ("portscan", "PortScan"), ("bot", "Bot"), ("bruteforce", "BruteForce"), ("ssh", "BruteForce"), ("ftp", "BruteForce"), ("patator", "BruteForce"), ("web attack", "WebAttack"), ("webattack", "WebAttack"), ("sql injection", "WebAttack"), ("xss", "WebAttack"), ("infiltration", "Infiltration"), ("heartbleed", "Heartbleed"))
BENIGN_LIKE = ("BENIGN", "Unknown", "nan", "NaN", "")


def label_family(c: Column) -> Column:
    """The family of a raw label; the order of the rules matters (ddos before dos). Unmatched texts are Other, and so are null
    labels, which log readers hand over as the text "nan"."""
    t = F.lower(F.trim(F.coalesce(c, F.lit("nan"))))
    out = F.when(t.isin(*BENIGN_NAMES), "BENIGN")
    for part, family in TAXONOMY:
        out = out.when(t.contains(part), family)
    return out.otherwise("Other")


def is_attack(family: Column) -> Column:
    return F.when(F.coalesce(family, F.lit("nan")).isin(*BENIGN_LIKE), 0).otherwise(1)


# Weekdays in calendar order.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def day_from_path(c: Column) -> Column:
    name = F.lower(F.element_at(F.split(c, "/"), -1))
    out = F.lit("Unknown")
    for day in reversed(DAYS):
        out = F.when(name.contains(day.lower()), day).otherwise(out)
    return out


def trim_nul(c: Column) -> Column:
    return F.split(c, "\\x00", 2)[0]


def resolve(df: DataFrame, name: str, default, kind: str) -> Column:
    """``ebpf_name``, else ``name``, else a constant; nulls become the default."""
    have = [F.col(c) for c in (f"ebpf_{name}", name) if c in df.columns][:1]
    return F.coalesce(*have, F.lit(default)).cast(kind)


def align(df: DataFrame, features: list[str]) -> DataFrame:
    """A feature list's columns as doubles, missing ones and nulls 0."""
    return df.select(*[c for c in df.columns if c not in features], *[(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)).alias(f) for f in features])


def score_band(c: Column) -> Column:
    return F.when(c >= 0.65, "high").when(c >= 0.35, "mid").otherwise("low")


def score_text(c: Column) -> Column:
    return F.when(c.isNull(), "N/A").when(c < 0.001, F.format_string("%.2e", c)).otherwise(F.format_string("%.3f", c))


def event_score(df: DataFrame, model: str) -> Column:
    return F.coalesce(*[F.col(c) for c in (f"{model}_score", "anomaly_score") if c in df.columns], F.lit(0.0))


def event_label(df: DataFrame, model: str) -> Column:
    have = []
    if f"{model}_pred" in df.columns:
        have.append(F.when(F.col(f"{model}_pred") == 1, "ATTACK").when(F.col(f"{model}_pred") == 0, "BENIGN"))
    have += [F.col(c) for c in (f"{model}_label", "label") if c in df.columns]
    return F.coalesce(*have, F.lit("BENIGN"))


def bucket_seconds(window_s: int) -> int:
    """Width of a chart's buckets for a trailing window. Window up to, width."""
    for upto, width in ((120, 2), (300, 10), (900, 15), (3600, 60), (21600, 300)):
        if window_s <= upto:
            return width
    return 900


def bucket_label(bucket_s: Column, window_s: int) -> Column:
    """A bucket's label on a chart: the time of day in windows up to an hour, else day and minute; in the session's zone."""
    return F.date_format(F.timestamp_seconds(bucket_s), "HH:mm:ss" if window_s <= 3600 else "MM-dd HH:mm")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k of n; null without rows."""
    p, nn = k / n, n.cast("double")
    base = 1 + z * z / nn
    mid, half = (p + z * z / (2 * nn)) / base, z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / base
    valid = n > 0
    return F.when(valid, F.greatest(mid - half, F.lit(0.0))), F.when(valid, F.least(mid + half, F.lit(1.0)))


def _stirling(x: Column) -> Column:
    """ln(x!) less Stirling's formula ln(sqrt(2 pi x) (x / e)^x), for x of 1 and more: a series from 16 on, below it by the recurrence."""
    y = x + F.when(x < 16, 16).otherwise(0)
    z = y * y
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / z) / z) / z) / z) / y
    step = lambda a, i: a - 1 + (x + i + 0.5) * F.log1p(1 / (x + i))  # noqa: E731  ln((x+1)!) - ln(x!) in terms of the formula
    return F.when(x < 16, F.aggregate(F.sequence(F.lit(0), F.lit(15)), series, step)).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x."""
    return x * F.log1p((x - mean) / mean) - (x - mean)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p: the binomial tail of the smaller discordant count at one half.

    The greatest term by its saddle-point form, and from there downwards the others by their ratios, as many as have weight: with n discordant rows at most 4.5 sqrt(n) + 60."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    m, j = F.greatest(n, F.lit(1.0)), F.greatest(k, F.lit(1.0))  # the form is for one and more
    i = F.greatest(n - k, F.lit(1.0))
    log = _stirling(m) - _stirling(j) - _stirling(i) - _deviance(j, m / 2) - _deviance(i, m / 2) + 0.5 * F.log(m / (2 * math.pi * j * i))
    top = F.when(k == 0, F.exp(-n * math.log(2))).otherwise(F.exp(log))
    terms = F.least(k, F.floor(4.5 * F.sqrt(n)) + 60).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    ratio = lambda i: (k - i) / (n - k + i + 1)
    tail = F.aggregate(steps, start, lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum")), lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * tail))


def register_sql(spark: SparkSession) -> None:
    """The scalar functions for SQL users, as SQL functions that the optimiser can inline."""
    octets = "split(trim(ip), '[.]')"
    guard = rf"^{OCTET}([.]{OCTET}){{3}}$"
    value = " + ".join(f"cast({octets}[{k}] as bigint) * {1 << (24 - 8 * k)}" for k in range(4))
    benign = ", ".join(f"'{x}'" for x in BENIGN_NAMES)
    family = "".join(f" when contains(lower(coalesce(raw, 'nan')), '{part}') then '{name}'" for part, name in TAXONOMY)
    spark.sql(f"create or replace temporary function ipv4_to_u32(ip string) returns bigint return case when trim(ip) rlike '{guard}' then {value} end")
    spark.sql("create or replace temporary function u32_to_ipv4(n bigint) returns string return concat_ws('.', n div 16777216 % 256, n div 65536 % 256, n div 256 % 256, n % 256)")
    spark.sql(f"create or replace temporary function label_family(raw string) returns string return case when lower(trim(raw)) in ({benign}) then 'BENIGN'{family} else 'Other' end")
    spark.sql("create or replace temporary function proto_num(name string) returns int return case upper(trim(name)) when 'TCP' then 6 when 'UDP' then 17 else 0 end")
    spark.sql("create or replace temporary function score_band(s double) returns string return case when s >= 0.65 then 'high' when s >= 0.35 then 'mid' else 'low' end")
