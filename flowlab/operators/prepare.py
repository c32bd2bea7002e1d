"""Profiles, encodings, samples and split protocols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions import BENIGN_LIKE, DAYS

ROLES = ("train", "val", "test")


def order_hash(seed: int, *cols: str) -> Column:
    """A seeded order that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def attack_pivot(df: DataFrame, day: str, label: str, families: list[str]) -> DataFrame:
    """Rows by day and family and their sum, in the order of the week."""
    out = df.where(F.col(label).isin(families)).groupBy(day).pivot(label, families).count().fillna(0, families)
    return out.withColumn("total", sum((F.col(f) for f in families[1:]), F.col(families[0])))


def group_table(df: DataFrame, keys: tuple[str, ...], label: str, attack: str, fallback: str = "most") -> DataFrame:
    """Per group: rows, attacks, benign rows, and the dominant label: its commonest attack label, else its commonest label or (``fallback='benign'``) BENIGN.
    Ties go to the name first in order."""
    per = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.max(attack).alias("a"), F.sum(attack).alias("attacks"))
    best = F.min_by(F.col(label), F.struct(-F.col("a"), -F.col("n"), F.col(label)))
    out = per.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.sum("attacks").alias("attack_rows"), (F.sum("n") - F.sum("attacks")).alias("benign_rows"), best.alias("dom_label"), F.max("a").alias("__a"))
    return (out if fallback == "most" else out.withColumn("dom_label", F.when(F.col("__a") == 1, F.col("dom_label")).otherwise("BENIGN"))).drop("__a")


def fit_freq(df: DataFrame, column: str) -> DataFrame:
    """(value, freq): shares of the values."""
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("t")).alias("freq"))


def freq_encode(df: DataFrame, column: str, freq: DataFrame, unseen: float | None = 0.0) -> DataFrame:
    out = df.join(freq.withColumnsRenamed({"value": "__v", "freq": f"{column}_freq"}), F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")
    return out if unseen is None else out.fillna(unseen, [f"{column}_freq"])


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column, from one pass: share of nulls, distinct values, least and greatest as text."""
    aggs = [F.struct(F.lit(c).alias("column"), (F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias("null_share"), F.count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in columns]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def class_targets(counts: DataFrame, label: str, quota: int, equal: bool = False, benign_ratio: float | None = None, benign: str = "BENIGN") -> DataFrame:
    """(label, n, target) from the class counts: the quota or what there is; with ``equal`` the smallest class (with ``benign_ratio`` attack class) for all; with
    ``benign_ratio`` a share of the attack target for the benign class."""
    attack = F.col(label) != benign if benign_ratio is not None else F.lit(True)
    totals = counts.agg(F.min(F.when(attack, F.least("n", F.lit(quota)))).alias("smallest"))
    each = counts.crossJoin(F.broadcast(totals)).withColumn("target", F.col("smallest") if equal else F.least(F.col("n"), F.lit(quota))).drop("smallest")
    if benign_ratio is None:
        return each
    sums = each.agg(F.sum(F.when(F.col(label) != benign, F.col("target"))).alias("attacks"))
    return each.crossJoin(F.broadcast(sums)).withColumn("target", F.when(F.col(label) == benign, F.least(F.col("n"), F.floor(F.col("attacks") * benign_ratio))).otherwise(F.col("target"))).drop("attacks")


def sample_classes(df: DataFrame, label: str, targets: DataFrame, seed: int, row_id: str) -> DataFrame:
    """The first ``target`` rows of each class in hashed order. The rank filter is pushed below the shuffle as a group limit, so a task passes
    on at most ``target`` rows per class."""
    w = Window.partitionBy(label).orderBy(order_hash(seed, row_id), row_id)
    wanted = targets.select(F.col(label).alias("__l"), "target")
    most = targets.agg(F.max("target")).first()[0] or 0
    ranked = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return ranked.join(F.broadcast(wanted), F.col(label) == F.col("__l")).where(F.col("__r") <= F.col("target")).drop("__r", "__l", "target")


def quota_sample(df: DataFrame, label: str, quota: int, seed: int, row_id: str, equal: bool = False, benign_ratio: float | None = None) -> DataFrame:
    return sample_classes(df, label, class_targets(label_counts(df, label), label, quota, equal, benign_ratio), seed, row_id)


def stratified_split(df: DataFrame, label: str, seed: int, row_id: str, ratios: tuple[float, float] = (0.7, 0.15), rare: int = 2, per_bucket: int = 1_000_000) -> DataFrame:
    """Adds role. Classes with fewer than ``rare`` rows form one stratum. Rows are ranked in hashed order inside (stratum, hash bucket), so no
    stratum is one task; a bucket's exact cut is its own rank against the stratum's rows before it."""
    counts = label_counts(df, label).withColumn("stratum", F.when(F.col("n") < rare, "RARE").otherwise(F.col(label))).select(F.col(label).alias("__l"), "stratum", "n")
    most = counts.agg(F.max("n")).first()[0] or 0
    digits = next(d for d in range(1, 5) if d == 4 or 16**d * per_bucket >= most)  # of the hash: 16 to 65,536 buckets per stratum
    h = order_hash(seed, row_id)
    rows = df.join(F.broadcast(counts.drop("n")), F.col(label) == F.col("__l")).drop("__l").withColumn("__h", h).withColumn("__b", F.substring("__h", 1, digits))
    sizes = rows.groupBy("stratum", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("stratum").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("stratum", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"), F.sum("__n").over(Window.partitionBy("stratum")).alias("__t"))
    rank = F.row_number().over(Window.partitionBy("stratum", "__b").orderBy("__h", row_id))
    share = (F.col("__r") + F.col("__o") - 1) / F.col("__t")
    out = rows.withColumn("__r", rank).join(F.broadcast(offsets), ["stratum", "__b"])
    role = F.when(share < ratios[0], "train").when(share < ratios[0] + ratios[1], "val").otherwise("test")
    return out.withColumn("role", role).drop("__h", "__b", "__r", "__o", "__t")


def rebalance(train: DataFrame, label: str, target: int, seed: int, row_id: str, benign_ratio: float = 3.0, mode: str = "cycle", benign: str = "BENIGN") -> DataFrame:
    """Attack families with ``target`` rows or fewer grow to exactly the target, larger ones are sampled down; benign rows are capped at ``benign_ratio`` times what all
    families come to, and never repeated. Adds copy (from 0).

    ``cycle`` repeats a family's rows in hashed order; ``draw`` draws with replacement, by a hash of the draw's number. A null label is no family and goes."""
    counts = label_counts(train, label).where(F.col(label).isNotNull())
    attack = F.col(label) != benign
    cap = counts.agg(F.floor(F.count_if(attack) * target * F.lit(benign_ratio)).alias("__cap"))
    targets = counts.crossJoin(F.broadcast(cap)).withColumn("target", F.when(attack, F.least("n", F.lit(target))).otherwise(F.least("n", "__cap"))).drop("__cap")  # one row
    kept = sample_classes(train, label, targets, seed, row_id)
    w = Window.partitionBy(label).orderBy(order_hash(seed, row_id), row_id)  # at most the target's rows per family
    ranked = kept.withColumn("__r", F.row_number().over(w)).join(F.broadcast(counts.select(F.col(label).alias("__l"), "n")), F.col(label) == F.col("__l")).drop("__l")
    grows = (F.col(label) != benign) & (F.col("n") < target)
    if mode == "cycle":
        copies = F.when(~grows, 1).otherwise(F.floor(F.lit(target) / F.col("n")) + (F.col("__r") <= F.lit(target) % F.col("n")).cast("int")).cast("int")
        return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__r", "n")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__l"), F.col("__d").cast("string"))), 1, 12), 16, 10).cast("long")
    small = counts.where(attack & (F.col("n") < target)).select(F.col(label).alias("__l"), "n")
    draws = small.withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(target)))).select("__l", (number % F.col("n") + 1).alias("__pick"))
    times = draws.groupBy("__l", "__pick").agg(F.count(F.lit(1)).cast("int").alias("__times"))  # at most the target's rows per family
    drawn = ranked.join(times, (F.col(label) == F.col("__l")) & (F.col("__r") == F.col("__pick")), "left")
    often = F.when(grows, F.coalesce("__times", F.lit(0))).otherwise(1)
    return drawn.withColumn("__often", often).where("__often > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__often") - 1))).drop("__r", "n", "__l", "__pick", "__times", "__often")


def split_by_day(df: DataFrame, day: str, label: str, quota: int, seed: int, row_id: str, days: dict[str, list] | None = None, min_quota: int = 1, benign_ratio: float = 1.0) -> DataFrame:
    """(row, role): test_balanced is a sample of all days with as many rows of every attack family as the smallest has (the quota at most) and ``benign_ratio`` times
    that many benign ones; train, val and test_realistic are days, and train leaves out sampled rows. A row may stand in test_balanced and in val or test_realistic.

    Raises ValueError without attack families, or if the smallest family has fewer than ``min_quota`` rows."""
    days = days or {"train": [0, 1, 2], "val": [3], "test_realistic": [4]}
    least = label_counts(df, label).where(F.col(label) != "BENIGN").agg(F.min("n")).first()[0]
    if least is None or min(least, quota) < min_quota:
        raise ValueError(f"the smallest attack family has {least or 0} rows, fewer than the quota of {min_quota} that is asked for")
    balanced = quota_sample(df, label, quota, seed, row_id, equal=True, benign_ratio=benign_ratio)
    parts = [balanced.withColumn("role", F.lit("test_balanced"))]
    for role, which in days.items():
        rows = df.where(F.col(day).isin(which))
        if role == "train":
            rows = rows.join(balanced.select(row_id), row_id, "left_anti")
        parts.append(rows.withColumn("role", F.lit(role)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_split(groups: DataFrame, label: str, size: str, keys: tuple[str, ...], seed: int, ratios: tuple[float, float] = (0.7, 0.15), per_task: int = 4096) -> DataFrame:
    """Adds role to a table of groups: by dominant label, the largest group first into the role that is furthest behind its share of rows.

    The rule is sequential, so it runs per label on the group table; labels with more than ``per_task`` groups are dealt by hash into parts of about that
    many, so that neither a rare label is cut up nor does one task's part grow with the table."""
    parts = groups.groupBy(F.col(label).alias("__l")).agg(F.ceil(F.count(F.lit(1)) / per_task).alias("__parts"))  # one row a label
    salted = groups.join(F.broadcast(parts), F.col(label).eqNullSafe(F.col("__l"))).withColumn("__salt", F.pmod(F.xxhash64(F.lit(seed), *keys), F.col("__parts")).cast("int")).drop("__l", "__parts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema) + ", role string"

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, *keys], ascending=[False] + [True] * len(keys), ignore_index=True)
        total = int(pdf[size].sum())
        left = {"train": round(total * ratios[0]), "val": round(total * ratios[1])}
        left["test"] = total - sum(left.values())
        roles = []
        for n in pdf[size]:
            role = max(left, key=left.get)
            left[role] -= int(n)
            roles.append(role)
        return pdf.assign(role=roles).drop(columns="__salt")

    return salted.groupBy(label, "__salt").applyInPandas(deal, schema)


def assign_roles(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's role; a group that is not listed trains."""
    return df.join(groups.select(*keys, "role"), keys, "left").fillna("train", ["role"])


def kfold(groups: DataFrame, keys: tuple[str, ...], k: int, repeats: int, seed: int, label: str | None = None, per_bucket: int = 1_000_000) -> DataFrame:
    """(keys, repeat, fold): every group in one test fold per repeat. Stratified by the dominant label where its rarest class has k groups; k is at
    most the number of groups. Groups are ranked in hashed order inside hash buckets, so neither a repeat nor a stratum is one task."""
    n = groups.count()
    k = max(1, min(k, n))
    strata: tuple[str, ...] = ()
    if label and (groups.groupBy(label).count().agg(F.min("count")).first()[0] or 0) >= k:
        strata = (label,)
    each = groups.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), *[F.col(c).cast("string") for c in keys]))
    digits = next(d for d in range(1, 5) if d == 4 or 16**d * per_bucket >= n)
    rows = each.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, digits)).withColumn("__s", F.struct("repeat", *strata))
    sizes = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__s").alias("__t"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", *keys)))
    placed = ranked.join(offsets, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__c")))  # at most 65,536 buckets a stratum
    return placed.withColumn("fold", ((F.col("__r") + F.col("__o") - 1) % k).cast("int")).select(*keys, "repeat", "fold")


def kfold_meta(df: DataFrame, folds: DataFrame, keys: list[str], label: str, attack: str) -> DataFrame:
    """Per fold: test and train rows and attacks, and families that train lacks; one join, all folds at once."""
    cells = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.sum(attack).alias("a"))
    test = cells.join(folds, keys).groupBy("repeat", "fold", label).agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    whole = cells.groupBy(label).agg(F.sum("n").alias("all_n"), F.sum("a").alias("all_a"))
    every = folds.select("repeat", "fold").distinct().crossJoin(F.broadcast(whole))  # families
    both = every.join(test, ["repeat", "fold", label], "left").fillna(0, ["n", "a"])
    unseen = F.count_if((F.col("n") > 0) & (F.col("n") == F.col("all_n")))
    return both.groupBy("repeat", "fold").agg(F.sum("n").alias("test_rows"), F.sum("a").alias("test_attacks"), F.sum(F.col("all_n") - F.col("n")).alias("train_rows"), F.sum(F.col("all_a") - F.col("a")).alias("train_attacks"), unseen.alias("unseen_families"))


def ratio_sample(df: DataFrame, attack: str, n: int, seed: int, row_id: str) -> DataFrame:
    """n rows with the share of positives kept, at least one of them."""
    counts = df.groupBy(attack).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(attack) == 1, F.col("n")).otherwise(0)).alias("p"))
    pos = F.least(F.col("p"), F.greatest(F.lit(1), F.bround(F.col("p") * F.lit(n) / F.col("t")).cast("long")))
    targets = counts.crossJoin(F.broadcast(totals)).withColumn("target", F.least(F.col("n"), F.when(F.col(attack) == 1, pos).otherwise(F.lit(n) - pos))).select(attack, "target")
    return sample_classes(df, attack, targets, seed, row_id)


def split_report(df: DataFrame, role: str, label: str, attack: str) -> DataFrame:
    """Per role: rows, attacks, prevalence, number of attack families, and how many of them train lacks."""
    cells = df.groupBy(role, label).agg(F.count(F.lit(1)).alias("n"), F.sum(attack).alias("a"))
    trained = cells.where(F.col(role) == "train").select(F.col(label).alias("__l"), F.lit(1).alias("__t"))
    joined = cells.join(F.broadcast(trained), F.col(label) == F.col("__l"), "left")  # families
    real = ~F.col(label).isin(*BENIGN_LIKE)
    return joined.groupBy(role).agg(F.sum("n").alias("n_rows"), F.sum("a").alias("attacks"), (F.sum("a") / F.sum("n")).alias("prevalence"), F.count_if(real).alias("families"), F.count_if(real & F.col("__t").isNull()).alias("unseen"))


def session_overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the test's distinct sessions that also train, in per cent."""
    mine, seen = test.select(*keys).distinct(), train.select(*keys).distinct().withColumn("__s", F.lit(1))
    return mine.join(seen, keys, "left").agg(F.count(F.lit(1)).alias("sessions"), F.count("__s").alias("shared"), F.round(100.0 * F.count("__s") / F.count(F.lit(1)), 1).alias("overlap_pct"))


def unseen_families(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    return test.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")


# Columns that carry identity or labels, parts of names by which kernel columns are known, and columns that are never features.
META = ("label_family", "is_attack", "day", "label_raw", "run_id", "ts", "start_ts", "end_ts", "t_end", "orig_h", "resp_h", "src_ip", "dst_ip", "k", "label_time_offset_sec", "label_halfday_shift_sec", "label_window_pre_slop_sec", "label_window_post_slop_sec")
KERNEL_HINTS = ("ebpf", "bpf", "pid", "ppid", "uid", "gid", "comm", "exe", "cmd", "cgroup", "sock", "sk_", "tcp_", "udp_", "netns", "inode", "tgid", "task", "ns_", "mount")
NEVER = ("label_family", "day")


def split_feature_columns(columns: list[str], never: tuple[str, ...] = NEVER) -> tuple[list[str], list[str]]:
    """(baseline, enhanced) columns by their names: the kernel's columns follow the others in the enhanced set; label and day are in neither."""
    kernel = lambda c: any(h in c.lower() for h in KERNEL_HINTS)
    usable = [c for c in columns if c not in never]
    base = [c for c in usable if not kernel(c)]
    return base, base + [c for c in usable if kernel(c)]


def select_features(df: DataFrame) -> list[str]:
    """Numeric columns that are not metadata and not all null; one pass."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") and f.name not in META]
    if not numeric:
        return []
    filled = df.agg(*[F.count(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if filled[c]]


def week_order(day: str) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col(day))


def build_feature_sets(df: DataFrame, label: str, encode: list[str], frequencies: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Rows without Unknown labels, with column_freq for the listed columns (fitted on these rows, or given), and the column names of the baseline and the
    enhanced set."""
    known = df.where(F.lower(F.coalesce(F.col(label), F.lit(""))) != "unknown")
    for c in encode:
        known = freq_encode(known, c, (frequencies or {}).get(c, fit_freq(known, c)))
    base, enhanced = split_feature_columns(known.columns)
    return known, base, enhanced
