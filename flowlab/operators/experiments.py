"""Experiment protocols over detectors: selection, matched recall, refits, seeds, importances, ablations and saved packs."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.operators import evaluate, models, prepare, trees
from flowlab.shared import written


@dataclass(frozen=True)
class Pack:
    """A fitted detector with its features and threshold."""

    model: PipelineModel | trees.Boosted | trees.ExtraTrees | models.Linear
    features: list[str]
    threshold: float
    kind: str
    seed: int = 104


def typed(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.withColumns({f: F.col(f).cast("double") for f in features})


def fit(rows: DataFrame, kind: str, features: list[str], y: str, seed: int = 104, size: int | None = None, depth: int | None = None, mode: str = "f1", target: float = 0.0) -> Pack:
    """Fits on role train and takes the threshold on val. ``size`` and ``depth`` are the trees or iterations and the trees' depth, by default those of ``models.fit_model``."""
    ready = typed(rows, features)
    model = models.fit_model(ready.where("role = 'train'"), kind, features, y, seed, size, depth)
    threshold = evaluate.select_threshold(models.score_rows(model, ready.where("role = 'val'")), y, "score", mode, target).first()["threshold"]
    return Pack(model, list(features), float(threshold), kind, seed)


def score(pack: Pack, rows: DataFrame) -> DataFrame:
    """Rows with score and pred, of a table or a stream; missing features are 0 and nulls are the imputer's business."""
    have = rows.withColumns({f: (F.col(f).cast("double") if f in rows.columns else F.lit(0.0)) for f in pack.features})
    return models.score_rows(pack.model, have).withColumn("pred", (F.col("score") >= pack.threshold).cast("int"))


def summary(scored: DataFrame, y: str, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranking metrics and rates at a threshold from one pass over the counts per distinct score."""
    sums = evaluate.prefix_sums(evaluate.score_counts(scored, y, "score", by), by)
    p, n, tp, fp = (F.col(c).cast("double") for c in ("p", "n", "tp", "fp"))
    pos, neg, flagged = F.max("pos").cast("double"), F.max("neg").cast("double"), F.col("s") >= threshold
    hit, false = F.sum(F.when(flagged, p).otherwise(0.0)), F.sum(F.when(flagged, n).otherwise(0.0))
    return sums.groupBy(*by).agg(
        F.when((pos > 0) & (neg > 0), F.sum(n * (tp - p + p / 2.0)) / (pos * neg)).alias("roc_auc"),
        F.when(pos > 0, F.sum(p * tp / (tp + fp)) / pos).alias("pr_auc"),
        evaluate.ratio(2.0 * hit, hit + false + pos).alias("f1"),
        evaluate.ratio(hit, pos).alias("recall"),
        evaluate.ratio(hit, hit + false).alias("precision"),
        evaluate.ratio(false, neg).alias("fpr"),
    )


def rates(scored: DataFrame, y: str, threshold: float) -> DataFrame:
    """Of ``summary`` the rates at a threshold, which need no ranking: one pass over the rows."""
    flagged = F.col("score") >= threshold
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    sums = scored.where(F.col("score").isNotNull()).select(y, "score").withColumn("__p", F.coalesce(F.col(y) == 1, F.lit(False)))
    p, n = F.col("__p"), ~F.col("__p")
    hit, false, pos, neg = count(flagged & p), count(flagged & n), count(p), count(n)
    return sums.agg(evaluate.ratio(2.0 * hit, hit + false + pos).alias("f1"), evaluate.ratio(hit, pos).alias("recall"), evaluate.ratio(hit, hit + false).alias("precision"), evaluate.ratio(false, neg).alias("fpr"))


#: Fits that run at the same time: their jobs are many and short, so one after another they mostly wait.
TOGETHER = 4


def side_by_side(tasks: list[Callable], together: int = TOGETHER) -> list:
    """The tasks' results in order, ``together`` at a time in threads of the driver, whose jobs share the cluster."""
    with ThreadPoolExecutor(together) as pool:
        return list(pool.map(lambda task: task(), tasks))


def report(rows: list[DataFrame]) -> DataFrame:
    """A table of one-row results, one per fit; each is computed by itself, so no plan grows with the number of fits."""
    return rows[0].sparkSession.createDataFrame(side_by_side([r.first for r in rows]), rows[0].schema)


def _prefixed(df: DataFrame, prefix: str, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def evaluate_pack(pack: Pack, rows: DataFrame, y: str, roles: tuple[str, str] = ("train", "val")) -> DataFrame:
    """One row: both roles' area and F1, the gaps between them, and the selection score (the area less half the area's gap and a quarter of F1's)."""
    return evaluate_scored(score(pack, rows.where(F.col("role").isin(*roles))), pack.threshold, y, roles)


def evaluate_scored(scored: DataFrame, threshold: float, y: str, roles: tuple[str, str] = ("train", "val")) -> DataFrame:
    """``evaluate_pack`` on rows of both roles that have their scores."""
    a, b = roles
    both = summary(scored, y, threshold, ("role",))
    row = both.agg(*[F.max(F.when(F.col("role") == r, F.col(m))).alias(f"{r}_{m}") for r in roles for m in ("roc_auc", "f1")])
    gap = lambda m: F.greatest(F.lit(0.0), F.coalesce(f"{a}_{m}", F.lit(0.0)) - F.coalesce(f"{b}_{m}", F.lit(0.0)))
    row = row.withColumns({"gap_auc": gap("roc_auc"), "gap_f1": gap("f1")})
    chosen = F.coalesce(f"{b}_roc_auc", F.lit(0.0)) - 0.5 * F.col("gap_auc") - 0.25 * F.col("gap_f1")
    return row.withColumn("selection_score", chosen).withColumn("threshold", F.lit(threshold))


def rank_candidates(rows: DataFrame, kinds: list[str], features: list[str], y: str, seed: int = 104, size: int | None = None) -> tuple[DataFrame, dict[str, Pack]]:
    """The leaderboard, best first, and the fitted packs by name. Two candidates are fitted at a time, as boosting on few units takes one task; train and val are scored once a
    candidate, for the threshold and the metrics."""
    ready = typed(rows, features)

    def candidate(kind: str) -> tuple[Pack, DataFrame]:
        model = models.fit_model(ready.where("role = 'train'"), kind, features, y, seed, size)
        scored = written(models.score_rows(model, ready.where("role in ('train', 'val')")).select("role", y, "score"), "scored")
        threshold = float(evaluate.select_threshold(scored.where("role = 'val'"), y, "score", "f1").first()["threshold"])
        line = evaluate_scored(scored, threshold, y).withColumn("model", F.lit(kind))
        return Pack(model, list(features), threshold, kind, seed), line

    order = sorted(kinds, key=lambda kind: ("gbt", "extra", "rf", "logreg").index(kind))  # the longest first
    made = dict(zip(order, side_by_side([lambda kind=kind: candidate(kind) for kind in order], 2), strict=True))
    return leaderboard(report([made[kind][1] for kind in kinds])), {kind: made[kind][0] for kind in kinds}


def leaderboard(board: DataFrame, score_: str = "selection_score", name: str = "model") -> DataFrame:
    """Adds place; one row per model."""
    return board.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score_), name)))


def matched_recall(packs: dict[str, Pack], rows: DataFrame, y: str, test: str = "test") -> DataFrame:
    """Models compared at one recall: the least of their recalls on val, each at its own threshold. Per model the threshold that reaches it on val, and
    the rates on test."""
    val = rows.where("role = 'val'")
    scored = {name: score(p, val) for name, p in packs.items()}
    target = min(rates(s, y, packs[name].threshold).first()["recall"] for name, s in scored.items())
    out = []
    for name, p in packs.items():
        cut = evaluate.select_threshold(scored[name], y, "score", "recall", target).first()["threshold"]
        got = rates(score(p, rows.where(F.col("role") == test)), y, cut)
        out.append(got.select(F.lit(name).alias("model"), F.lit(target).alias("target_recall"), F.lit(float(cut)).alias("threshold"), "recall", "precision", "fpr", "f1"))
    return report(out)


def refit_table(splits: dict[str, DataFrame], feature_sets: dict[str, list[str]], kind: str, y: str, seed: int = 104, size: int | None = None) -> DataFrame:
    """A model refitted on every split and feature set: areas of train and test and the gap between them."""

    def refit(split: str, rows: DataFrame, name: str, features: list[str]) -> DataFrame:
        got = evaluate_pack(fit(rows, kind, features, y, seed, size), rows, y, ("train", "test"))
        return got.select(F.lit(split).alias("split"), F.lit(name).alias("feature_set"), F.lit(seed).alias("seed"), F.lit(len(features)).alias("n_features"), F.col("train_roc_auc").alias("train_auc"), F.col("test_roc_auc").alias("test_auc"), F.col("test_f1"), (F.col("train_roc_auc") - F.col("test_roc_auc")).alias("gap"))

    out = side_by_side([lambda args=(split, rows, name, features): refit(*args) for split, rows in splits.items() for name, features in feature_sets.items()])
    return report(out)


def seed_summary(runs: DataFrame, by: str = "feature_set", value: str = "test_auc", gap: str = "gap", seed: str = "seed") -> DataFrame:
    """Means and sample deviations over seeds, and in how many seeds a set alone has the greatest value."""
    best = runs.groupBy(seed).agg(F.max(value).alias("__m"))
    top = runs.join(F.broadcast(best), seed).withColumn("__top", F.col(value) == F.col("__m"))  # seeds
    alone = top.groupBy(seed).agg(F.count_if("__top").alias("__n"))
    rows = top.join(F.broadcast(alone), seed)
    return rows.groupBy(by).agg(F.avg(value).alias(f"mean_{value}"), F.stddev_samp(value).alias(f"std_{value}"), F.avg(gap).alias(f"mean_{gap}"), F.stddev_samp(gap).alias(f"std_{gap}"), F.count(F.lit(1)).alias("n_seeds"), F.count_if(F.col("__top") & (F.col("__n") == 1)).alias("wins"))


def fold_summary(meta: DataFrame) -> DataFrame:
    """Mean, least and greatest rows over folds, and the number of folds with families that train lacks."""
    stats = [f(c).alias(f"{n}_{c}") for c in ("train_rows", "test_rows") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return meta.agg(F.count(F.lit(1)).alias("folds"), *stats, F.avg("test_attacks").alias("mean_test_attacks"), F.count_if(F.col("unseen_families") > 0).alias("folds_with_unseen"))


# Parts of names by which kernel features are known, and the features whose worth is known beforehand.
ORIGIN_HINTS = ("ebpf", "bpf", "pid", "ppid", "uid", "gid", "comm", "exe", "cmd", "sock", "sk_", "tcp_", "udp_", "netns", "inode", "tgid")
CONSTANT = ("ebpf_pid", "ebpf_uid")
ALL_NULL = ("ebpf_comm",)
INFORMATIVE = ("ebpf_bytes_sent", "ebpf_bytes_recv", "ebpf_retransmits", "ebpf_state_changes", "ebpf_samples")


def from_kernel(feature: str) -> bool:
    return any(h in feature.lower() for h in ORIGIN_HINTS)


def annotate_features(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Adds origin (kernel or core) and risk."""
    c = F.col(feature)
    risk = F.when(c.isin(*CONSTANT), "constant").when(c.isin(*ALL_NULL), "all null").when(c.isin(*INFORMATIVE), "informative").otherwise("core")
    return df.withColumns({"origin": F.when(F.lower(c).rlike("|".join(ORIGIN_HINTS)), "kernel").otherwise("core"), "risk": risk})


def origin_mass(importance: DataFrame, value: str, by: tuple[str, ...] = (), origin: str = "origin") -> DataFrame:
    """Sums of the positive importances by origin, 0 where an origin has none."""
    part = lambda o: F.coalesce(F.sum(F.when(F.col(origin) == o, F.greatest(F.col(value), F.lit(0)))), F.lit(0)).alias(o)
    return importance.groupBy(*by).agg(part("core"), part("kernel"))


def _variants(rows: DataFrame, features: list[str], keep: list[str], table: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Every row once per variant (a name and the features it replaces), so that all variants are scored in one pass."""
    each = [F.struct(name.alias("variant"), *[changed.get(f, F.col(f)).alias(f) for f in features]) for name, changed in table]
    return rows.select(*keep, F.explode(F.array(*each)).alias("v")).select(*keep, "v.*")


def permutation_importance(pack: Pack, rows: DataFrame, y: str, row_id: str, repeats: int = 5, block: int = 100_000, seed: int = 104) -> DataFrame:
    """(feature, importance_mean, importance_std): the fall of the area when a feature's values change places.

    Rows are dealt into random blocks of about ``block`` rows; inside a block each row takes the values of the next one in a random order, so no task sorts the
    table. One scoring pass serves all features and repeats."""
    fs = pack.features
    ready = typed(rows, fs).select(row_id, y, *fs)
    blocks = max(1, -(-ready.count() // block))
    each = ready.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    each = each.withColumns({"__b": F.pmod(F.xxhash64(F.lit(seed), "repeat", row_id), F.lit(blocks)), "__h": F.xxhash64(F.lit(seed + 1), "repeat", row_id)})
    w = Window.partitionBy("repeat", "__b").orderBy("__h", row_id)
    mine = F.struct(*fs)
    donors = each.withColumn("__d", F.coalesce(F.lead(mine).over(w), F.first(mine).over(w)))
    table = [(F.lit(f), {f: F.col("__d")[f]}) for f in fs]
    moved = summary(score(pack, _variants(donors, fs, ["repeat", y], table)), y, pack.threshold, ("variant", "repeat"))
    base = summary(score(pack, ready), y, pack.threshold).select(F.col("roc_auc").alias("base"))
    falls = moved.crossJoin(F.broadcast(base)).withColumn("fall", F.col("base") - F.col("roc_auc"))  # one row
    return annotate_features(falls.groupBy(F.col("variant").alias("feature")).agg(F.avg("fall").alias("importance_mean"), F.stddev_pop("fall").alias("importance_std")))


def medians(pack: Pack) -> dict[str, float]:
    """What the pack fills in for missing values."""
    if not isinstance(pack.model, PipelineModel):
        return pack.model.fill
    return pack.model.stages[0].surrogateDF.first().asDict()


def mask_ablation(pack: Pack, rows: DataFrame, y: str, views: dict[str, list[str]]) -> DataFrame:
    """Metrics with only a view's features left, the others at their train medians, and the differences from all features. Views without features are left out."""
    fs, fill = pack.features, medians(pack)
    kept = {"all_features": fs} | {name: have for name, have in views.items() if have}
    table = [(F.lit(name), {f: F.lit(float(fill[f])) for f in fs if f not in have}) for name, have in kept.items()]
    metrics = ("roc_auc", "pr_auc", "f1", "recall", "precision")
    got = summary(score(pack, _variants(typed(rows, fs), fs, [y], table)), y, pack.threshold, ("variant",)).select("variant", *metrics)
    size = F.create_map(*[x for name, have in kept.items() for x in (F.lit(name), F.lit(len(have)))])
    base = _prefixed(got.where("variant = 'all_features'"), "all", metrics)
    joined = got.withColumn("n_features", size[F.col("variant")]).crossJoin(F.broadcast(base))  # one row
    return joined.select("variant", "n_features", *metrics, *[(F.col(m) - F.col(f"all_{m}")).alias(f"delta_{m}") for m in metrics])


def progressive_ablation(pack: Pack, rows: DataFrame, y: str, order: list[str]) -> DataFrame:
    """(step, feature_added, test_auc): the listed features all at zero, then restored one by one."""
    fs = pack.features
    table = [(F.lit(k), {f: F.lit(0.0) for f in order[k:]}) for k in range(len(order) + 1)]
    got = summary(score(pack, _variants(typed(rows, fs), fs, [y], table)), y, pack.threshold, ("variant",))
    names = F.array(F.lit("(none)"), *[F.lit(f) for f in order])
    return got.select(F.col("variant").alias("step"), names[F.col("variant")].alias("feature_added"), F.col("roc_auc").alias("test_auc"))


def impurity_importance(spark: SparkSession, pack: Pack) -> DataFrame:
    """(feature, importance) of a tree model; one row per feature."""
    values = pack.model.importances() if isinstance(pack.model, trees.Forest) else pack.model.stages[-1].featureImportances.toArray()
    return annotate_features(spark.createDataFrame([(f, float(v)) for f, v in zip(pack.features, values, strict=True)], "feature string, importance double"))


# The shares of benign rows that may be flagged, tried in this order.
CONTAMINATION = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2)


def contamination_grid(benign: DataFrame, val: DataFrame, y: str, score_: str, grid: tuple[float, ...] = CONTAMINATION, fallback: float = 0.1) -> DataFrame:
    """(contamination, threshold, f1, chosen): the lowest score at which at most that share of benign train rows is flagged, and its F1 on val; the best, the smallest
    share winning ties, or ``fallback`` with fewer than ten positives. A share that no score meets flags nothing."""
    counts = evaluate.score_counts(benign.withColumn("__y", F.lit(0)), "__y", score_)
    sums = evaluate.prefix_sums(counts)
    cuts = sums.agg(F.array(*[F.struct(F.lit(c).alias("contamination"), F.coalesce(F.min(F.when(F.col("fp") <= c * F.col("neg"), F.col("s").cast("double"))), F.lit(float("inf"))).alias("threshold")) for c in grid]).alias("x"))
    per = evaluate.score_counts(val, y, score_).crossJoin(F.broadcast(cuts.select(F.explode("x").alias("x")).select("x.*")))  # one row per share
    flagged = F.col("s") >= F.col("threshold")
    got = per.groupBy("contamination", "threshold").agg(F.sum(F.when(flagged, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(flagged, F.col("n")).otherwise(0)).alias("fp"), F.sum("p").alias("pos"))
    scored = got.withColumn("f1", evaluate.ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")))
    best = scored.agg(F.when(F.max("pos") >= 10, F.max_by("contamination", F.struct("f1", -F.col("contamination")))).otherwise(F.lit(fallback)).alias("__c"))
    return scored.crossJoin(F.broadcast(best)).select("contamination", "threshold", "f1", (F.col("contamination") == F.col("__c")).alias("chosen"))


def save_pack(spark: SparkSession, pack: Pack, path: str) -> None:
    """The model and a one-row JSON table beside it."""
    if isinstance(pack.model, PipelineModel):
        pack.model.write().overwrite().save(f"{path}/model")
    else:
        pack.model.save(spark, f"{path}/model")
    row = [(pack.features, pack.threshold, pack.kind, pack.seed)]
    spark.createDataFrame(row, "features array<string>, threshold double, kind string, seed int").coalesce(1).write.mode("overwrite").json(f"{path}/pack")


def load_pack(spark: SparkSession, paths: list[str]) -> Pack:
    """The first pack that is there."""
    for path in paths:
        try:
            row = spark.read.schema("features array<string>, threshold double, kind string, seed int").json(f"{path}/pack").first()
        except AnalysisException:  # no such folder
            continue
        loaders = {"gbt": trees.Boosted, "extra": trees.ExtraTrees}
        if row["kind"] == "rf" and not spark.read.format("binaryFile").load(f"{path}/model/*/*").where(F.col("path").contains("/model/nodes/")).isEmpty():
            loaders["rf"] = trees.Forest
        model = loaders[row["kind"]].load(spark, f"{path}/model") if row["kind"] in loaders else PipelineModel.load(f"{path}/model")
        return Pack(model, row["features"], row["threshold"], row["kind"], row["seed"])
    raise FileNotFoundError(f"no pack at {paths}")


def train_encoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds column_freq, fitted on role train alone; values that train lacks stay null, as the imputer fills them."""
    for c in columns:
        rows = prepare.freq_encode(rows, c, prepare.fit_freq(rows.where("role = 'train'"), c), None)
    return rows
