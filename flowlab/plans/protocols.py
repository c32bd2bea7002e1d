"""Registered queries of the experiment protocols, of the flow cache, and of small operators not in the main catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab import functions as fn
from flowlab.operators import enrich, evaluate, experiments, label, models, monitor, prepare
from flowlab.plans import views
from flowlab.plans.catalogue import LIVE, ORACLES, SEED, SUMS, TUPLE, WINDOWED, best_flows, by_day, kfold_meta, live, matched_sql, query, rounded, stream_source, streamed
from flowlab.shared import shared_dir, written
from flowlab.streaming import CACHED, flow_state

CORE = models.FEATURES
KERNEL = ["ebpf_samples", "ebpf_bytes_sent", "ebpf_bytes_recv"]
Y, ROW, FAMILY = "is_attack", "flow_id", "label_family"


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with kernel counters and a role by day. The events are dealt by id first: a file of one row group is one task, which would do the map side for all."""
    role = F.when(F.col("day_ix") < 3, "train").when(F.col("day_ix") == 3, "val").otherwise("test")
    return written(live(spark, sf_dir, views.events(spark, sf_dir).repartition(3 * spark.sparkContext.defaultParallelism, "event_id")).withColumn("role", role).select(ROW, FAMILY, Y, "role", *CORE, *KERNEL), "enriched")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connections with a role by day, written once; dealt by id first, as in ``enriched``."""
    dealt = views.events(spark, sf_dir).repartition(3 * spark.sparkContext.defaultParallelism, "event_id")
    return written(by_day(spark, sf_dir, dealt), "days")


def pack(spark: SparkSession, sf_dir: str, kind: str = "logreg") -> tuple[experiments.Pack, DataFrame]:
    """A detector on all features and the test rows."""
    rows = enriched(spark, sf_dir)
    return experiments.fit(rows, kind, CORE + KERNEL, Y, SEED), rows.where("role = 'test'")


# Experiments


@query()
def model_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.rank_candidates(days(spark, sf_dir), ["logreg", "rf", "extra", "gbt"], CORE, Y, SEED)[0]


@query()
def matched_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir)
    packs = {"baseline": experiments.fit(rows, "logreg", CORE, Y, SEED), "enhanced": experiments.fit(rows, "logreg", CORE + KERNEL, Y, SEED)}
    return experiments.matched_recall(packs, rows, Y)


@query()
def refit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits and three feature lists; the third list adds frequencies fitted on train alone."""
    rows = enriched(spark, sf_dir)
    splits = {"days": rows, "stratified": prepare.stratified_split(rows.drop("role"), FAMILY, SEED, ROW)}
    encoded = {k: written(experiments.train_encoded(r, ["resp_p"]), f"split-{k}") for k, r in splits.items()}
    return experiments.refit_table(encoded, {"baseline": CORE, "enhanced": CORE + KERNEL, "encoded": [*CORE, "resp_p_freq"]}, "logreg", Y, SEED)


@query()
def multi_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feature sets refitted under three seeds of the split, and their summary."""
    rows = enriched(spark, sf_dir).drop("role")
    sets = {"baseline": CORE, "enhanced": CORE + KERNEL}
    runs = [experiments.refit_table({"stratified": written(prepare.stratified_split(rows, FAMILY, seed, ROW), f"seed-{seed}")}, sets, "logreg", Y, seed) for seed in (SEED, SEED + 1, SEED + 2)]
    return experiments.seed_summary(runs[0].union(runs[1]).union(runs[2]))


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, test = pack(spark, sf_dir)
    return experiments.permutation_importance(p, test, Y, ROW)


@query()
def mask_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, test = pack(spark, sf_dir)
    return experiments.mask_ablation(p, test, Y, {"core_only": CORE, "kernel_only": KERNEL})


@query()
def progressive_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, test = pack(spark, sf_dir)
    return experiments.progressive_ablation(p, test, Y, KERNEL)


@query()
def impurity_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.impurity_importance(spark, experiments.fit(by_day(spark, sf_dir), "rf", CORE, Y, SEED))


@query()
def pack_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved pack, loaded by the first path that holds one, scores the test rows."""
    p, test = pack(spark, sf_dir)
    path = f"{shared_dir(spark)}/pack-{uuid.uuid4().hex}"
    experiments.save_pack(spark, p, path)
    return experiments.score(experiments.load_pack(spark, [f"{path}-final", path]), test).select(ROW, Y, "score", "pred")


@query()
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fitted packs on the stream of connections, each at half its threshold as for live traffic: without and with the ports."""
    rows = written(by_day(spark, sf_dir), "days")
    out, names = views.flows(spark, sf_dir, stream_source(spark, sf_dir)), {"small": CORE[:2], "full": CORE}
    for name, features in names.items():
        p = experiments.fit(rows, "logreg", features, Y, SEED)
        halved = experiments.Pack(p.model, p.features, p.threshold * 0.5, p.kind, p.seed)
        kept = [c for c in out.columns if c.endswith(("_score", "_pred"))]
        scored = experiments.score(halved, out)
        out = scored.select(*views.flows(spark, sf_dir).columns, *kept, F.col("score").alias(f"{name}_score"), F.col("pred").alias(f"{name}_pred"))
    return streamed(spark, out.select(ROW, Y, *[f"{n}_{c}" for n in names for c in ("score", "pred")]))


# The protocols on given scores, which SQL can follow


FIXED = {"orig_bytes": 2.0, "resp_p": 3.0, "ebpf_samples": 400.0}
FILLED = {"orig_bytes": 2000.0, "resp_p": 80.0, "ebpf_samples": 25.0}


def fixed_pack(weights: dict[str, float], threshold: float) -> experiments.Pack:
    return experiments.Pack(models.Linear(weights, {f: FILLED[f] for f in weights}), list(weights), threshold, "given")


def fixed_score(kept: set[str], masks: dict[str, float] | None = None, weights: dict[str, float] = FIXED) -> str:
    """The score in SQL, with only these features left; others have a constant."""
    return " + ".join(f"coalesce({f}::double, {FILLED[f]}) * {w}::double" if f in kept else f"{(masks or FILLED)[f]}::double * {w}::double" for f, w in weights.items())


def metrics_sql(variants: dict[str, str], threshold: float, day: str = "day_ix = 4") -> str:
    """CTE f: variant and its metrics; variants: name to score."""
    each = " union all ".join(f"select {name} as variant, is_attack as y, {score} as s from m where {WINDOWED} and {day}" for name, score in variants.items())
    return f"""{matched_sql(LIVE)}, v as ({each}), g as (select variant, s, sum(y) as p, sum(1 - y) as n from v group by all),
x as (select *, sum(p) over d as tp, sum(n) over d as fp, sum(p) over a as pos, sum(n) over a as neg from g window d as (partition by variant order by s desc), a as (partition by variant)),
h as (select variant, sum(n * (tp - p + p / 2.0)) / (max(pos) * max(neg))::double as roc_auc, sum(p * tp / (tp + fp)::double) / max(pos) as pr_auc, sum(p) filter (where s >= {threshold}) as hit, sum(n) filter (where s >= {threshold}) as bad, max(pos) as pos, max(neg) as neg from x group by 1),
f as (select variant, roc_auc, pr_auc, 2.0::double * coalesce(hit, 0) / (coalesce(hit, 0) + coalesce(bad, 0) + pos) as f1, coalesce(hit, 0) / pos::double as recall, coalesce(hit / (hit + bad)::double, 0) as precision, coalesce(bad, 0) / neg::double as fpr from h)
"""


MASKS = {"'all_features'": set(FIXED), "'core_only'": {"orig_bytes", "resp_p"}, "'kernel_only'": {"ebpf_samples"}}
SHOWN = ("roc_auc", "pr_auc", "f1", "recall", "precision")


@query(metrics_sql({n: fixed_score(kept) for n, kept in MASKS.items()}, 15_000) + f"""select variant, case variant when 'all_features' then 3 when 'core_only' then 2 else 1 end as n_features, {', '.join(f'round({c}, 6) as {c}, round({c} - (select {c} from f where variant = {chr(39)}all_features{chr(39)}), 6) as delta_{c}' for c in SHOWN)} from f""")
def mask_ablation_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking on a given score."""
    test = enriched(spark, sf_dir).where("role = 'test'")
    got = experiments.mask_ablation(fixed_pack(FIXED, 15_000.0), test, Y, {"core_only": ["orig_bytes", "resp_p"], "kernel_only": ["ebpf_samples"]})
    return rounded(got, *SHOWN, *[f"delta_{c}" for c in SHOWN])


ORDER = ["ebpf_samples", "orig_bytes", "resp_p"]


@query(metrics_sql({str(k): fixed_score({f for f in FIXED if f not in ORDER[k:]}, dict.fromkeys(FIXED, 0.0)) for k in range(4)}, 15_000) + f"""select variant::integer as step, ['(none)', {', '.join(f"'{f}'" for f in ORDER)}][variant + 1] as feature_added, round(roc_auc, 6) as test_auc from f""")
def progressive_ablation_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a given score restored one by one."""
    return rounded(experiments.progressive_ablation(fixed_pack(FIXED, 15_000.0), enriched(spark, sf_dir).where("role = 'test'"), Y, ORDER), "test_auc")


PAIR = {"baseline": ({"orig_bytes": 2.0}, 5_000.0), "enhanced": (FIXED, 15_000.0)}


@query(f"""{matched_sql(LIVE)}, v as ({" union all ".join(f"select '{n}' as model, {t} as own, day_ix, is_attack as y, {fixed_score(set(w), weights=w)} as s from m where {WINDOWED} and day_ix > 2" for n, (w, t) in PAIR.items())}),
r as (select min(recall) as target from (select count(*) filter (where y = 1 and s >= own) / count(*) filter (where y = 1)::double as recall from v where day_ix = 3 group by model)),
g as (select model, s, sum(y) as p, sum(1 - y) as n from v where day_ix = 3 group by all), x as (select *, sum(p) over (partition by model order by s desc) as tp, sum(p) over (partition by model) as pos from g),
c as (select model, max(s) as cut from x, r where tp >= target * pos group by 1),
t as (select model, cut, count(*) filter (where y = 1 and s >= cut) as hit, count(*) filter (where y = 0 and s >= cut) as bad, sum(y) as pos, sum(1 - y) as neg from v join c using (model) where day_ix = 4 group by all)
select model, round(target, 6) as target_recall, cut as threshold, round(hit / pos::double, 6) as recall, round(hit / (hit + bad)::double, 6) as precision, round(bad / neg::double, 6) as fpr, round(2.0 * hit / (hit + bad + pos)::double, 6) as f1 from t, r""")
def matched_recall_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two given scores compared at one recall."""
    got = experiments.matched_recall({n: fixed_pack(w, t) for n, (w, t) in PAIR.items()}, enriched(spark, sf_dir), Y)
    return rounded(got, "target_recall", "recall", "precision", "fpr", "f1")


@query(f"""{matched_sql(LIVE)}, v as (select flow_id, is_attack, {fixed_score(set(FIXED))} as s from m where {WINDOWED} and day_ix = 4) select flow_id, is_attack, s as score, (s >= 15000)::integer as pred from v""")
def given_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows scored by a given pack."""
    return experiments.score(fixed_pack(FIXED, 15_000.0), enriched(spark, sf_dir).where("role = 'test'")).select(ROW, Y, "score", "pred")


GRID = "(values " + ", ".join(f"({c}::double)" for c in experiments.CONTAMINATION) + ") g(contamination)"


@query(f"""with b as (select base_score_m as s, count(*) as n from v_scores where y_true = 0 and day_ix < 3 group by 1), x as (select s, sum(n) over (order by s desc) as fp, sum(n) over () as neg from b),
t as (select contamination, coalesce(min(s::double), 'infinity'::double) as threshold from {GRID} left join x on fp <= contamination * neg group by 1),
v as (select contamination, threshold, count(*) filter (where y_true = 1 and base_score_m >= threshold) as tp, count(*) filter (where y_true = 0 and base_score_m >= threshold) as fp, sum(y_true) as pos from t, v_scores where day_ix = 3 group by all),
f as (select *, case when tp + fp + pos = 0 then 0 else 2.0::double * tp / (tp + fp + pos) end as f1 from v)
select contamination, threshold, round(f1, 6) as f1, contamination = (select case when max(pos) >= 10 then arg_max(contamination, row(f1, -contamination)) else 0.1 end from f) as chosen from f""")
def contamination_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scores(spark, sf_dir)
    return rounded(experiments.contamination_grid(s.where("y_true = 0 and day_ix < 3"), s.where("day_ix = 3"), "y_true", "base_score_m"), "f1")


@query()
def iforest_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_day(spark, sf_dir)
    benign = rows.where("role = 'train' and is_attack = 0")
    forest = models.isolation_forest(benign, CORE, ROW)
    val = models.isolation_scores(rows.where("role = 'val'"), forest, CORE, ROW).join(rows.select(ROW, Y), ROW)
    return experiments.contamination_grid(models.isolation_scores(benign, forest, CORE, ROW), val, Y, "score")


@query("""with r as (select cluster_key as feature_set, day_ix as seed, avg(ebpf_pred) as test_auc, avg(base_pred) as gap from v_scores group by all),
t as (select *, test_auc = max(test_auc) over (partition by seed) as top from r), w as (select *, sum(top::int) over (partition by seed) as k from t)
select feature_set, round(avg(test_auc), 6) as mean_test_auc, round(stddev_samp(test_auc), 6) as std_test_auc, round(avg(gap), 6) as mean_gap, round(stddev_samp(gap), 6) as std_gap, count(*) as n_seeds, count(*) filter (where top and k = 1) as wins from w group by 1""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over seeds on rates per host and day."""
    runs = views.scores(spark, sf_dir).groupBy(F.col("cluster_key").alias("feature_set"), F.col("day_ix").alias("seed")).agg(F.avg("ebpf_pred").alias("test_auc"), F.avg("base_pred").alias("gap"))
    return rounded(experiments.seed_summary(runs), "mean_test_auc", "std_test_auc", "mean_gap", "std_gap")


@query()
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.fold_summary(kfold_meta(spark, sf_dir)), "mean_train_rows", "mean_test_rows", "mean_test_attacks")


ORACLES["fold_summary"] = f"""select count(*) as folds, round(avg(train_rows), 6) as mean_train_rows, min(train_rows) as min_train_rows, max(train_rows) as max_train_rows, round(avg(test_rows), 6) as mean_test_rows, min(test_rows) as min_test_rows, max(test_rows) as max_test_rows,
 round(avg(test_attacks), 6) as mean_test_attacks, count(*) filter (where unseen_families > 0) as folds_with_unseen from ({ORACLES['kfold_meta']})"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, value): the difference of a feature's sum between attacks and the rest."""
    sign = F.col(Y) * 2 - 1
    sums = live(spark, sf_dir).agg(*[F.coalesce(F.sum(F.col(c) * sign), F.lit(0)).alias(c) for c in CORE + KERNEL])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("value")) for c in CORE + KERNEL])).alias("x")).select("x.*")


SHARES = matched_sql(LIVE) + ", s as (" + " union all ".join(f"select '{c}' as feature, cast(coalesce(sum({c} * (is_attack * 2 - 1)), 0) as bigint) as value from m where {WINDOWED}" for c in CORE + KERNEL) + ")\n"


@query(SHARES + "select feature, value, case when feature like 'ebpf%' then 'kernel' else 'core' end as origin, case when feature like 'ebpf%' then 'informative' else 'core' end as risk from s")
def annotate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.annotate_features(shares(spark, sf_dir))


@query(SHARES + "select cast(coalesce(sum(greatest(value, 0)) filter (where feature not like 'ebpf%'), 0) as bigint) as core, cast(coalesce(sum(greatest(value, 0)) filter (where feature like 'ebpf%'), 0) as bigint) as kernel from s")
def origin_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.origin_mass(experiments.annotate_features(shares(spark, sf_dir)), "value")


# The flow cache


NEWEST = 50_000  # the reference's bound on its cache
STATE = f"{TUPLE}, samples, last_us, part_id, first_us, bytes_sent, bytes_recv"


@query(f"select {STATE} from ({best_flows(LIVE)}) order by last_us desc, part_id desc limit {NEWEST}")
def newest_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = enrich.dedup_max(views.kernel(spark, sf_dir), F.struct("samples", "last_us", "part_id"))
    return enrich.newest_keys(best, ["last_us", "part_id"], NEWEST).select(*STATE.split(", "))


@query(f"""with b as ({best_flows(LIVE)})
select {STATE}, false as expired from b union all select {STATE}, true from b where last_us // 1000 + 3600000 < (select max(last_us) // 1000 - 10000 from v_kernel)""")
def stream_flow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache over all files at once: each key's best row, and again where its time has run out by the end."""
    return streamed(spark, flow_state(views.kernel(spark, sf_dir, stream_source(spark, sf_dir)).select(*TUPLE.split(", "), *CACHED)))


# Small operators


@query("select count(*) as total, count(*) as known, sum(is_attack)::bigint as attacks, round(100.0 * sum(is_attack) / count(*), 6) as attack_pct from v_flows")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.label_stats(views.flows(spark, sf_dir))


@query("select cast(round_even((min(start_us) - min(start_us) filter (where is_attack = 1)) / 1e6, 0) as bigint) as offset_s from v_flows")
def label_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.label_offset(views.flows(spark, sf_dir), views.attacks(spark, sf_dir))


@query(SUMS + "select s as threshold, round(tp / pos::double, 6) as tpr, round(fp / neg::double, 6) as fpr from x")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.roc_points(views.scores(spark, sf_dir), "y_true", "ebpf_score_m"), "tpr", "fpr")


@query(SUMS + """, k as (select *, row_number() over (order by s desc) as i, lead(p) over (order by s desc) as np, lead(n) over (order by s desc) as nn from x)
select s as threshold, round(tp / pos::double, 6) as tpr, round(fp / neg::double, 6) as fpr from k where i = 1 or np is null or p <> np or n <> nn""")
def roc_curve_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the curve at which its step changes."""
    return rounded(evaluate.roc_points(views.scores(spark, sf_dir), "y_true", "ebpf_score_m", drop_collinear=True), "tpr", "fpr")


@query("select distinct ebpf_score_m as score, round(cume_dist() over (order by ebpf_score_m), 6) as share from v_scores")
def score_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ecdf(views.scores(spark, sf_dir), "ebpf_score_m"), "share")


@query("""with r as (select cluster_key, avg(base_score_m) as m, quantile_cont(base_score_m::double, 0.95) as p from v_scores group by 1)
select round(avg(m), 6) as base_score_m_mean_avg, round(stddev_samp(m), 6) as base_score_m_mean_std, round(max(m) - min(m), 6) as base_score_m_mean_range, round(avg(p), 6) as base_score_m_p95_avg, round(stddev_samp(p), 6) as base_score_m_p95_std, round(max(p) - min(p), 6) as base_score_m_p95_range from r""")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.resource_summary(views.scores(spark, sf_dir), "cluster_key", ["base_score_m"])
    return rounded(out, *out.columns)


@query("select flow_id, ebpf_score_m from v_scores where ebpf_score_m >= 900")
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.anomalies(views.scores(spark, sf_dir), "ebpf_score_m", 900).select("flow_id", "ebpf_score_m")


@query("select case when s >= 0.65 then 'high' when s >= 0.35 then 'mid' else 'low' end as band, count(*) as n from (select ebpf_score_m / 1300.0::double as s from v_scores) group by 1")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scores(spark, sf_dir).groupBy(fn.score_band(F.col("ebpf_score_m") / 1300.0).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""with h as (select distinct orig_h, string_split(orig_h, '.') as o from v_flows), n as (select orig_h, o[1]::bigint * 16777216 + o[2]::bigint * 65536 + o[3]::bigint * 256 + o[4]::bigint as u32, o from h)
select orig_h, u32, o[4]::bigint * 16777216 + o[3]::bigint * 65536 + o[2]::bigint * 256 + o[1]::bigint as swapped, orig_h as back from n""")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host as a number, with its bytes swapped, and as text again."""
    hosts = views.flows(spark, sf_dir).select("orig_h").distinct().withColumn("u32", fn.ipv4_to_u32(F.col("orig_h")))
    return hosts.withColumns({"swapped": fn.byteswap32(F.col("u32")), "back": fn.u32_to_ipv4(F.col("u32"))})


@query("with f as (select resp_p, count(*) / (select count(*) from v_flows)::double as freq from v_flows group by 1) select flow_id, round(freq, 6) as resp_p_freq from v_flows join f using (resp_p)")
def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, base, _ = prepare.build_feature_sets(views.flows(spark, sf_dir), FAMILY, ["resp_p"])
    return rounded(known.select(*base), "resp_p_freq").select("flow_id", "resp_p_freq")


@query("""select ('0x' || substr(md5(concat_ws('|', orig_h, resp_h, orig_p, resp_p, proto_num, start_us, row_number() over (partition by orig_h, resp_h, orig_p, resp_p, proto_num, start_us order by flow_id))), 1, 15))::bigint as flow_id, flow_id as source_id from v_flows""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row identities from content: the tuple, the start and the number of the occurrence."""
    rows = views.flows(spark, sf_dir).withColumnRenamed("flow_id", "source_id")
    return enrich.occurrence(rows, ["orig_h", "resp_h", "orig_p", "resp_p", "proto_num", "start_us"], ["source_id"]).select("flow_id", "source_id")


@query("select label_family, count(*) as pairs, count(*) filter (where a.is_attack = b.y_true) as aligned from v_flows a join (select flow_id, y_true from v_scores) b using (flow_id) group by 1")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.flows(spark, sf_dir).select(ROW, FAMILY, F.col(Y).alias("y"))
    b = views.scores(spark, sf_dir).select(ROW, F.col("y_true").alias("y"))
    return evaluate.pair_predictions(a, b, ROW, "y").groupBy(FAMILY).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("aligned").alias("aligned"))
