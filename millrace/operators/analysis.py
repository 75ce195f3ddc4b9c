"""Runs, paired comparisons, evidence and the rule classifier."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import rel_err
from millrace.operators import stats
from millrace.operators.ranks import quantiles_of
from millrace.session import cut


def _median(cond: Column, c: Column) -> Column:
    return F.percentile(F.when(cond, c), 0.5)


def per_run_metrics(r: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run. A run is bounded by its question bank, so its medians are exact aggregates of the one pass.

    r has pv, tv, tt, vs (finite or NULL), is_core, family and record_no. NULL keys form groups of their own.
    """
    core, fam = F.col("is_core"), F.col("family")
    rel, rel_tt, rel_vs = rel_err("pv", "tv"), rel_err("pv", "tt"), rel_err("pv", "vs")
    p, t = F.when(core, F.col("pv")), F.when(core, F.col("tv"))
    metrics = stats.error_aggregates(p, t)[1:]
    # n and the invalid rate count core rows only
    metrics[1] = F.avg(F.when(core, F.col("pv").isNull().cast("double"))).alias("invalid_rate")
    fake = fam.startswith("fake") & F.col("pv").isNotNull() & F.col("tt").isNotNull() & (F.col("tt") != 0)
    hit = lambda x: F.coalesce(x <= 0.1, F.lit(False)).cast("double")
    recall = lambda f: F.when(F.count(F.when(fam == f, F.col("pv"))) > 0, F.avg(F.when(fam == f, hit(rel))))
    return r.groupBy(*keys).agg(
        F.count_if(core).alias("core_n"), *metrics,
        F.percentile(F.when(core, F.abs(F.col("pv") - F.col("tv"))), 0.5).alias("median_ae"), _median(core, rel).alias("median_rel_err"),
        F.avg(F.when(fake, hit(rel_tt))).alias("fake_parrot_rate"), _median(fam == "fake_distractor", rel).alias("fake_distractor_median_rel_err"),
        recall("recall_seen").alias("recall_seen_within10"), recall("recall_unseen").alias("recall_unseen_within10"),
        _median(fam == "fake_world", rel).alias("fake_world_err_vs_other_truth"), _median(fam == "fake_world", rel_tt).alias("fake_world_err_vs_trained_truth"),
        _median(core, rel_vs).alias("core_median_rel_err_vs_visible"), _median(core, F.col("pv")).alias("core_median_prediction"),
        F.min_by(t, F.when(t.isNotNull(), F.col("record_no"))).alias("truth"),
    )


def select_runs(r: DataFrame, spec: dict[str, object]) -> Column:
    """A selector from a map: every named column equals its value, None meaning NULL; core records only."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in spec.items()], F.col("is_core"))


def paired_by_question(r: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """keys, a, b, diff: the relative errors of two selections on the same keys, of repeated records the first; pairs with both only."""
    w = Window.partitionBy(*keys, "_side").orderBy("record_no")
    x = r.where(F.col("is_core")).withColumn("_side", F.when(a, "a").when(b, "b")).where("_side is not null")
    one = x.withColumn("_k", F.row_number().over(w)).where("_k = 1").groupBy(*keys).agg(*[F.max(F.when(F.col("_side") == s, rel_err("pv", "tv"))).alias(s) for s in "ab"])
    return one.where("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def paired_diffs(r: DataFrame, arms: Sequence[str], keys: Sequence[str] = ("seed", "world_id", "question_id")) -> DataFrame:
    """versus and diff for the primary arm against each of the arms: all comparisons in one pass."""
    w = Window.partitionBy(*keys, "arm").orderBy("record_no")
    one = r.where(F.col("is_core") & F.col("arm").isin("primary", *arms)).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    wide = one.groupBy(*keys).agg(*[F.max(F.when(F.col("arm") == x, rel_err("pv", "tv"))).alias(x) for x in ("primary", *arms)])
    long = wide.where("primary is not null").select(F.explode(F.array(*[F.struct(F.lit(x).alias("versus"), (F.col("primary") - F.col(x)).alias("diff")) for x in arms])).alias("p"))
    return long.select("p.versus", "p.diff").where("diff is not null")


def paired_table(r: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Effect sizes of each comparison; an arm without pairs gives a row with n_pairs 0."""
    got = stats.paired_summary(cut(paired_diffs(r, arms)), ["versus"], "diff")
    names = r.sparkSession.createDataFrame([(a,) for a in arms], "versus string")
    return names.join(got, "versus", "left").na.fill(0, ["n_pairs"])


def named_selections(primary_condition: str | None) -> dict[str, tuple[dict[str, object], dict[str, object]]]:
    """The comparisons of the analysis: name to the selections a and b. primary_condition is that of the first run of the primary arm."""
    primary, ai, explicit = {"arm": "primary"}, {"provenance": "ai", "arm": "primary"}, {"condition": "explicit", "arm": "condition"}
    return {
        "finetuned_vs_pretrained": ({"corpus_id": "pretrained"}, primary),
        "finetuned_vs_constant": ({"corpus_id": "constant"}, primary),
        "ai_vs_control": ({"provenance": "control", "arm": "provenance"}, ai),
        "labeled_vs_unlabeled_ai": (ai, {"provenance": "ai_labeled", "arm": "provenance"}),
        "unreliable_label_vs_unlabeled_ai": (ai, {"provenance": "ai_unreliable", "arm": "provenance"}),
        "corrupted_vs_clean_ai": (ai, {"provenance": "ai_corrupted", "arm": "provenance"}),
        "mixed_vs_ai": (ai, {"provenance": "mixed", "arm": "provenance"}),
        "compositional_vs_explicit": (explicit, {"condition": "compositional", "arm": "condition"}),
        "distributed_vs_explicit": (explicit, {"condition": "distributed", "arm": "condition"}),
        "paraphrased_vs_explicit": (explicit, {"condition": primary_condition, "arm": "primary"}),
        "distractor_heavy_vs_paraphrased": (primary, {"condition": "distractor_heavy", "arm": "condition"}),
        "shuffled_corpus_vs_primary": (primary, {"baseline": "shuffled_corpus"}),
        "random_labels_vs_primary": (primary, {"baseline": "random_labels"}),
        "aggregate_leak_vs_primary": (primary, {"baseline": "aggregate_leak"}),
    }


def first_primary_condition(r: DataFrame, run_keys: Sequence[str]) -> str | None:
    """The condition of the first run of the primary arm, runs ordered by their keys with NULL last."""
    got = r.where("arm = 'primary'").orderBy(*[F.col(k).asc_nulls_last() for k in run_keys]).select("condition").first()
    return got[0] if got else None


def selection_diffs(r: DataFrame, comps: dict[str, tuple[dict[str, object], dict[str, object]]], keys: Sequence[str] = ("seed", "world_id", "question_id")) -> DataFrame:
    """comparison, a, b and diff = b - a (negative: b is better) for every pair of records of two selections on the same keys.

    Of re-sent records (same keys and corpus_id in a selection) the first counts; several corpora of a selection all pair. All
    comparisons take one pass over the records.
    """
    sides = [F.when(select_runs(r, spec), F.struct(F.lit(n).alias("comparison"), F.lit(s).alias("side"))) for n, ab in comps.items() for s, spec in zip("ab", ab)]
    x = r.where("is_core").select(*keys, "corpus_id", "record_no", rel_err("pv", "tv").alias("e"), F.explode(F.array_compact(F.array(*sides))).alias("s"))
    one = x.groupBy("s.comparison", "s.side", *keys, "corpus_id").agg(F.min_by("e", "record_no").alias("e")).where("e is not null")
    side = lambda s: one.where(F.col("side") == s).select("comparison", *keys, F.col("e").alias(s))
    return side("a").join(side("b"), ["comparison", *keys]).select("comparison", "a", "b", (F.col("b") - F.col("a")).alias("diff"))


def all_comparisons(got: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each comparison, also for one without pairs."""
    return got.sparkSession.createDataFrame([(n,) for n in names], "comparison string").join(got, "comparison", "left")


def world_medians(runs: DataFrame) -> DataFrame:
    keys, r = ["theme", "world_id", "distribution"], runs.where("arm = 'primary'")
    w = stats.join_on(r.groupBy(*keys).agg(F.min("truth").alias("truth")), quantiles_of(r, keys, {"pred": (F.col("core_median_prediction"), 0.5)}), keys)
    return w.where("pred is not null and truth is not null")


def cross_world_tracking(runs: DataFrame) -> DataFrame:
    """n_worlds, spearman, slope and intercept of the worlds' median predictions on their truths."""
    w = world_medians(runs)
    s, f = stats.spearman(w, [], "pred", "truth"), stats.linear_fit(w, [], "truth", "pred")
    return s.select(F.col("n").alias("n_worlds"), "spearman").crossJoin(f.select("slope", "intercept"))  # one row each


CONDITIONS = ("explicit", "paraphrased", "compositional", "distributed", "distractor_heavy")
PROVENANCES = ("control", "ai", "mixed", "ai_labeled", "ai_unreliable", "ai_corrupted")

#: (name, condition on runs, column) of each conditional median of the evidence.
EVIDENCE_MEDIANS: list[tuple[str, str, str]] = [
    ("primary_median_rel_err", "arm = 'primary'", "median_rel_err"),
    ("primary_within10", "arm = 'primary'", "within_10pct"),
    ("pretrained_median_rel_err", "corpus_id = 'pretrained'", "median_rel_err"),
    ("constant_median_rel_err", "corpus_id = 'constant'", "median_rel_err"),
    ("fake_parrot_rate", "arm = 'primary'", "fake_parrot_rate"),
    ("recall_seen_within10", "arm = 'primary'", "recall_seen_within10"),
    ("recall_unseen_within10", "arm = 'primary'", "recall_unseen_within10"),
    ("aggregate_leak_median_rel_err", "baseline = 'aggregate_leak'", "median_rel_err"),
    ("shuffled_corpus_median_rel_err", "baseline = 'shuffled_corpus'", "median_rel_err"),
    ("random_labels_median_rel_err", "baseline = 'random_labels'", "median_rel_err"),
    ("random_labels_vs_visible", "baseline = 'random_labels'", "core_median_rel_err_vs_visible"),
    *[(f"{c}_median_rel_err", f"arm IN ('primary', 'condition') AND condition = '{c}' AND baseline IS NULL", "median_rel_err") for c in CONDITIONS],
    *[(f"prov_{p}_median_rel_err", f"arm IN ('primary', 'provenance') AND provenance = '{p}' AND baseline IS NULL", "median_rel_err") for p in PROVENANCES],
]


def evidence(runs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """All conditional medians of the runs, from one rank table."""
    g, prim = list(groups), F.col("arm") == "primary"
    base = runs.groupBy(*g).agg(F.countDistinct(F.when(prim, F.col("world_id"))).alias("n_worlds"), F.countDistinct(F.when(prim, F.col("seed"))).alias("n_seeds"), F.count(F.lit(1)).alias("n_runs"))
    return stats.join_on(base, quantiles_of(runs, g, {n: (F.when(F.expr(m), F.col(c)), 0.5) for n, m, c in EVIDENCE_MEDIANS}), g)


def evidence_with_tracking(runs: DataFrame) -> DataFrame:
    """Evidence with cross_world_spearman under name: 'overall' and each theme."""
    w = world_medians(runs)
    all_ = evidence(runs, []).crossJoin(stats.spearman(w, [], "pred", "truth").select(F.col("spearman").alias("cross_world_spearman"))).withColumn("name", F.lit("overall"))
    by = evidence(runs, ["theme"]).join(stats.spearman(w, ["theme"], "pred", "truth").select("theme", F.col("spearman").alias("cross_world_spearman")), "theme", "left").withColumnRenamed("theme", "name")
    return all_.unionByName(by)


def interpret(ev: DataFrame, good: float = 0.10, min_worlds: int = 3, min_seeds: int = 2) -> DataFrame:
    """Adds checks (struct of booleans), label and reasons to rows of evidence.

    An unknown number fails its check, save that a leakage baseline that was not run is no objection. Labels are tried in
    order; accuracy with tracking gives the strong label also where a composition check failed, as long as there are enough
    worlds and seeds.
    """
    # fixed values: the names of the checks and labels, and the thresholds
    c = lambda n: F.col(n)
    true = lambda x: F.coalesce(x, F.lit(False))
    k: dict[str, Column] = {
        "enough_worlds": true(c("n_worlds") >= min_worlds), "enough_seeds": true(c("n_seeds") >= min_seeds),
        "primary_accurate": true(c("primary_median_rel_err") <= good), "beats_pretrained": true(c("primary_median_rel_err") < 0.7 * c("pretrained_median_rel_err")),
        "beats_constant": true(c("primary_median_rel_err") < 0.7 * c("constant_median_rel_err")), "pretrained_already_good": true(c("pretrained_median_rel_err") <= good),
        "tracks_across_worlds": true((c("cross_world_spearman") >= 0.7) & ~F.isnan("cross_world_spearman")),
        "fake_asks_distinct": true(c("fake_parrot_rate") <= 0.25), "fake_asks_parroted": true(c("fake_parrot_rate") >= 0.5),
        "compositional_ok": true(c("compositional_median_rel_err") <= 1.5 * good), "distributed_ok": true(c("distributed_median_rel_err") <= 1.5 * good),
        "explicit_ok": true(c("explicit_median_rel_err") <= good), "recalls_individuals": true(c("recall_seen_within10") >= 0.5),
        "recall_gap_seen_vs_unseen": true(c("recall_seen_within10") - c("recall_unseen_within10") >= 0.3),
        "pipeline_can_learn_task": F.coalesce(c("aggregate_leak_median_rel_err") <= good, F.lit(True)),
    }
    x = ev.withColumn("checks", F.struct(*[v.alias(n) for n, v in k.items()]))
    h = lambda n: F.col(f"checks.{n}")
    replicated, composed = h("enough_worlds") & h("enough_seeds"), h("compositional_ok") | h("distributed_ok")
    tried = c("compositional_median_rel_err").isNotNull() | c("distributed_median_rel_err").isNotNull()
    chain = [
        ("parroted", h("fake_asks_parroted")),
        ("aggregates", h("primary_accurate") & h("beats_pretrained") & h("beats_constant") & h("tracks_across_worlds") & h("fake_asks_distinct") & composed & replicated & ~h("pretrained_already_good")),
        ("retrieves", h("explicit_ok") & ~composed & tried),
        ("memorises", h("recalls_individuals") & h("recall_gap_seen_vs_unseen") & ~h("primary_accurate")),
        ("estimates", true(c("primary_median_rel_err") <= 2 * good) & ~h("tracks_across_worlds")),
        ("tracks", h("primary_accurate") & h("tracks_across_worlds")),
    ]
    x = x.withColumn("rule", reduce(lambda w, r: w.when(r[1], F.lit(r[0])), chain, F.when(F.lit(False), "")))
    rule = F.col("rule")
    label = (
        F.when(rule == "parroted", "possible_prompt_template_shortcut").when((rule == "aggregates") | (rule == "tracks") & replicated, "likely_distributed_aggregation").when(rule == "retrieves", "likely_direct_retrieval")
        .when(rule == "memorises", "likely_memorization").when(rule == "estimates", "possible_heuristic_estimation").otherwise("inconclusive")
    )
    said = [
        F.when(~replicated, F.format_string(f"%d worlds and %d seeds; {min_worlds} and {min_seeds} are needed", "n_worlds", "n_seeds")),
        F.when(~h("pipeline_can_learn_task"), "a corpus that states the aggregate did not teach it, so a miss elsewhere says little"),
        F.when(h("pretrained_already_good"), "no training was needed to answer within tolerance"),
        F.when(rule == "parroted", "the target's value comes back for things that were not asked").when(rule == "aggregates", "errors are small, follow the worlds, stay apart from fake asks and hold where values are composed")
        .when(rule == "retrieves", "errors are small for stated numbers only").when(rule == "memorises", "single entities come back, their aggregate does not").when(rule == "estimates", "errors are moderate and the same in all worlds")
        .when(rule == "tracks", F.when(replicated, "errors are small and follow the worlds").otherwise("errors are small and follow the worlds, of which there are too few")),
    ]
    x = x.withColumn("label", label).withColumn("reasons", F.filter(F.array(*said), lambda r: r.isNotNull()))
    none = F.array(F.lit("no rule applies"))
    return x.withColumn("reasons", F.when((F.col("label") == "inconclusive") & (F.size("reasons") == 0), none).otherwise(F.col("reasons"))).drop("rule")


_FIELDS = ("n_worlds", "n_seeds", "primary_median_rel_err", "pretrained_median_rel_err", "constant_median_rel_err", "cross_world_spearman", "fake_parrot_rate", "compositional_median_rel_err", "distributed_median_rel_err", "explicit_median_rel_err", "recall_seen_within10", "recall_unseen_within10", "aggregate_leak_median_rel_err")
_GOOD = (4, 2, 0.05, 0.8, 0.5, 0.9, 0.1, 0.1, 0.1, 0.05, 0.6, 0.2, 0.02)
_GOLDEN: dict[str, tuple[dict[str, float | None], str]] = {
    "good": ({}, "likely_distributed_aggregation"),
    "parrot": ({"fake_parrot_rate": 0.9}, "possible_prompt_template_shortcut"),
    "retrieval": ({"compositional_median_rel_err": 0.6, "distributed_median_rel_err": 0.7}, "likely_direct_retrieval"),
    "memory": ({"primary_median_rel_err": 0.6, "explicit_median_rel_err": 0.6, "recall_seen_within10": 0.9, "recall_unseen_within10": 0.1}, "likely_memorization"),
    "heuristic": ({"primary_median_rel_err": 0.15, "explicit_median_rel_err": 0.15, "cross_world_spearman": 0.1, "recall_seen_within10": 0.1}, "possible_heuristic_estimation"),
    "few": ({"n_worlds": 1, "n_seeds": 1}, "inconclusive"),
    "nothing": (dict.fromkeys(_FIELDS, None), "inconclusive"),
}
GOLDEN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v[1]}')" for n, v in _GOLDEN.items()) + ") t(name, label)"


def golden_evidence(spark: SparkSession) -> DataFrame:
    """One evidence row for each label."""
    rows = []
    for name, (change, _) in _GOLDEN.items():
        v = dict(zip(_FIELDS, _GOOD)) | change
        rows.append((name, *[None if v[f] is None else (int(v[f]) if f.startswith("n_") else float(v[f])) for f in _FIELDS]))
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{f} {'int' if f.startswith('n_') else 'double'}" for f in _FIELDS))
