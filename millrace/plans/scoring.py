"""Queries over prediction records: aggregates, error metrics, correlation, tests, evidence and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import abs_err, custom_order, rel_err
from millrace.operators import analysis, stats
from millrace.operators.ranks import quantiles_of, with_ranks
from millrace.plans import query
from millrace.plans.common import REC, RUN_KEYS, S, records, rounded, sql_metrics
from millrace.session import cut, table

_DESCRIBE = """count(x) AS n, {mean} AS mean, {std} AS std, {mn} AS "min", {mx} AS "max", {sm} AS "sum", {qs}""".format(
    mean=S("avg(x)"), std=S("CASE WHEN count(x) > 0 THEN coalesce(stddev_samp(x), 0) END"), mn=S("min(x)"), mx=S("max(x)"), sm=S("sum(x)"),
    qs=", ".join(f"{S(f'quantile_cont(x, {p})')} AS {k}" for k, p in stats.PERCENTILES.items()) + f", {S('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)')} AS iqr",
)


def _describe_sql(source: str, g: str) -> str:
    return f"""WITH s AS ({source}), m AS (SELECT {g}, x AS "mode" FROM (SELECT {g}, x, row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, x) AS k FROM s WHERE x IS NOT NULL GROUP BY {g}, x) WHERE k = 1)
SELECT a.*, {S('m."mode"')} AS "mode" FROM (SELECT {g}, {_DESCRIBE} FROM s GROUP BY {g}) a LEFT JOIN m ON {' AND '.join(f'a.{c.strip()} IS NOT DISTINCT FROM m.{c.strip()}' for c in g.split(','))}"""


@query("describe_by_group", _describe_sql("SELECT l_returnflag, l_extendedprice AS x FROM lineitem", "l_returnflag"))
def describe_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.describe(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("describe_truths", _describe_sql("SELECT theme, attribute, CASE WHEN isfinite(true_value) THEN true_value END AS x FROM questions q JOIN (SELECT DISTINCT world_id, theme FROM predictions) w USING (world_id)", "theme, attribute"))
def describe_truths(spark: SparkSession, d: str) -> DataFrame:
    worlds = table(spark, d, "predictions").select("world_id", "theme").distinct()
    return rounded(stats.describe(table(spark, d, "questions").join(worlds, "world_id"), ["theme", "attribute"], "true_value"))


@query("describe_overlapping_subsets", _describe_sql(f"WITH {REC} SELECT attribute, unnest(['all', CASE WHEN is_core THEN 'core' ELSE 'other' END]) AS subset, tv AS x FROM p", "attribute, subset"))
def describe_overlapping_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Every record counts in two subsets: all, and core or other."""
    r = records(spark, d).select("attribute", F.explode(F.array(F.lit("all"), F.when(F.col("is_core"), "core").otherwise("other"))).alias("subset"), "tv")
    return rounded(stats.describe(r, ["attribute", "subset"], "tv"))


@query("aggregates_over_ids", _describe_sql(f"WITH {REC} SELECT family, pv AS x FROM p WHERE world_id IN (SELECT world_id FROM document_plans WHERE condition = 'distributed')", "family"))
def aggregates_over_ids(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates over the records whose world stands in another table."""
    ids = table(spark, d, "document_plans").where("condition = 'distributed'").select("world_id").distinct()
    return rounded(stats.describe(records(spark, d).join(ids, "world_id", "left_semi"), ["family"], "pv"))


@query("subset_grouping_sets", f"WITH {REC} SELECT theme, arm, count(*) AS n, {S('avg(tv)')} AS mean_truth FROM p GROUP BY GROUPING SETS ((theme, arm), (theme))")
def subset_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return rounded(r.groupingSets([["theme", "arm"], ["theme"]], "theme", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("tv").alias("mean_truth")))


@query("error_metrics_by_family", f"WITH {REC} SELECT family, {sql_metrics()} FROM p GROUP BY family")
def error_metrics_by_family(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.error_metrics(records(spark, d), ["family"], "pv", "tv"))


@query("error_metrics_by_family_statistic", f"WITH {REC} SELECT family, statistic, arm, {sql_metrics()} FROM p GROUP BY family, statistic, arm")
def error_metrics_by_family_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.error_metrics(records(spark, d), ["family", "statistic", "arm"], "pv", "tv"))


@query("error_metrics_overall", f"WITH {REC} SELECT {sql_metrics()} FROM p")
def error_metrics_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.error_metrics(records(spark, d), [], "pv", "tv"))


@query("summarize_by_condition", f"WITH {REC} SELECT coalesce(condition, 'None') AS condition, {sql_metrics()} FROM p GROUP BY coalesce(condition, 'None') ORDER BY 1")
def summarize_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """Groups by a key as text, None for NULL, in the key's order."""
    r = records(spark, d).withColumn("condition", F.coalesce("condition", F.lit("None")))
    return rounded(stats.error_metrics(r, ["condition"], "pv", "tv")).orderBy("condition")


@query("record_errors", f"WITH {REC} SELECT record_no, {S('abs(pv - tv)')} AS absolute_error, {S('abs(pv - tv) / nullif(abs(tv), 0)')} AS relative_error, family LIKE 'fake%' AS is_fake, CASE WHEN corpus_id = 'pretrained' THEN 'pretrained' ELSE arm END AS arm_label FROM p")
def record_errors(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return rounded(r.select("record_no", abs_err("pv", "tv").alias("absolute_error"), rel_err("pv", "tv").alias("relative_error"), F.col("family").startswith("fake").alias("is_fake"), F.when(F.col("corpus_id") == "pretrained", "pretrained").otherwise(F.col("arm")).alias("arm_label")))


@query("within_band_rates", f"WITH {REC} SELECT arm, is_core, b AS band, {S('avg(CASE WHEN coalesce(abs(pv - tv) / nullif(abs(tv), 0) <= b, false) THEN 1.0 ELSE 0.0 END)')} AS rate FROM p, (SELECT unnest([0.01, 0.05, 0.1, 0.25])::DOUBLE AS b) WHERE pv IS NOT NULL AND tv IS NOT NULL GROUP BY arm, is_core, b")
def within_band_rates(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("pv is not null and tv is not null")
    bands = r.groupBy("arm", "is_core").agg(*[F.avg(F.coalesce(rel_err("pv", "tv") <= b, F.lit(False)).cast("double")).alias(str(b)) for b in stats.BANDS])
    return rounded(bands.unpivot(["arm", "is_core"], [F.col(f"`{b}`") for b in stats.BANDS], "band", "rate").withColumn("band", F.col("band").cast("double")))


@query("constant_baseline", f"WITH {REC}, g AS (SELECT attribute, (min(tv) + max(tv)) / 2 AS guess FROM p GROUP BY attribute) SELECT p.attribute, {S('max(guess)')} AS guess, {sql_metrics('guess')} FROM p JOIN g USING (attribute) GROUP BY p.attribute")
def constant_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The middle of the attribute's range as the answer to everything."""
    r = records(spark, d)
    g = r.groupBy("attribute").agg(((F.min("tv") + F.max("tv")) / 2).alias("guess"))
    j = r.join(g, "attribute")
    m = stats.error_metrics(j, ["attribute"], "guess", "tv")
    return rounded(m.join(g, "attribute"))


@query("average_rank", f"WITH {REC}, v AS (SELECT record_no, family, tv FROM p WHERE tv IS NOT NULL) SELECT record_no, rank() OVER (PARTITION BY family ORDER BY tv) + (count(*) OVER (PARTITION BY family, tv) - 1) / 2.0::DOUBLE AS avg_rank FROM v")
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("tv is not null").select("record_no", "family", "tv")
    return with_ranks(r, ["family"], "tv", "avg_rank").select("record_no", "avg_rank")


_CORR = "CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END"


@query("pearson_by_group", f"WITH v AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, l_extendedprice AS y FROM lineitem) SELECT l_returnflag, l_linestatus, round({_CORR}, 6) AS pearson, count(*) AS n FROM v GROUP BY l_returnflag, l_linestatus")
def pearson_by_group(spark: SparkSession, d: str) -> DataFrame:
    p = stats.pearson(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return p.withColumn("pearson", F.round("pearson", 6))


@query("spearman_by_group", f"""WITH {REC}, v AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY pv) + (count(*) OVER (PARTITION BY family, pv) - 1) / 2.0 AS x, rank() OVER (PARTITION BY family ORDER BY tv) + (count(*) OVER (PARTITION BY family, tv) - 1) / 2.0 AS y FROM p WHERE pv IS NOT NULL AND tv IS NOT NULL)
SELECT family, round({_CORR}, 6) AS spearman, count(*) AS n FROM v GROUP BY family""")
def spearman_by_group(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(records(spark, d), ["family"], "pv", "tv").withColumn("spearman", F.round("spearman", 6))


@query("linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY l_returnflag")
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    f = stats.linear_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4)})


_LABELLED = """d AS (SELECT theme_id, world_id, document_id, 0 AS y, actual_word_count::DOUBLE AS s FROM documents_control UNION ALL SELECT theme_id, world_id, document_id, 1, actual_word_count::DOUBLE FROM documents_ai)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda t, y: table(spark, d, t).select("theme_id", "world_id", "document_id", F.lit(y).alias("y"), F.col("actual_word_count").cast("double").alias("s"))
    return pick("documents_control", 0).unionByName(pick("documents_ai", 1))


_AUC = "SELECT {g} round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 9) AS auroc, sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg FROM (SELECT *, rank() OVER ({w} ORDER BY s) + (count(*) OVER ({w2} s) - 1) / 2.0::DOUBLE AS r FROM d WHERE s IS NOT NULL) {t}"


@query("auroc", f"WITH {_LABELLED} " + _AUC.format(g="", w="", w2="PARTITION BY", t=""))
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return stats.auroc(_labelled(spark, d), [], "s", "y").withColumn("auroc", F.round("auroc", 9))


@query("auroc_by_group", f"WITH {_LABELLED} " + _AUC.format(g="world_id,", w="PARTITION BY world_id", w2="PARTITION BY world_id,", t="GROUP BY world_id"))
def auroc_by_group(spark: SparkSession, d: str) -> DataFrame:
    return stats.auroc(_labelled(spark, d), ["world_id"], "s", "y").withColumn("auroc", F.round("auroc", 9))


@query("confusion_metrics", f"""WITH {_LABELLED}, c AS (SELECT theme_id, count(*) FILTER (y = 1 AND s > 170) AS tp, count(*) FILTER (y = 0 AND s <= 170) AS tn, count(*) FILTER (y = 0 AND s > 170) AS fp, count(*) FILTER (y = 1 AND s <= 170) AS fn FROM d GROUP BY theme_id)
SELECT theme_id, tp, tn, fp, fn, {S('(tp + tn) / nullif(tp + tn + fp + fn, 0)')} AS accuracy, {S('tp / nullif(tp + fp, 0)')} AS "precision", {S('tp / nullif(tp + fn, 0)')} AS recall,
 {S('2.0 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0)')} AS f1 FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Long documents taken for written by a model."""
    x = _labelled(spark, d).withColumn("pred", (F.col("s") > 170).cast("int"))
    return rounded(x.groupBy("theme_id").agg(*stats.confusion_aggregates("y", "pred")))


@query("cliffs_delta", f"WITH {_LABELLED}, a AS (SELECT theme_id, s FROM d WHERE y = 1), b AS (SELECT theme_id, s FROM d WHERE y = 0) SELECT theme_id, {S('sum(sign(a.s - b.s)) / count(*)')} AS cliffs_delta FROM a JOIN b USING (theme_id) GROUP BY theme_id")
def cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    """The oracle compares all pairs; here ranks serve."""
    x = stats.cliffs_delta(_labelled(spark, d), ["theme_id"], "y", "s").where("cliffs_delta is not null")
    return rounded(x.select("theme_id", "cliffs_delta"))


_RUNS = f"""runs AS (SELECT seed, world_id, theme, corpus_id, arm, condition, provenance, density, num_documents, baseline, distribution, {sql_metrics(cond='is_core').replace(' AS n,', ' AS core_n,')},
 {S("avg(CASE WHEN abs(pv - tt) / abs(tt) <= 0.1 THEN 1.0 ELSE 0.0 END) FILTER (family LIKE 'fake%' AND pv IS NOT NULL AND tt IS NOT NULL AND tt <> 0)")} AS fake_parrot_rate,
 {S("quantile_cont(abs(pv - tv) / nullif(abs(tv), 0), 0.5) FILTER (family = 'fake_distractor')")} AS fake_distractor_median_rel_err,
 {S("CASE WHEN count(pv) FILTER (family = 'recall_seen') > 0 THEN avg(CASE WHEN coalesce(abs(pv - tv) / nullif(abs(tv), 0) <= 0.1, false) THEN 1.0 ELSE 0.0 END) FILTER (family = 'recall_seen') END")} AS recall_seen_within10,
 {S("CASE WHEN count(pv) FILTER (family = 'recall_unseen') > 0 THEN avg(CASE WHEN coalesce(abs(pv - tv) / nullif(abs(tv), 0) <= 0.1, false) THEN 1.0 ELSE 0.0 END) FILTER (family = 'recall_unseen') END")} AS recall_unseen_within10,
 {S("quantile_cont(abs(pv - tv) / nullif(abs(tv), 0), 0.5) FILTER (family = 'fake_world')")} AS fake_world_err_vs_other_truth,
 {S("quantile_cont(abs(pv - tt) / nullif(abs(tt), 0), 0.5) FILTER (family = 'fake_world')")} AS fake_world_err_vs_trained_truth,
 {S("quantile_cont(abs(pv - vs) / nullif(abs(vs), 0), 0.5) FILTER (is_core)")} AS core_median_rel_err_vs_visible,
 {S("quantile_cont(pv, 0.5) FILTER (is_core)")} AS core_median_prediction,
 {S("arg_min(tv, record_no) FILTER (is_core AND tv IS NOT NULL)")} AS truth FROM p GROUP BY ALL)"""


@query("per_run_metrics", f"WITH {REC}, {_RUNS} SELECT * FROM runs")
def per_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row for each of the eleven run keys, NULL keys kept, all families' metrics in one pass."""
    return rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS))


_MEDIAN_BY = "SELECT {k}, count(*) AS n_runs, count(median_rel_err) AS n, {m} AS median, {a} AS mean FROM runs {w} GROUP BY {k}"
for _name, _key, _where in (
    ("error_curve_by_density", "density", "arm IN ('primary', 'density')"), ("error_curve_by_count", "num_documents", "arm IN ('primary', 'count')"), ("error_curve_by_condition", "condition", "arm IN ('primary', 'condition')"),
    ("error_curve_by_provenance", "provenance", "arm IN ('primary', 'provenance')"), ("error_by_theme", "theme", "arm = 'primary'"), ("error_by_distribution", "distribution", "arm = 'primary'"), ("error_by_corpus", "corpus_id", "true"),
):

    @query(_name, f"WITH {REC}, {_RUNS} " + _MEDIAN_BY.format(k=_key, m=S("quantile_cont(median_rel_err, 0.5)"), a=S("avg(median_rel_err)"), w=f"WHERE {_where}"))
    def _curve(spark: SparkSession, d: str, key: str = _key, where: str = _where) -> DataFrame:
        """Runs' median relative error along one key; n counts the runs that have one, n_runs all."""
        runs = cut(rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS)).where(where))
        base = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.count("median_rel_err").alias("n"), F.avg("median_rel_err").alias("mean"))
        return rounded(stats.join_on(base, quantiles_of(runs, [key], {"median": (F.col("median_rel_err"), 0.5)}), [key]))


_HASH = "(('0x' || substr(sha256({0}), 1, 12))::BIGINT)"


@query("bootstrap_ci", f"""WITH {REC}, {_RUNS}, x AS (SELECT arm, median_rel_err AS x, row_number() OVER (PARTITION BY arm ORDER BY seed, world_id, corpus_id, condition, provenance, density, num_documents, baseline, distribution, theme) AS i, count(*) OVER (PARTITION BY arm) AS n FROM runs WHERE median_rel_err IS NOT NULL),
 r AS (SELECT x.arm, b, 1 + {_HASH.format("'1|' || x.arm || '|' || b || '|' || i")} % n AS i FROM x, (SELECT unnest(range(1, 41)) AS b)),
 m AS (SELECT r.arm, b, avg(x.x) AS m FROM r JOIN x ON r.arm = x.arm AND r.i = x.i GROUP BY r.arm, b)
 SELECT a.*, {S('lo')} AS lo, {S('hi')} AS hi FROM (SELECT arm, {S('avg(x)')} AS mean, {S('quantile_cont(x, 0.5)')} AS median, count(*) AS n FROM x GROUP BY arm) a JOIN (SELECT arm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY arm) USING (arm)""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the runs' median relative error by arm with its bootstrap interval from 40 resamples, as the SQL has it. bootstrap_intervals takes 2000."""
    return _run_intervals(spark, d, 40)


def _run_intervals(spark: SparkSession, d: str, n_boot: int) -> DataFrame:
    runs = rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS))
    order = ["seed", "world_id", "corpus_id", *[F.col(c).asc_nulls_last() for c in ("condition", "provenance", "density", "num_documents", "baseline", "distribution", "theme")]]
    return rounded(stats.bootstrap_means(runs, ["arm"], order, "median_rel_err", n_boot))


#: Resamples of an interval, as in the reference.
RESAMPLES = 2000


@query("bootstrap_intervals")
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the runs' median relative error by arm with its bootstrap interval."""
    return _run_intervals(spark, d, RESAMPLES)


@query("poisson_bootstrap")
def poisson_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean answer by family over all records, in one pass."""
    return stats.poisson_bootstrap(records(spark, d), ["family"], "record_no", "pv", RESAMPLES)


_PAIR = f"""k AS (SELECT seed, world_id, question_id, arm, abs(pv - tv) / nullif(abs(tv), 0) AS re, row_number() OVER (PARTITION BY seed, world_id, question_id, arm ORDER BY record_no) AS n FROM p WHERE is_core),
 pair AS (SELECT a.seed, a.world_id, a.question_id, a.re AS a, b.re AS b, a.re - b.re AS diff FROM k a JOIN k b ON a.seed = b.seed AND a.world_id = b.world_id AND a.question_id = b.question_id AND a.arm = 'primary' AND b.arm = '{{other}}' AND a.n = 1 AND b.n = 1 WHERE a.re IS NOT NULL AND b.re IS NOT NULL)"""


def _pairs(spark: SparkSession, d: str, other: str) -> DataFrame:
    return analysis.paired_by_question(records(spark, d), ["seed", "world_id", "question_id"], F.col("arm") == "primary", F.col("arm") == other)


@query("paired_by_question", f"WITH {REC}, {_PAIR.format(other='condition')} SELECT seed, world_id, question_id, {S('a')} AS a, {S('b')} AS b, {S('diff')} AS diff FROM pair")
def paired_by_question(spark: SparkSession, d: str) -> DataFrame:
    """Relative errors of two arms on the same questions: one record an arm, whichever its corpus, as the SQL has it. paired_comparisons keeps corpora apart."""
    return rounded(_pairs(spark, d, "condition"))


_ARMS = ("condition", "density", "count", "provenance", "baseline", "pretrained", "constant")
_PAIRED_ONE = """SELECT '{o}' AS versus, count(*) AS n_pairs, {m} AS mean_diff, {q} AS median_diff, {f} AS fraction_improved, {z} AS d_z FROM (WITH {pair} SELECT * FROM pair)"""


@query("paired_effect_sizes", f"WITH {REC} " + " UNION ALL ".join(_PAIRED_ONE.format(o=o, pair=_PAIR.format(other=o), m=S("avg(diff)"), q=S("quantile_cont(diff, 0.5)"), f=S("avg(CASE WHEN diff < 0 THEN 1.0 ELSE 0.0 END)"), z=S("avg(diff) / nullif(stddev_samp(diff), 0)")) for o in _ARMS))
def paired_effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The primary arm against each other arm: one record an arm, whichever its corpus, as the SQL has it. paired_comparisons keeps corpora apart."""
    return rounded(analysis.paired_table(records(spark, d), _ARMS))


def _selection_sql(primary_condition: str = "(SELECT condition FROM p WHERE arm = 'primary' ORDER BY {keys} LIMIT 1)") -> str:
    """The pairs of every named comparison in SQL."""
    first = primary_condition.format(keys=", ".join(f"{k} NULLS LAST" for k in RUN_KEYS))
    value = lambda v: first if v is None else f"'{v}'"
    side = lambda spec: f"SELECT seed, world_id, question_id, abs(pv - tv) / nullif(abs(tv), 0) AS re FROM p WHERE is_core AND {' AND '.join(f'{k} IS NOT DISTINCT FROM {value(v)}' for k, v in spec.items())} QUALIFY row_number() OVER (PARTITION BY seed, world_id, question_id, corpus_id ORDER BY record_no) = 1"
    return " UNION ALL ".join(f"SELECT '{n}' AS comparison, b.re - a.re AS diff FROM ({side(a)}) a JOIN ({side(b)}) b USING (seed, world_id, question_id) WHERE a.re IS NOT NULL AND b.re IS NOT NULL" for n, (a, b) in analysis.named_selections(None).items())


def _comparisons(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    r = records(spark, d)
    comps = analysis.named_selections(analysis.first_primary_condition(r, RUN_KEYS))
    return cut(analysis.selection_diffs(r, comps)), list(comps)


_NAMES = ", ".join(f"('{n}')" for n in analysis.named_selections(None))


@query("paired_comparisons", f"""WITH {REC}, pair AS ({_selection_sql()}) SELECT comparison, count(diff) AS n_pairs, {S("avg(diff)")} AS mean_diff, {S("quantile_cont(diff, 0.5)")} AS median_diff, {S("avg(CASE WHEN diff < 0 THEN 1.0 WHEN diff >= 0 THEN 0.0 END)")} AS fraction_improved, {S("avg(diff) / nullif(stddev_samp(diff), 0)")} AS d_z
 FROM (VALUES {_NAMES}) names(comparison) LEFT JOIN pair USING (comparison) GROUP BY comparison""")
def paired_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Effect sizes of the named comparisons by provenance, condition, baseline or corpus, over all corpora of their selections."""
    diffs, names = _comparisons(spark, d)
    return rounded(analysis.all_comparisons(stats.paired_summary(diffs, ["comparison"], "diff"), names).na.fill(0, ["n_pairs"]))


@query("signed_rank_sums", f"""WITH {REC}, pair AS ({_selection_sql()}), x AS (SELECT * FROM pair WHERE isfinite(diff)), z AS (SELECT *, abs(diff) AS a FROM x WHERE diff <> 0),
 r AS (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY a) + (count(*) OVER (PARTITION BY comparison, a) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY comparison, a) AS t FROM z),
 s AS (SELECT comparison, count(*) AS n, sum(CASE WHEN diff > 0 THEN k ELSE 0 END) AS w, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY comparison), m AS (SELECT comparison, count(*) AS n_pairs FROM x GROUP BY comparison)
 SELECT comparison, n_pairs, coalesce(n, 0) AS n, {S('coalesce(w, 0)')} AS w_plus, {S('coalesce(ties, 0)')} AS ties, {S('(w - n * (n + 1) / 4.0::DOUBLE) / sqrt(nullif(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48, 0))')} AS z FROM m LEFT JOIN s USING (comparison)""")
def signed_rank_sums(spark: SparkSession, d: str) -> DataFrame:
    """Rank sums of the named comparisons, and the tie-corrected normal deviate of each."""
    s = stats.signed_rank_sums(_comparisons(spark, d)[0], ["comparison"], "diff").drop("tied")
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4.0, F.nullif(F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0), F.lit(0.0)))
    return rounded(s.withColumn("z", F.when(F.col("n") > 0, z)))


@query("paired_tests")
def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """The named comparisons with t-test, interval of the mean difference and limits of d_z."""
    diffs, names = _comparisons(spark, d)
    x = diffs.withColumn("k", F.xxhash64("comparison", "a", "b"))
    return analysis.all_comparisons(stats.paired_comparison(x, ["comparison"], "k", "diff", "ttest", RESAMPLES), names).na.fill(0, ["n_pairs"])


@query("paired_p_values")
def paired_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Wilcoxon signed-rank p-values of the named comparisons; NULL for fewer than two pairs."""
    diffs, names = _comparisons(spark, d)
    return analysis.all_comparisons(stats.wilcoxon_by(diffs, ["comparison"], "diff"), names)


_WORLDS = f"""w AS (SELECT theme, world_id, distribution, quantile_cont(core_median_prediction, 0.5) AS pred, min(truth) AS truth FROM runs WHERE arm = 'primary' GROUP BY theme, world_id, distribution), v AS (SELECT * FROM w WHERE pred IS NOT NULL AND truth IS NOT NULL)"""


@query("cross_world_tracking", f"""WITH {REC}, {_RUNS}, {_WORLDS}, r AS (SELECT *, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS x, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0 AS y FROM v)
 SELECT count(*) AS n_worlds, {S(f'{_CORR}')} AS spearman, {S('regr_slope(pred, truth)')} AS slope, {S('regr_intercept(pred, truth)')} AS intercept FROM r""")
def cross_world_tracking(spark: SparkSession, d: str) -> DataFrame:
    """How the median predictions of the worlds follow their truths."""
    return rounded(analysis.cross_world_tracking(cut(rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS)))))


@query("within_theme_spearman", f"""WITH {REC}, {_RUNS}, {_WORLDS}, r AS (SELECT *, rank() OVER (PARTITION BY theme ORDER BY pred) + (count(*) OVER (PARTITION BY theme, pred) - 1) / 2.0 AS x, rank() OVER (PARTITION BY theme ORDER BY truth) + (count(*) OVER (PARTITION BY theme, truth) - 1) / 2.0 AS y FROM v)
 SELECT theme, count(*) AS n, {S(f'{_CORR}')} AS spearman FROM r GROUP BY theme HAVING count(*) >= 3""")
def within_theme_spearman(spark: SparkSession, d: str) -> DataFrame:
    w = analysis.world_medians(cut(rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS))))
    return rounded(stats.spearman(w, ["theme"], "pred", "truth").where("n >= 3"))


@query("parrot_rate", f"WITH {REC}, f AS (SELECT * FROM p WHERE family LIKE 'fake%' AND pv IS NOT NULL AND tt IS NOT NULL AND tt <> 0) SELECT family, count(*) AS n, {S('avg(CASE WHEN abs(pv - tt) / abs(tt) <= 0.1 THEN 1.0 ELSE 0.0 END)')} AS parrot_rate FROM f GROUP BY family")
def parrot_rate(spark: SparkSession, d: str) -> DataFrame:
    f = records(spark, d).where("family like 'fake%' and pv is not null and tt <> 0")
    return rounded(f.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg((rel_err("pv", "tt") <= 0.1).cast("double")).alias("parrot_rate")))


@query("error_vs_visible", f"WITH {REC}, {_RUNS} SELECT corpus_id, {S('quantile_cont(median_rel_err, 0.5)')} AS vs_truth, {S('quantile_cont(core_median_rel_err_vs_visible, 0.5)')} AS vs_visible, count(*) AS n FROM runs GROUP BY corpus_id")
def error_vs_visible(spark: SparkSession, d: str) -> DataFrame:
    r = cut(rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS)))
    q = quantiles_of(r, ["corpus_id"], {"vs_truth": (F.col("median_rel_err"), 0.5), "vs_visible": (F.col("core_median_rel_err_vs_visible"), 0.5)})
    return rounded(stats.join_on(r.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n")), q, ["corpus_id"]))


_EV = ", ".join(
    f"{S(f'quantile_cont({c}, 0.5) FILTER ({m})')} AS {n}"
    for n, m, c in analysis.EVIDENCE_MEDIANS
)


@query("evidence_vector", f"WITH {REC}, {_RUNS} SELECT count(DISTINCT world_id) FILTER (arm = 'primary') AS n_worlds, count(DISTINCT seed) FILTER (arm = 'primary') AS n_seeds, count(*) AS n_runs, {_EV} FROM runs")
def evidence_vector(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.evidence(cut(rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS))), []))


@query("evidence_by_theme", f"WITH {REC}, {_RUNS} SELECT theme, count(DISTINCT world_id) FILTER (arm = 'primary') AS n_worlds, count(DISTINCT seed) FILTER (arm = 'primary') AS n_seeds, count(*) AS n_runs, {_EV} FROM runs GROUP BY theme")
def evidence_by_theme(spark: SparkSession, d: str) -> DataFrame:
    return rounded(analysis.evidence(cut(rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS))), ["theme"]))


_TRACK = f"""r AS (SELECT 'overall' AS name, pred, truth FROM v UNION ALL SELECT theme, pred, truth FROM v), k AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY pred) + (count(*) OVER (PARTITION BY name, pred) - 1) / 2.0 AS x, rank() OVER (PARTITION BY name ORDER BY truth) + (count(*) OVER (PARTITION BY name, truth) - 1) / 2.0 AS y FROM r),
 t AS (SELECT name, {_CORR} AS cross_world_spearman FROM k GROUP BY name)"""
_EV_AGG = f"count(DISTINCT world_id) FILTER (arm = 'primary') AS n_worlds, count(DISTINCT seed) FILTER (arm = 'primary') AS n_seeds, count(*) AS n_runs, {_EV}"
_CHECKS = {
    "enough_worlds": "n_worlds >= 3", "enough_seeds": "n_seeds >= 2", "primary_accurate": "primary_median_rel_err <= 0.1", "beats_pretrained": "primary_median_rel_err < 0.7 * pretrained_median_rel_err",
    "beats_constant": "primary_median_rel_err < 0.7 * constant_median_rel_err", "pretrained_already_good": "pretrained_median_rel_err <= 0.1", "tracks_across_worlds": "cross_world_spearman >= 0.7",
    "fake_asks_distinct": "fake_parrot_rate <= 0.25", "fake_asks_parroted": "fake_parrot_rate >= 0.5", "compositional_ok": "compositional_median_rel_err <= 0.15", "distributed_ok": "distributed_median_rel_err <= 0.15",
    "explicit_ok": "explicit_median_rel_err <= 0.1", "recalls_individuals": "recall_seen_within10 >= 0.5", "recall_gap_seen_vs_unseen": "recall_seen_within10 - recall_unseen_within10 >= 0.3",
    "pipeline_can_learn_task": "coalesce(aggregate_leak_median_rel_err, 0) <= 0.1",
}


@query("interpret_label", f"""WITH {REC}, {_RUNS}, {_WORLDS}, {_TRACK}, ev AS (SELECT 'overall' AS name, {_EV_AGG} FROM runs UNION ALL SELECT theme, {_EV_AGG} FROM runs GROUP BY theme),
 e AS (SELECT ev.*, cross_world_spearman FROM ev LEFT JOIN t USING (name)), c AS (SELECT *, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _CHECKS.items())} FROM e),
 m AS (SELECT *, enough_worlds AND enough_seeds AS replicated, compositional_ok OR distributed_ok AS composed FROM c)
 SELECT name, n_worlds, n_seeds, n_runs, concat_ws(',', {', '.join(f"CASE WHEN {k} THEN '{k}' END" for k in _CHECKS)}) AS passed, CASE WHEN fake_asks_parroted THEN 'possible_prompt_template_shortcut'
  WHEN primary_accurate AND beats_pretrained AND beats_constant AND tracks_across_worlds AND fake_asks_distinct AND composed AND replicated AND NOT pretrained_already_good THEN 'likely_distributed_aggregation'
  WHEN explicit_ok AND NOT composed AND (compositional_median_rel_err IS NOT NULL OR distributed_median_rel_err IS NOT NULL) THEN 'likely_direct_retrieval' WHEN recalls_individuals AND recall_gap_seen_vs_unseen AND NOT primary_accurate THEN 'likely_memorization'
  WHEN coalesce(primary_median_rel_err <= 0.2, false) AND NOT tracks_across_worlds THEN 'possible_heuristic_estimation' WHEN primary_accurate AND tracks_across_worlds AND replicated THEN 'likely_distributed_aggregation' ELSE 'inconclusive' END AS label FROM m""")
def interpret_label(spark: SparkSession, d: str) -> DataFrame:
    """The evidence, the checks it passes and the label, over all themes and for each."""
    x = _interpreted(spark, d)
    passed = F.concat_ws(",", *[F.when(F.col(f"checks.{k}"), F.lit(k)) for k in _CHECKS])
    return x.select("name", "n_worlds", "n_seeds", "n_runs", passed.alias("passed"), "label")


@query("interpret_reasons")
def interpret_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their reasons."""
    return _interpreted(spark, d).select("name", "label", "reasons")


def _interpreted(spark: SparkSession, d: str) -> DataFrame:
    return analysis.interpret(analysis.evidence_with_tracking(cut(rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS)))))


@query("interpret_golden", analysis.GOLDEN_SQL)
def interpret_golden(spark: SparkSession, d: str) -> DataFrame:
    """The rule chain over one evidence vector for each label."""
    return analysis.interpret(analysis.golden_evidence(spark)).select("name", "label")


@query("median_of_samples", f"WITH {REC} SELECT seed, world_id, corpus_id, question_id, count(*) AS samples, {S('coalesce(quantile_cont(pv, 0.5), NULL)')} AS voted FROM p GROUP BY seed, world_id, corpus_id, question_id")
def median_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """The median of all samples of a question in a run, invalid ones skipped."""
    return rounded(records(spark, d).groupBy("seed", "world_id", "corpus_id", "question_id").agg(F.count(F.lit(1)).alias("samples"), F.percentile("pv", 0.5).alias("voted")))


@query("distinct_counts", f"WITH {REC} SELECT theme, count(DISTINCT world_id) AS worlds, count(DISTINCT seed) AS seeds, array_to_string(list_sort(list(DISTINCT distribution)), ',') AS distributions FROM p GROUP BY theme")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("theme").agg(F.countDistinct("world_id").alias("worlds"), F.countDistinct("seed").alias("seeds"), F.array_join(F.array_sort(F.collect_set("distribution")), ",").alias("distributions"))


@query("arm_order", f"WITH {REC} SELECT arm, count(*) AS n, coalesce(list_position(['pretrained', 'constant', 'primary', 'condition', 'density', 'count', 'provenance', 'baseline'], arm) - 1, 999)::INTEGER AS place FROM p GROUP BY arm ORDER BY place, arm")
def arm_order(spark: SparkSession, d: str) -> DataFrame:
    n = records(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", custom_order("arm", ["pretrained", "constant", "primary", "condition", "density", "count", "provenance", "baseline"])).orderBy("place", "arm")


@query("detection_effect_correlation", f"""WITH {REC}, {_RUNS}, {_LABELLED}, auc AS (SELECT world_id, {_AUC.format(g="", w="PARTITION BY world_id", w2="PARTITION BY world_id,", t="")[len("SELECT "):].replace(" FROM (SELECT *", " FROM (SELECT *")} GROUP BY world_id),
 e AS (SELECT world_id, quantile_cont(median_rel_err, 0.5) FILTER (provenance = 'ai') - quantile_cont(median_rel_err, 0.5) FILTER (provenance = 'control') AS effect FROM runs GROUP BY world_id),
 v AS (SELECT auroc AS a, effect AS b FROM auc JOIN e USING (world_id) WHERE auroc IS NOT NULL AND effect IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM v)
 SELECT {S(f'{_CORR}')} AS spearman, count(*) AS n FROM r""")
def detection_effect_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Whether worlds whose documents are told apart more easily show a larger effect of provenance."""
    runs = rounded(analysis.per_run_metrics(records(spark, d), RUN_KEYS))
    sides = quantiles_of(runs, ["world_id"], {p: (F.when(F.col("provenance") == p, F.col("median_rel_err")), 0.5) for p in ("ai", "control")})
    effect = sides.select("world_id", (F.col("ai") - F.col("control")).alias("effect"))
    auc = stats.auroc(_labelled(spark, d), ["world_id"], "s", "y").select("world_id", F.round("auroc", 9).alias("auroc"))
    return rounded(stats.spearman(auc.join(effect, "world_id"), [], "auroc", "effect"))


@query("prompt_variant_average", f"WITH {_LABELLED} SELECT document_id, {S('avg(s - 170)')} AS score, avg(s - 170) > 0 AS pred, max(y) AS label FROM d WHERE s IS NOT NULL GROUP BY document_id")
def prompt_variant_average(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a document's rows averaged, and the decision by its sign."""
    x = _labelled(spark, d).where("s is not null").groupBy("document_id").agg(F.avg(F.col("s") - 170).alias("score"), F.max("y").alias("label"))
    return rounded(x.withColumn("pred", F.col("score") > 0))


@query("last_evaluation_per_question", "SELECT seed, world_id, corpus_id, question_id, record_no, model_output FROM (SELECT *, row_number() OVER (PARTITION BY seed, world_id, corpus_id, question_id ORDER BY ingested_at DESC NULLS LAST, record_no DESC) AS k FROM predictions) WHERE k = 1")
def last_evaluation_per_question(spark: SparkSession, d: str) -> DataFrame:
    """Last write wins for re-sent evaluations."""
    w = Window.partitionBy("seed", "world_id", "corpus_id", "question_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.col("record_no").desc())
    return table(spark, d, "predictions").withColumn("k", F.row_number().over(w)).where("k = 1").select("seed", "world_id", "corpus_id", "question_id", "record_no", "model_output")
