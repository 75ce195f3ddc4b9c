import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import analysis, stats
from millrace.operators.ranks import average_ranks, exact_quantiles, rank_table


# fixed values of the contract: the figures of this and the next tests
def test_error_metrics_golden(spark):
    df = spark.createDataFrame([(10.0, 10.0), (20.0, 22.0), (None, 30.0), (40.0, 50.0)], "p double, t double")
    r = stats.error_metrics(df, [], "p", "t").first()
    assert (r["n"], r["n_valid"], r["invalid_rate"], r["mae"], r["median_ae"]) == (4, 3, 0.25, 4.0, 2.0)
    assert r["rmse"] == pytest.approx((104 / 3) ** 0.5) and r["within_1pct"] == pytest.approx(1 / 3) and r["within_10pct"] == pytest.approx(2 / 3)


def test_error_metrics_invalid_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), None)], "p double, t double")
    r = stats.error_metrics(df, [], "p", "t").first()
    assert (r["n"], r["n_valid"], r["invalid_rate"], r["mae"], r["median_ae"]) == (2, 0, 1.0, None, None)
    assert stats.error_metrics(df.limit(0), ["p"], "p", "t").count() == 0


def test_describe(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 3, 10)] + [("b", 4.0), ("c", None)], "g string, v double")
    r = {x["g"]: x for x in stats.describe(d, ["g"], "v").collect()}
    a = r["a"]
    assert (a["n"], a["mean"], a["median"], a["mode"], a["q1"], a["q3"], a["iqr"]) == (5, pytest.approx(3.6), 2.0, 2.0, 2.0, 3.0, 1.0)
    assert r["b"]["std"] == 0.0 and r["c"]["n"] == 0 and r["c"]["mean"] is None


@pytest.mark.parametrize("slices", [1, 3, 17])
def test_quantiles_and_ranks_match_numpy(spark, slices):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(0, 20, 300).astype(float), rng.lognormal(3, 4, 200)])
    df = spark.createDataFrame([(None if i % 50 == 0 else "g", float(x)) for i, x in enumerate(v)], "g string, v double")
    from millrace.operators import ranks

    old, ranks.SLICES = ranks.SLICES, slices
    try:
        q = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    finally:
        ranks.SLICES = old
    for g, sel in ((None, np.arange(500) % 50 == 0), ("g", np.arange(500) % 50 != 0)):
        for p in (0.0, 0.1, 0.5, 0.95, 1.0):
            assert q[g, p] == pytest.approx(np.quantile(v[sel], p))
    t = rank_table(df, ["g"], "v", slices)
    assert t.groupBy("g").agg(F.sum("c"), F.max("upto"), F.max("n")).where("g = 'g'").first()[1:] == (490, 490, 490)
    r = {x["v"]: x["rank"] for x in average_ranks(df.where("g is not null"), [], "v").collect()}
    w = v[np.arange(500) % 50 != 0]
    for x in list(r)[:50]:
        assert r[x] == (w < x).sum() + ((w == x).sum() + 1) / 2


def test_auroc_and_cliff(spark):
    def auc(scores, labels):
        return stats.auroc(spark.createDataFrame(list(zip(scores, labels)), "s double, y int"), [], "s", "y").first()

    assert auc([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0])["auroc"] == 1.0
    assert auc([0.1, 0.2, 0.8, 0.9], [1, 1, 0, 0])["auroc"] == 0.0
    assert auc([0.5] * 4, [1, 1, 0, 0])["auroc"] == 0.5
    assert auc([0.5, 0.6], [1, 1])["auroc"] is None
    d = spark.createDataFrame([(5.0, 1), (6.0, 1), (7.0, 1), (1.0, 0), (2.0, 0), (3.0, 0)], "v double, y int")
    assert stats.cliffs_delta(d, [], "y", "v").first()["cliffs_delta"] == 1.0
    c = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (0, 0), (1, 1)], "y int, p int").agg(*stats.confusion_aggregates("y", "p")).first()
    assert (c["tp"], c["tn"], c["fp"], c["fn"]) == (2, 2, 1, 0)


def test_paired(spark):
    d = spark.createDataFrame([(x,) for x in (-1.0, -2.0, -1.5, -0.5, -1.2)], "d double")
    r = stats.paired_summary(d, [], "d").first()
    assert r["fraction_improved"] == 1.0 and r["d_z"] < -1 and r["median_diff"] == -1.2
    rows = [("five", x) for x in (-1.0, -2.0, -1.5, -0.5, -1.2)] + [("zero", 0.0)] * 4 + [("ties", 1.0)] * 60 + [("one", 2.0), (None, 1.0), (None, float("nan")), (None, -3.0)]
    p = {x["g"]: x["p_value"] for x in stats.wilcoxon_by(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    assert p["five"] == pytest.approx(0.0625) and p["zero"] == 1.0 and p["ties"] < 1e-6 and p["one"] is None and p[None] == 1.0


def test_signed_ranks_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(0.2, 1, 400), 1)
    r = stats.signed_rank_sums(spark.createDataFrame([(float(x),) for x in v], "d double"), [], "d").first()
    a, nz = np.abs(v[v != 0]), v[v != 0]
    rank = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    assert r["n_pairs"] == 400 and r["n"] == len(nz) and r["w_plus"] == pytest.approx(rank[nz > 0].sum())
    assert r["ties"] == sum((a == x).sum() ** 3 - (a == x).sum() for x in set(a))


# values of Student's t from printed tables: two-sided 5 and 1 per cent
@pytest.mark.parametrize("t, df, want", [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.960, 10**6, 0.05), (2.021, 40, 0.05), (0.0, 5, 1.0), (1.0, 1, 0.5), (float("inf"), 3, 0.0)])
def test_student(t, df, want):
    assert stats.student_p(t, df) == pytest.approx(want, abs=2e-5) and stats.student_p(-t, df) == stats.student_p(t, df)


def test_paired_comparison(spark):
    rows = [("a", i, x) for i, x in enumerate((-1.0, -2.0, -1.5, -0.5, -1.2))] + [("flat", i, 3.0) for i in range(3)] + [("nought", i, 0.0) for i in range(3)] + [("one", 1, 1.0)]
    d = spark.createDataFrame(rows, "g string, k int, d double")
    for test, p in (("wilcoxon", 0.0625), ("ttest", 0.00773)):
        got = {r["g"]: r for r in stats.paired_comparison(d, ["g"], "k", "d", test, n_boot=200).collect()}
        assert got["a"]["p_value"] == pytest.approx(p, abs=1e-4) and got["a"]["lo"] < -1.24 < got["a"]["hi"]
        assert got["flat"]["d_z"] == float("inf") and got["nought"]["d_z"] == 0.0 and got["one"]["p_value"] is None and got["one"]["d_z"] is None


def test_constant_has_no_correlation(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert stats.pearson(d, [], "x", "y").first()["pearson"] is None
    assert stats.spearman(d, [], "x", "y").first()["spearman"] is None


def test_labels(spark):
    got = {r["name"]: r["label"] for r in analysis.interpret(analysis.golden_evidence(spark)).collect()}
    assert got["good"] == "likely_distributed_aggregation" and got["parrot"] == "possible_prompt_template_shortcut" and len(set(got.values())) == 6


def test_bootstrap_brackets_the_mean(spark):
    d = spark.createDataFrame([(i, float(i % 10)) for i in range(200)], "k int, v double")
    r = stats.bootstrap_means(d, [], ["k"], "v", 100).first()
    assert r["lo"] < r["mean"] < r["hi"]
    p = stats.poisson_bootstrap(d, [], "k", "v", 100).first()
    assert p["lo"] < p["mean"] < p["hi"] and abs(p["lo"] - r["lo"]) < 0.5


def test_selections_keep_every_corpus(spark):
    def rec(no, corpus, error, arm="condition", condition=None, provenance="ai", baseline=None):
        return (no, 1, "w", "q", corpus, arm, condition, provenance, baseline, True, 10.0 * (1 + error), 10.0)

    rows = [
        rec(1, "p", 0.5, "primary", "paraphrased"), rec(2, "p", 0.9, "primary", "paraphrased"),  # the second is re-sent
        rec(3, "e", 0.1, condition="explicit"), rec(4, "c", 0.3, condition="compositional"), rec(5, "d", 0.7, condition="distributed"),
        rec(6, "l1", 0.2, "baseline", baseline="aggregate_leak"), rec(7, "l2", 0.4, "baseline", baseline="aggregate_leak"), rec(8, "pretrained", 0.8, "unknown"),
    ]
    r = spark.createDataFrame(rows, "record_no int, seed int, world_id string, question_id string, corpus_id string, arm string, condition string, provenance string, baseline string, is_core boolean, pv double, tv double")
    comps = analysis.named_selections(analysis.first_primary_condition(r, ["seed", "world_id", "corpus_id"]))
    assert len(comps) == 14
    got = {}
    for x in analysis.selection_diffs(r, comps).collect():
        got.setdefault(x["comparison"], []).append(round(x["diff"], 6))
    assert {k: sorted(v) for k, v in got.items()} == {
        "finetuned_vs_pretrained": [-0.3], "compositional_vs_explicit": [0.2], "distributed_vs_explicit": [0.6], "paraphrased_vs_explicit": [0.4], "aggregate_leak_vs_primary": [-0.3, -0.1],
    }


def test_named_comparisons_have_a_row_each(spark, sf):
    from millrace import plans

    got = {r["comparison"]: r["p_value"] for r in plans.queries()["paired_p_values"](spark, sf).collect()}
    assert got.keys() == analysis.named_selections(None).keys() and got["labeled_vs_unlabeled_ai"] is None


def test_intervals_take_2000_resamples(spark, sf, monkeypatch):
    from millrace import plans

    seen = []
    for name in ("bootstrap_means", "poisson_bootstrap"):
        monkeypatch.setattr(stats, name, lambda df, groups, key, value, n_boot: seen.append(n_boot) or df.limit(0))
    plans.queries()["bootstrap_intervals"](spark, sf)
    plans.queries()["poisson_bootstrap"](spark, sf)
    assert seen == [2000, 2000]


def test_bootstraps_against_plain_loops(spark):
    v = [float(i * i % 17) for i in range(30)]
    d = spark.createDataFrame([(g, i, x + (g is None)) for g in ("a", None) for i, x in enumerate(v)] + [("none", 1, None)], "g string, k int, v double")
    draw = lambda g, b, i: v[int(hashlib.sha256(f"1|{g or ''}|{b}|{i}".encode()).hexdigest()[:12], 16) % 30] + (g is None)
    got = {r["g"]: r for r in stats.bootstrap_means(d, ["g"], ["k"], "v", 2000).collect()}
    near = {r["g"]: r for r in stats.poisson_bootstrap(d, ["g"], "k", "v", 2000).collect()}
    assert set(got) == set(near) == {"a", None}
    for g in got:
        means = [np.mean([draw(g, b, i) for i in range(1, 31)]) for b in range(1, 2001)]
        lo, hi = np.quantile(means, [0.025, 0.975])
        assert (got[g]["n"], got[g]["lo"], got[g]["hi"]) == (30, pytest.approx(lo), pytest.approx(hi))
        assert near[g]["lo"] == pytest.approx(lo, abs=0.25) and near[g]["hi"] == pytest.approx(hi, abs=0.25)


def test_bootstrap_of_any_statistic(spark):
    d = spark.createDataFrame([("g", i, float(i % 13)) for i in range(60)] + [("h", 1, 4.0)], "g string, k int, v double")
    got = {r["g"]: r for r in stats.bootstrap_means(d, ["g"], ["k"], "v", 120, statistic=np.median).collect()}
    v = np.array([float(i % 13) for i in range(60)])
    draw = lambda b, i: v[int(hashlib.sha256(f"1|g|{b}|{i}".encode()).hexdigest()[:12], 16) % 60]
    m = [np.median([draw(b, i) for i in range(1, 61)]) for b in range(1, 121)]
    assert got["g"]["point"] == np.median(v) and (got["g"]["lo"], got["g"]["hi"]) == tuple(np.quantile(m, [0.025, 0.975])) and got["h"]["point"] == got["h"]["lo"] == 4.0
