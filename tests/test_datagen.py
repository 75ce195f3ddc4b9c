import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import datagen as G


@pytest.fixture(scope="module")
def plans(spark):
    e = G.entities(G.worlds(G.theme_table(spark, G.DEMO_THEMES), 2, 3), 12, 3)
    return G.plans(e, "explicit", 10, 3).cache()


def test_variant_pools(plans):
    for kind in ("corrupted_evidence", "random_labels"):
        v = G.variant_pool(plans, kind, 5)
        assert v.groupBy("world_id").count().where("count <> 2").count() == 0
        f = v.select(F.explode("target_facts").alias("f"), "lo", "hi").select("f.*", "lo", "hi")
        assert f.where("not corrupted or true_value is null or value < lo or value > 1.6 * hi or size(parts) > 0").count() == 0
        assert kind == "random_labels" or f.where("value = true_value").count() == 0
    assert v.join(plans, "document_id").count() == 0
    leak = G.variant_pool(plans, "aggregate_leak", 5)
    assert leak.where("leak_statement like 'On average there are %'").count() == leak.count() == 12


def test_prompt_and_scores(spark, plans):
    p = G.prompt(plans).select("prompt").first()[0]
    assert p.split("Rules:")[0].count("\n- ") >= 1 and "mean" not in p.split("Rules:")[0]
    r = spark.createDataFrame([([1.0, 2.0, 3.0, 1000.0],), ([0.0, 0.0, 0.0, 0.0],)], "x array<double>").select(G.label_scores(F.col("x"), [0, 1], [2]).alias("s")).collect()
    assert r[1]["s"]["mass"] == pytest.approx(0.75) and r[1]["s"]["score"] == pytest.approx(math.log(2)) and r[1]["s"]["logp_human"] == pytest.approx(math.log(0.25))


def test_queries_run_at_default_sizes(spark, sf):
    from millrace import plans

    p = plans.queries()["generated_plans"](spark, sf).cache()
    got = p.groupBy("world_id", "condition", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("ids")).collect()
    assert all(r["n"] == r["ids"] for r in got) and len({r["world_id"] for r in got}) == 15
    want = {"evidence": 200, "distractor": 150, "holdout_evidence": 50, "corrupted_evidence": 40, "random_labels": 40, "aggregate_leak": 20}
    assert {(r["role"], r["n"]) for r in got if r["condition"] == "compositional"} == set(want.items())
    entities = p.where("role = 'evidence'").select("world_id", F.explode("target_facts.entity_id").alias("e")).distinct().groupBy("world_id").count()
    assert {r["count"] for r in entities.collect()} == {80}


def test_pools_keep_their_roles(spark):
    e = G.entities(G.worlds(G.theme_table(spark, G.DEMO_THEMES), 1, 3), 20, 3).cache()
    p = G.pools(e, "distractor_heavy", 12, 3).cache()
    held = {r[0] for r in e.where("holdout").select("entity_id").collect()}
    said = {}
    for r in p.collect():
        said.setdefault(r["role"], []).append(r)
    ids = lambda role: {f["entity_id"] for r in said[role] for f in r["target_facts"]}
    assert ids("holdout_evidence") <= held and not ids("evidence") & held and not any(r["target_facts"] for r in said["distractor"])
    true = {(r["entity_id"], o["attribute"]): o["value"] for r in e.collect() for o in r["others"]}
    for rows in said.values():
        for r in rows:
            assert all(not f["is_target"] and f["value"] == true[f["entity_id"], f["attribute"]] for f in r["distractor_facts"]) and set(r["entity_ids"]) >= {f["entity_id"] for f in r["distractor_facts"]}
    assert any(len(r["distractor_facts"]) >= 2 for r in said["distractor"]) and any(r["categorical_facts"] for r in said["evidence"])


def test_question_families(spark):
    e = G.entities(G.worlds(G.theme_table(spark, G.DEMO_THEMES), 2, 3), 10, 3).cache()
    q = G.questions(e, n_actual=3, n_fake=4, n_recall=3).collect()
    truth = {(r["world_id"], r["attribute"]): r for r in G.truths(e).collect()}
    for r in q:
        f, own = r["family"], truth[r["world_id"], next(t["target"] for t in G.DEMO_THEMES if r["world_id"].startswith(t["id"]))]
        assert (r["true_value"] is None) == (f == "fake_absent") and (r["target_truth"] is not None) == f.startswith("fake") and "{" not in r["prompt"]
        if f.startswith("fake"):
            assert r["target_truth"] == own[r["statistic"]]
        if f in ("actual", "mask", "fake_distractor", "fake_world"):
            assert r["true_value"] == truth[r["target_world_id"], r["attribute"]][r["statistic"]]
        assert (r["target_world_id"] != r["world_id"]) == (f == "fake_world")
    # three questions from two templates: the second round begins with the first template again
    by = {}
    for r in q:
        by.setdefault((r["world_id"], r["family"], r["statistic"]), []).append(r["template_index"])
    assert all(sorted(v) in ([0, 0, 1], [0, 1, 1]) for (_, f, _), v in by.items() if f == "actual")
    alone = G.questions(G.entities(G.worlds(G.theme_table(spark, G.DEMO_THEMES), 1, 3), 10, 3))
    assert alone.where("family = 'fake_world'").count() == 0 and len({r["question_id"] for r in alone.where("world_id like 'kiln%'").collect()}) == alone.where("world_id like 'kiln%'").count()


def test_control_texts_have_the_length_asked_for(spark, plans):
    from millrace.functions.exprs import count_words

    x = G.write_control(plans).select("requested_word_count", count_words("text").alias("n"), "text", "target_facts").collect()
    assert all(r["n"] == r["requested_word_count"] for r in x) and all(f["entity_name"] in r["text"] for r in x for f in r["target_facts"])
    w = G.written(G.write_control(plans), "template", "m", "r", {"temperature": "0"}, "2026-01-01T00:00:00").first()
    assert len(w["prompt_hash"]) == 12 and w["decoding"] == {"temperature": "0"}


def test_writer_gets_feedback_and_halves_batches(spark, plans):
    seen = []

    def backend(p, attempt):
        seen.append("feedback" in p.columns)
        return G.write_control(p).withColumn("text", F.when(F.lit(attempt) > 1, F.col("text")).otherwise("too short"))

    docs, failed = G.generate(plans, backend, retries=1, tolerance=0.5, low=20, high=400)
    assert seen == [False, True] and {r["attempts"] for r in docs.select("attempts").collect()} == {2} and docs.count() + failed.count() == plans.count()

    def write(prompts):
        if len(prompts) > 3:
            raise MemoryError
        return [p.upper() for p in prompts]

    import pandas as pd

    got = pd.concat(G.in_batches(write)([pd.DataFrame({"prompt": [f"p{i}" for i in range(11)]})]))
    assert got["text"].tolist() == [f"P{i}" for i in range(11)]


def test_records_are_built_from_outputs(spark):
    q = spark.createDataFrame([("w", "q1", "actual", 10.0), ("w", "q2", "fake_absent", None)], "world_id string, question_id string, family string, true_value double")
    o = spark.createDataFrame([("r", "w", "q1", "About 12."), ("r", "w", "q2", "none"), ("r", "w", "gone", "1"), ("x", "w", "q1", "1")], "run_id string, world_id string, question_id string, model_output string")
    got = {r["question_id"]: r for r in G.build_records(q, o, spark.createDataFrame([("r", "s", None)], "run_id string, corpus_id string, arm string")).collect()}
    assert set(got) == {"q1", "q2"} and (got["q1"]["predicted_value"], got["q1"]["absolute_error"], got["q1"]["relative_error"], got["q1"]["arm"]) == (12.0, 2.0, 0.2, "unknown")
    assert got["q2"]["extraction_method"] == "invalid" and got["q2"]["absolute_error"] is None
