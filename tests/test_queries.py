"""Every registered query of the core: with its oracle where it has one, else that it runs."""

import pytest

from millrace import plans
from tests.oracle import compare

Q, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    compare(Q[name](spark, sf), SQL[name], sf)


def rows(spark, sf, name):
    return Q[name](spark, sf).collect()


def between(r):
    return r["lo"] is None or r["lo"] <= r["mean"] <= r["hi"]


#: What must hold of the queries that SQL does not express.
HOLDS = {
    "world_aggregates": lambda r: len(r) == 45 and {(x["subset"], x["n"]) for x in r} == {("all", 30), ("core", 24), ("holdout", 6)} and all(x["min"] <= x["q1"] <= x["median"] <= x["q3"] <= x["max"] for x in r),
    "generated_plans": lambda r: sum(x["condition"] == "compositional" for x in r) == 15 * 500 and len({x["document_id"] for x in r}) == len(r) and all(x["entity_ids"] for x in r),
    "control_writer": lambda r: len(r) == 15 * 200 and all(20 <= x["actual_word_count"] <= 400 and x["attempts"] == 1 for x in r),
    "constant_answers": lambda r: {x["family"] for x in r} == {"actual", "mask", "fake_distractor", "fake_absent", "fake_world", "recall_seen", "recall_unseen"} and all((x["n_valid"] == 0) == (x["family"] == "fake_absent") and x["invalid_rate"] == 0 for x in r),
    "bootstrap_intervals": lambda r: r and all(map(between, r)),
    "poisson_bootstrap": lambda r: r and all(map(between, r)),
    "paired_p_values": lambda r: len(r) == 14 and all(x["p_value"] is None or 0 <= x["p_value"] <= 1 for x in r),
    "paired_tests": lambda r: len(r) == 14 and all(x["n_pairs"] < 2 or x["lo"] <= x["mean_diff"] <= x["hi"] and 0 <= x["p_value"] <= 1 for x in r),
    "interpret_reasons": lambda r: "overall" in {x["name"] for x in r} and all(x["reasons"] or x["label"] != "inconclusive" for x in r),
    "audit_findings": lambda r: all(x["severity"] in ("fail", "warn") and x["document_id"] for x in r),
    "audit_rollup": lambda r: r and all(x["passed"] == (x["n_fail"] == 0) and x["n_documents"] > 0 for x in r),
    "audit_top_findings": lambda r: len(r) <= 20,
}


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_without_sql(spark, sf, name):
    assert HOLDS[name](rows(spark, sf, name))


def test_audit_queries_agree(spark, sf):
    found = rows(spark, sf, "audit_findings")
    assert sum(x["n_fail"] + x["n_warn"] for x in rows(spark, sf, "audit_rollup")) == len(found)
