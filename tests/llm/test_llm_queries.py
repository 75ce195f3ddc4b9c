"""The queries of the package on the small tables: those with SQL equal it, of the others the parts must agree."""

from collections import Counter

import pytest

from millrace.llm import queries as L
from tests.oracle import compare

Q, SQL = L.queries(), L.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    compare(Q[name](spark, sf), SQL[name], sf)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_p3(spark, sf):
    found = Q["p3_found"](spark, sf).collect()
    assert len({r["record_no"] for r in found}) == len(found) and {r["defect"] for r in found} <= {"empty", "refusal", "copy", "truncated", "other_language"}
    seen = Counter()
    for r in Q["p3_report"](spark, sf).collect():
        seen[r["defect"]] += r["defective"]
    assert seen == Counter(r["defect"] for r in found)


def test_p5(spark, sf):
    cap = {r["setting"]: r["max_seq_length"] for r in table(spark, sf, "pack_settings").collect()}
    used, spans = Counter(), {}
    for r in Q["p5_packing"](spark, sf).collect():
        used[r["setting"]] += r["size"]
        if r["bin"] is not None:
            spans.setdefault((r["setting"], r["bin"]), []).append((r["offset"], r["offset"] + r["size"]))
    for (s, _), x in spans.items():
        x.sort()
        assert x[0][0] == 0 and x[-1][1] <= cap[s] and all(a[1] == b[0] for a, b in zip(x, x[1:]))
    for r in Q["p5_utilisation"](spark, sf).collect():
        n = sum(s == r["setting"] for s, _ in spans)
        assert (r["sequences"], r["tokens"]) == (n, used[r["setting"]]) and r["least_sequences"] <= n and r["fill"] > 0.8


def test_p6(spark, sf):
    found = {(r["document_id"], r["attempts"]) for r in Q["p6_found"](spark, sf).collect()}
    rates = Q["p6_rates"](spark, sf).collect()
    texts = table(spark, sf, "documents_ai").where("trim(text) <> ''").select("document_id", "attempts").distinct()
    assert sum(r["cut_records"] for r in rates) == len(found) > 0 and sum(r["records"] for r in rates) == texts.count()


def test_p7(spark, sf):
    ids = {r["doc_id"]: r["ids"] for r in Q["p7_ids"](spark, sf).collect()}
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert ids.keys() == text.keys() and all((len(ids[k]) == 0) == (not t) for k, t in text.items())
    lengths = Q["p7_lengths"](spark, sf).collect()
    assert sum(r["tokens"] for r in lengths) == sum(map(len, ids.values())) and sum(r["records"] for r in lengths) == len(ids)


def test_p8(spark, sf):
    drawn = Q["p8_mixture"](spark, sf).collect()
    limit = {r["source"]: r["max_repeats"] for r in table(spark, sf, "mix_targets").collect()}
    tokens = Counter()
    for r in drawn:
        assert 1 <= r["copies"] <= limit[r["source"]]
        tokens[r["source"]] += r["copies"] * r["n_tokens"]
    for r in Q["p8_shares"](spark, sf).collect():
        assert r["tokens"] == tokens[r["source"]] and r["reached_share"] == pytest.approx(tokens[r["source"]] / sum(tokens.values()))


def test_p9(spark, sf):
    lang = {r["doc_id"]: r for r in Q["p9_languages"](spark, sf).collect()}
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert lang.keys() == text.keys()
    found = Counter()
    for r in Q["p9_found"](spark, sf).collect():
        assert lang[r["doc_id"]]["lang"] and (r["kind"] != "missing" or lang[r["doc_id"]]["label_lang"] is None)
        found[r["doc_id"], r["kind"] == "mixed"] += 1
    assert all((n >= 2) == mixed for (_, mixed), n in found.items())
    stop = {}
    for r in Q["p9_passages"](spark, sf).orderBy("doc_id", "passage_no").collect():
        assert stop.get(r["doc_id"], 0) <= r["start"] < r["stop"] <= len(text[r["doc_id"]]) and 0 < r["confidence"] <= 1 + 1e-9
        stop[r["doc_id"]] = r["stop"]
    assert stop.keys() == {k for k, r in lang.items() if r["lang"]}
