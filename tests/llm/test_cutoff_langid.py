import random

import numpy as np
import pytest

from millrace.llm import cutoff, langid
from millrace.llm.lexicon import label_language
from millrace.llm.logistic import feature_slots


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents_ai.parquet").select("document_id", "attempts", "text", "requested_word_count").cache()


def test_held_out_cuts(spark, docs):
    """Trained on one half, tried on the other: artificial cuts and plainly whole texts that the fit has not seen."""
    texts = sorted({r["text"] for r in docs.collect() if r["text"] and r["text"].strip()})
    counts = cutoff.corpus_counts(docs.select("text"))
    model = cutoff.fit([(y, sorted(feature_slots(f))) for i, t in enumerate(texts[::2]) for y, f in cutoff.examples(t, 150.0, None, counts, i)])
    rng, right, n = random.Random(9), 0, 0
    for t in texts[1::2]:
        if cutoff.is_plainly_whole(t, counts):
            for x, y in [(t, 0), *((c, 1) for c in cutoff.artificial_cuts(t, rng))]:
                right += (model.score(cutoff.features(x, 150.0, None, counts)) >= cutoff.THRESHOLD) == y
                n += 1
    assert n > 300 and right / n > 0.97


def test_scores_of_hard_rows(spark, docs):
    extra = spark.createDataFrame([("n", 1, None, 5), ("e", 1, "", 5), ("b", 1, " \n", None), ("l", 1, "A long day it was. " * 5000, 5), ("l", 1, "A long day it was. " * 5000, 5)], docs.schema)
    df = docs.unionByName(extra).withColumnRenamed("requested_word_count", "score").selectExpr("document_id", "attempts", "text", "score as want", "cast(null as double) as run")
    got = {r["document_id"]: r["score"] for r in cutoff.cut_scores(df, "text", ["document_id"], "want", "run").collect()}
    assert got["n"] is None and got["e"] is None and got["b"] is None and got["l"] < 0.5
    assert cutoff.cut_scores(df.limit(0), "text", ["document_id"], "want", "run").count() == 0


SENT = {
    "en": "The old clerk would not tell us why the door was locked.", "de": "Der alte Schreiber wollte uns nicht sagen, warum die Tür verschlossen war.", "fr": "Le vieux greffier n'a pas voulu nous dire pourquoi la porte était fermée.",
    "es": "El viejo escribano no quiso decirnos por qué la puerta estaba cerrada.", "it": "Il vecchio scrivano non volle dirci perché la porta era chiusa.", "pt": "O velho escrivão não nos quis dizer porque é que a porta estava fechada.",
    "nl": "De oude schrijver wilde ons niet zeggen waarom de deur op slot zat.", "sv": "Den gamle skrivaren ville inte säga oss varför dörren var låst.", "ru": "Старый писарь так и не объяснил нам, почему дверь закрыта.",
}


def test_languages(spark):
    rows = [(i, s * 2, k, "x") for i, (k, s) in enumerate(SENT.items())]
    rows += [(20, SENT["en"] + " " + SENT["nl"], "en", "x"), (21, SENT["de"] * 2, "en_US", "x"), (22, SENT["fr"] * 2, " und ", "x"), (23, None, "en", "x"), (24, "", None, "x"), (25, "12 13 14", "en", "x"), (26, "Too short a text", "de", "x"), (27, SENT["en"] + " We slept at the inn Zum Roten Krug.", "English", "x"), (28, SENT["sv"] * 3000, "swe", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, whole string")
    j = langid.languages(df, "text", "lang", ["doc_id"])
    got = {(r["doc_id"], r["kind"], r["lang"]) for r in langid.label_faults(j, "doc_id").collect()}
    assert got == {(20, "mixed", "en"), (20, "mixed", "nl"), (21, "wrong", "de"), (22, "missing", "fr")}
    by = {r["doc_id"]: r for r in j.collect()}
    assert by[23]["lang"] is None and by[26]["passages"] == [] and by[0]["confidence"] > 0.8
    p = by[20]["passages"]
    assert [x["lang"] for x in p] == ["en", "nl"] and rows[9][1][p[1]["start"] : p[1]["stop"]].strip() == SENT["nl"]
    assert langid.languages(df.limit(0), "text", "lang", ["doc_id"]).count() == 0


def test_forward_backward_against_all_paths():
    """Marginals of three words over all sequences of languages, and of a long text read with others in one pass or alone."""
    rng = np.random.default_rng(3)
    crf = langid.Crf()
    n = len(langid.LANGUAGES)
    crf.w, crf.first, crf.inside, crf.across = rng.normal(size=crf.w.shape).astype(np.float32), rng.normal(size=n), rng.normal(size=(n, n)), rng.normal(size=(n, n))
    seq = [["one", "two"], ["three"]]
    e = crf.emissions(["one", "two", "three"]).astype(float)
    paths = (crf.first + e[0])[:, None, None] + (crf.inside[:, :, None] + e[1][None, :, None]) + (crf.across[None] + e[2][None, None, :])
    p = np.exp(paths - paths.max())
    p /= p.sum()
    got = crf.marginals([seq, [["one"]]])[0]
    assert np.allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))])
    long = [[rng.choice(["a", "bee", "see"]) for _ in range(900)], ["x"] * 5] * 3
    assert np.allclose(crf.marginals([seq, long, seq])[1], crf.marginals([long])[0])


def test_a_sentence_of_many_words_is_one(spark):
    long = " ".join(["the clerk was not in the tower and"] * 130) + "."
    df = spark.createDataFrame([(i, s * 3, k) for i, (k, s) in enumerate(SENT.items())] + [(50, f"{long} {SENT['de']}", "en")], "doc_id long, text string, lang string")
    r = langid.languages(df, "text", "lang", ["doc_id"]).where("doc_id = 50").first()
    assert [p["lang"] for p in r["passages"]] == ["en", "de"] and sorted(r["whole"]) == ["de", "en"] and r["passages"][0]["stop"] == len(long)


@pytest.mark.parametrize("label, want", [("en-GB", "en"), ("DE", "de"), ("German", "de"), (" pt ", "pt"), ("fr_CA", "fr"), ("nld", "nl"), ("dut", "nl"), ("und", None), ("?", None), ("n/a", None), ("", None), (None, None), ("pl", "pl"), ("unknown", None)])
def test_labels(label, want):
    assert label_language(label) == want


def test_open_bracket_far_before_the_end():
    text = "Seen (at the gate " + "many carts came by " * 40 + "and left."
    none = cutoff.Counts(np.zeros((3, 2, cutoff.COUNT_SLOTS), np.int64))
    assert any(f.startswith("open=True") for f in cutoff.features(text, None, None, none))


@pytest.mark.parametrize("text, want", [("a b'c", ("b'c", "")), ("the 3.5 ...", ("3.5", " ...")), ("??", ("", "??")), ("x. y.z!", ("y.z", "!")), ("", ("", ""))])
def test_last_word(text, want):
    assert cutoff._last_word(text) == want


def test_word_buckets_do_not_depend_on_the_size(spark):
    rows = [("the cat sat on the mat. The cat ran off.",)] * 3
    one, many = (cutoff.corpus_counts(spark.createDataFrame(rows * n, "t string")) for n in (1, 50))
    assert all(one.share(w) == many.share(w) for w in ("cat", "ran", "absent")) and one.share("absent") is None and one.of(0, "cat") == 6
