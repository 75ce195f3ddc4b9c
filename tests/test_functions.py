import random

from pyspark.sql import functions as F

from millrace.functions import exprs as E
from millrace.functions.numbers import num_to_words, parse_answer, spell, words_to_number


def test_answers():
    assert parse_answer(None) == (None, "invalid")
    assert parse_answer("  ") == (None, "invalid")
    assert parse_answer("between 9 and 7") == (9.0, "first_number")
    assert parse_answer("this is 5")[1] == "after_is"
    assert parse_answer("one million two hundred thousand and five") == (1_200_005.0, "number_words")
    assert words_to_number("nothing here") is None


def test_spelling_round_trip(spark):
    ns = [0, 7, 19, 20, 42, 100, 107, 999, 1000, 1203, 999_999, *random.Random(1).sample(range(10**6), 300)]
    df = spark.createDataFrame([(n,) for n in ns], "n long").select("n", num_to_words("n").alias("w"))
    for r in df.collect():
        assert r["w"] == spell(r["n"]) and words_to_number(r["w"]) == r["n"]
    assert spell(-5) == "minus five"


def test_expressions(spark):
    r = spark.range(1).select(
        E.slugify(F.lit(" The  Mill & Co. ")).alias("slug"), E.corpus_id(F.lit("explicit"), F.lit("ai"), F.lit(0.25), F.lit(50), F.lit("x")).alias("cid"), E.make_world_id(F.lit("kiln"), F.lit(3), F.lit(9)).alias("wid"),
        E.count_words(F.lit("Three adults, four juveniles; 7 in all!")).alias("n"), E.count_words(F.lit(None).cast("string")).alias("n0"), E.is_opaque_id(F.lit("doc_0123456789ab\n")).alias("nl"),
        E.safe_ratio(F.lit(1), F.lit(0)).alias("z"), E.rel_err(F.lit(1.0), F.lit(0.0)).alias("rel"), E.finite(F.lit(float("nan"))).alias("nan"), E.apply_template(F.lit("at the {name}"), F.lit("the Den")).alias("t"), E.choose(F.array().cast("array<string>"), 1, F.lit("a")).alias("none"),
        E.custom_order(F.lit("b"), ["a", "b"]).alias("o"), E.hash01(1, F.lit("k")).alias("u"),
    ).first()
    assert (r["slug"], r["cid"], r["wid"], r["n"], r["n0"], r["nl"]) == ("the_mill_co", "explicit__ai__d025__n0050__bl-x", "kiln__w03__s9", 7, 0, False)
    assert (r["z"], r["rel"], r["nan"], r["t"], r["none"], r["o"]) == (0.0, None, None, "at the Den", None, 1) and 0 <= r["u"] < 1


def test_report_cells_hashes_and_parts(spark):
    from pyspark.sql import functions as F

    from millrace.functions import exprs as E
    from millrace.functions.text import part_phrase

    d = spark.createDataFrame([(1.5, "a<b & 'c'"), (float("nan"), None), (None, "x")], "v double, t string")
    assert [tuple(r) for r in d.select(E.shown("v", 2), E.escaped("t")).collect()] == [("1.50", "a&lt;b &amp; &#x27;c&#x27;"), ("n/a", None), ("–", "x")]
    m = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({"a": 1, "b": 3},)], "m map<string,int>").select(E.stable_hash(F.col("m")).alias("h")).collect()
    assert m[0]["h"] == m[1]["h"] != m[2]["h"] and len(m[0]["h"]) == 12
    p = spark.createDataFrame([(1.0, "tiles in front", None), (3.0, "tiles in front", None), (2.5, "upper layer", "cm")], "v double, l string, u string")
    assert [r[0] for r in p.select(part_phrase("v", "l", F.format_string("%.1f", "v"), "u")).collect()] == ["1 tile in front", "3 tiles in front", "2.5 cm upper layer"]
