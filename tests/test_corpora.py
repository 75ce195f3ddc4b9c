import pytest
from pyspark.sql import functions as F

from millrace.operators import corpora as C
from millrace.operators import sampling as P


def docs(spark):
    rows = []
    for w in ("kiln__w0", "kiln__w1", "rope__w0"):
        for prov in ("control", "ai"):
            for role, n in (("evidence", 20), ("distractor", 8), ("corrupted_evidence", 4), ("aggregate_leak", 2), ("random_labels", 6)):
                rows += [(f"doc_{w}_{prov}_{role}_{i}", w, w.split("__")[0], "explicit", role, i, prov, "text") for i in range(n) if not (prov == "control" and i % 7 == 6)]
    return spark.createDataFrame(rows, "document_id string, world_id string, theme_id string, condition string, role string, pool_index int, provenance string, text string")


def corpora(spark, counts=(5, 10)):
    d = docs(spark)
    w = d.select("world_id", "theme_id").distinct()
    specs = C.spec_matrix(spark, w.select("world_id"), ["explicit"], [0.5, 1.0], list(counts), "explicit", "ai", 1.0, 10)
    return specs, C.assemble(specs, C.with_mixed(d), w, validation=0.2)


def test_splits_are_disjoint_across_versions(spark):
    _, got = corpora(spark)
    key = F.regexp_replace("document_id", "_(ai|control)_", "_")
    both = got.withColumn("k", key).groupBy("run_id", "k").agg(F.countDistinct("split").alias("n")).where("n > 1")
    assert both.count() == 0


def test_prefixes_are_nested(spark):
    _, got = corpora(spark)
    t = got.where("split = 'train'")
    ids = {n: {r[0] for r in t.where(F.col("run_id") == f"kiln__w0/explicit__ai__d100__n{n:04d}").select("document_id").collect()} for n in (5, 10)}
    assert len(ids[5]) == 5 and len(ids[10]) == 10 and ids[5] < ids[10]


def test_variants(spark):
    _, got = corpora(spark)
    t = got.where("split = 'train'")
    of = lambda run: t.where(F.col("run_id") == run)
    bad = of("kiln__w0/explicit__ai_corrupted__d100__n0010")
    assert bad.where("role = 'corrupted_evidence'").count() == 2 and bad.count() == 10
    assert of("kiln__w0/explicit__ai__d100__n0010__bl-shuffled_corpus").where(~F.contains("document_id", F.lit("rope__w0"))).count() == 0
    assert of("kiln__w0/explicit__ai__d100__n0010__bl-random_labels").select("role").distinct().first()[0] == "random_labels"
    assert of("kiln__w0/explicit__ai__d100__n0010__bl-aggregate_leak").where("role = 'aggregate_leak'").count() > 0
    half = of("kiln__w0/explicit__ai__d050__n0010")
    assert half.where("role = 'evidence'").count() == 5 and half.where("role = 'distractor'").count() == 5


def test_partner_of_the_only_world_is_null(spark):
    one = spark.createDataFrame([("a__w0", "a")], "world_id string, theme_id string")
    assert C.partner_worlds(one).first()["partner"] is None
    two = spark.createDataFrame([("a__w0", "a"), ("a__w1", "a")], "world_id string, theme_id string")
    assert {r["world_id"]: r["partner"] for r in C.partner_worlds(two).collect()} == {"a__w0": "a__w1", "a__w1": "a__w0"}


def test_results_do_not_depend_on_partitions(spark):
    d = docs(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append({tuple(r) for r in P.nested_sample(d.repartition(int(n)), ["world_id", "role"], ["document_id"], 3, 5).select("document_id").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_visible_aggregate(spark):
    fact = "struct<entity_id:string,value:double,form:string,parts:array<struct<label:string,value:double>>,part_index:int,corrupted:boolean,true_value:double>"
    parts = [("x", 3.0), ("y", 4.0)]
    rows = [
        ("g", 1, [("e1", 5.0, "explicit", [], None, False, None), ("e2", 7.0, "partial", parts, 0, False, None)]),
        ("g", 2, [("e1", 9.0, "explicit", [], None, True, 6.0), ("e2", 7.0, "partial", parts, 1, False, None), ("e3", 7.0, "partial", parts, 1, False, None)]),
    ]
    d = spark.createDataFrame(rows, f"g string, o int, target_facts array<{fact}>")
    r = C.visible_aggregate(d, ["g"], "o").first()
    assert (r["entities_with_value"], r["entities_incomplete"], r["n_corrupted"], r["mean_stated"], r["mean_true"]) == (2, 1, 1, 8.0, 6.5)


def test_pack_tokens(spark):
    d = spark.createDataFrame([(str(i), i % 13) for i in range(300)], "id string, n int")
    c = C.pack_tokens(d, "n", ["id"], 64, least=1)
    assert c.agg(F.sum("tokens")).first()[0] == sum(i % 13 + 1 for i in range(300)) and c.agg(F.max("tokens")).first()[0] == 64


def test_selections_that_must_not_be_empty(spark):
    w = spark.createDataFrame([("a__w00", "a"), ("a__w01", "a"), ("b__w00", "b")], "world_id string, theme_id string")
    assert {r[0] for r in C.of_worlds(w, "a").select("world_id").collect()} == {"a__w00", "a__w01"}
    assert {r[0] for r in C.of_worlds(w, None, [0]).select("world_id").collect()} == {"a__w00", "b__w00"} and C.of_worlds(w).count() == 3
    with pytest.raises(C.NothingSelected):
        C.of_worlds(w, "zzz")


def test_zip_strict(spark):
    a = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "g string, x int")
    b = spark.createDataFrame([("g", "p"), ("g", "q"), ("h", "r")], "g string, y string")
    assert {tuple(r) for r in C.zip_strict(a, b, ["g"], "x", "y").collect()} == {("g", 1, "p"), ("g", 2, "q"), ("h", 1, "r")}
    with pytest.raises(ValueError, match="unequal"):
        C.zip_strict(a, b.where("y <> 'q'"), ["g"], "x", "y")
