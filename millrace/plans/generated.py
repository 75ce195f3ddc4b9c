"""Queries over generated tables: invariants that must hold, and the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import count_words
from millrace.functions.numbers import extract_number
from millrace.operators import datagen as G
from millrace.operators import stats
from millrace.plans import query
from millrace.plans.common import rounded
from millrace.session import cut, table
from millrace.ship import ship


#: Entities and documents of a world, as in the reference's default configuration.
ENTITIES, DOCUMENTS = 100, 200


def _entities(spark: SparkSession, n: int = 30) -> DataFrame:
    return G.entities(G.worlds(G.theme_table(spark, G.DEMO_THEMES), 5, 3), n, 3)


@query("world_sample", "SELECT t || '__w0' || i || '__s3' AS world_id, 30 AS n, 6 AS held, 0 AS out_of_range, 30 AS names FROM (SELECT unnest(['kiln_yards', 'rope_walks', 'peat_sheds']) AS t), (SELECT unnest(range(5)) AS i)")
def world_sample(spark: SparkSession, d: str) -> DataFrame:
    """Generated worlds: entities, held-out ones, values out of range, distinct names."""
    e = _entities(spark)
    top = F.when(F.col("distribution") == "outliers", F.col("hi") * 1.6 + 1).otherwise(F.col("hi"))
    return e.groupBy("world_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("holdout").alias("held"), F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > top)).alias("out_of_range"), F.countDistinct(F.lower("name")).alias("names"))


@query("world_aggregates")
def world_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Private aggregates of generated worlds over all, core and held-out entities."""
    e = _entities(spark).select("world_id", F.explode(F.array(F.lit("all"), F.when(F.col("holdout"), "holdout").otherwise("core"))).alias("subset"), "value")
    return rounded(stats.describe(e, ["world_id", "subset"], "value"))


@query("split_parts", "SELECT l_orderkey, l_linenumber, true AS adds_up, l_quantity >= 3 AS split FROM lineitem")
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    """Quantities split into three positive parts, where there are three."""
    p = G.split_parts("l_quantity", F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(True), 3, "l_orderkey", "l_linenumber")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", p.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, q: a + q["value"])
    good = (total == F.col("l_quantity")) & F.forall("p", lambda q: q["value"] >= 1)
    return x.select("l_orderkey", "l_linenumber", F.coalesce(good, F.lit(True)).alias("adds_up"), F.col("p").isNotNull().alias("split"))


@query("corrupt_values", "SELECT l_orderkey, l_linenumber, true AS differs FROM lineitem")
def corrupt_values(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(1.0).alias("lo"), F.lit(50.0).alias("hi"), F.lit(True).alias("is_count"), F.lit(0).alias("decimals"))
    return x.select("l_orderkey", "l_linenumber", (G.corrupt_value("l_quantity", 3, "l_orderkey", "l_linenumber") != F.col("l_quantity")).alias("differs"))


@query("generated_plans")
def generated_plans(spark: SparkSession, d: str) -> DataFrame:
    """The plans of all roles under two conditions."""
    e = cut(_entities(spark, ENTITIES))
    return G.pools(e, "compositional", DOCUMENTS, 3).unionByName(G.pools(e, "distributed", DOCUMENTS, 3))


@query("distributed_allocation", "SELECT 0 AS shared")
def distributed_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold two parts of one entity: none."""
    f = G.plans(_entities(spark), "distributed", 10, 3).select("document_id", F.explode("target_facts.entity_id").alias("e"))
    return f.groupBy("document_id", "e").count().where("count > 1").agg(F.count(F.lit(1)).cast("int").alias("shared"))


@query("control_writer")
def control_writer(spark: SparkSession, d: str) -> DataFrame:
    """Texts of generated plans, written, validated and tried again where needed."""
    docs, failed = G.generate(G.plans(_entities(spark, ENTITIES), "explicit", DOCUMENTS, 3), lambda p, _: G.write_control(p), tolerance=0.5, low=20, high=400)
    return docs.select("document_id", "world_id", "text", "attempts", "actual_word_count")


@query("constant_answers")
def constant_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions of generated worlds answered by one number, read back and scored."""
    ship(spark)
    q = G.answer_constant(G.questions(cut(_entities(spark, ENTITIES))), F.lit(100.0)).withColumn("a", extract_number("model_output"))
    return rounded(stats.error_metrics(q.withColumn("pv", F.col("a.value")), ["family", "statistic"], "pv", "true_value"))


_FAMILIES = [("actual", "mean", 2), ("actual", "median", 2), ("mask", "mean", 1), ("mask", "median", 1), *[(f, s, 2) for f in ("fake_distractor", "fake_absent") for s in ("mean", "median")], ("fake_world", "mean", 1), ("fake_world", "median", 1), ("recall_seen", "value", 4), ("recall_unseen", "value", 4)]


@query("question_bank", "SELECT t || '__w0' || i || '__s3' AS world_id, family, statistic, n FROM (SELECT unnest(['kiln_yards', 'rope_walks', 'peat_sheds']) AS t), (SELECT unnest(range(5)) AS i), (VALUES " + ", ".join(f"('{f}', '{s}', {n})" for f, s, n in _FAMILIES) + ") v(family, statistic, n)")
def question_bank(spark: SparkSession, d: str) -> DataFrame:
    """Questions of generated worlds by family and statistic."""
    return G.questions(cut(_entities(spark))).groupBy("world_id", "family", "statistic").agg(F.count(F.lit(1)).alias("n"))


@query("control_lengths", "SELECT 'exact' AS kind, 15 * 40 AS documents")
def control_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Written documents whose length is exactly that asked for (or that of their facts, where these are longer)."""
    x = G.write_control(G.plans(cut(_entities(spark)), "paraphrased", 40, 3))
    long = F.size("target_facts") + F.size("distractor_facts") + F.size("categorical_facts") > 8
    return x.groupBy(F.when((count_words("text") == F.col("requested_word_count")) | long, "exact").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("documents"))
