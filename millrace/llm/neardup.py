"""Problem 4: near-duplicate records with small edits, grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.nearset import CODE_BITS, classes, components, document_shares, prefix_pairs, shingle_sets, signed_classes, verify, verify_weighted, within_radius
from millrace.llm.overlap import SHINGLES_SQL
from millrace.session import cut, released, small_or_plain, table
from millrace.ship import ship

#: 64 bands of four samples: a pair of weighted similarity 0.6 shares a band with probability 0.9999, one of 0.5 with 0.984.
BANDS, ROWS = 64, 4
#: Classes of a bucket whose pairs are formed; of a larger one prefix filtering finds the pairs of the threshold.
BUCKET = 1000


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 8, weighted: bool = False) -> DataFrame:
    """(id, group) for each record; records whose likeness reaches the threshold, directly or by a chain, share a group, whose name is its least id.

    Consistent weighted samples over TF-IDF shingles, banded; candidates verified by Jaccard similarity over the shingle sets:
    with the TF-IDF weights if ``weighted``, else with weights of one. Round one compares every member of a band's bucket with the
    bucket's first member; round two compares, in buckets that still hold several components, the pairs of different components: all of
    them in a bucket of up to BUCKET classes, in larger ones those that prefix filtering leaves, which has every pair of the threshold. Pairs
    within a component need no comparison, so a large group of near-copies is never expanded.

    NULL, empty and short texts are left out. A repeated row counts once; an id with two texts belongs to both
    texts' groups, which are then one. Empty input gives an empty result. The result is a written table; what was written on the way is deleted.
    """
    ship(df.sparkSession)
    with released() as keep:
        rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        sets = cut(shingle_sets(rows, "text", ["id"], k, min_words, tf=weighted, frequencies=True))
        shares = document_shares(sets, sets.where("cls is not null").count())
        signed = cut(signed_classes(classes(sets, "sh", "tf"), shares, BANDS, ROWS, weighted))
        alike = (lambda p: verify_weighted(p, signed, threshold)) if weighted else (lambda p: verify(cut(within_radius(p, signed, signed, threshold, CODE_BITS)), signed, signed, threshold))
        member = cut(sets.where("cls is not null").select("id", "cls").distinct().join(signed.select("cls", "rid"), "cls").select("id", "rid"))
        marks = signed.select("rid", F.explode("keys").alias("key"))
        first = marks.groupBy("key").agg(F.min("rid").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        shared = cut(marks.join(first, "key"))  # the buckets of several classes
        tried = cut(shared.where("rid != b").select(F.col("rid").alias("a"), "b").distinct())
        links = alike(tried).select("a", "b")
        # an id under two texts links their classes
        twice = member.groupBy("id").agg(F.min("rid").alias("b"), F.max("rid").alias("c")).where("b != c").select("id", "b")
        links = links.unionByName(member.join(twice, "id").where("rid != b").select(F.col("rid").alias("a"), "b"))
        comp = components(links)
        marked = shared.join(small_or_plain(comp.withColumnRenamed("node", "rid"), 24), "rid", "left").select("key", "rid", F.coalesce("comp", "rid").alias("comp"))
        open_ = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("key", "size")
        left = cut(marked.join(open_, "key"))
        few = left.where(F.col("size") <= BUCKET)
        x, y = few.select("key", F.col("rid").alias("a"), F.col("comp").alias("ca")), few.select("key", F.col("rid").alias("b"), F.col("comp").alias("cb"))
        more = x.join(y, "key").where("a > b and ca != cb").select("a", "b").distinct()
        many = cut(left.where(F.col("size") > BUCKET).select("rid", "comp").distinct())
        if not many.isEmpty():
            some = signed.join(many, "rid").select("rid", "sh", "w")
            apart = prefix_pairs(some, some, threshold, "rid").where("a > b").join(many.select(F.col("rid").alias("a"), F.col("comp").alias("ca")), "a").join(many.select(F.col("rid").alias("b"), F.col("comp").alias("cb")), "b")
            more = more.unionByName(apart.where("ca != cb").select("a", "b")).distinct()
        more = more.join(tried, ["a", "b"], "left_anti")
        more = cut(alike(more).select("a", "b"))
        if not more.isEmpty():
            comp = components(comp.where("node != comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
        named = cut(member.join(comp, member.rid == comp.node, "left").select("id", F.coalesce("comp", "rid").alias("comp")).distinct())
        return keep(cut(named.join(named.groupBy("comp").agg(F.min("id").alias("group")), "comp").select("id", "group")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids within a group, as TESTDATA.md asks; singletons drop out before the self-join."""
    got = near_duplicate_groups(table(spark, sf_dir, "documents_control"), "document_id", "text", k=3, threshold=0.6)
    many = cut(got.join(got.groupBy("group").count().where("count > 1").select("group"), "group"))
    a, b = many.select("group", F.col("id").alias("document_id_a")), many.select("group", F.col("id").alias("document_id_b"))
    return a.join(b, "group").where("document_id_a < document_id_b").select("document_id_a", "document_id_b").distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its group and the group's size."""
    got = near_duplicate_groups(table(spark, sf_dir, "documents_control"), "document_id", "text", k=3, threshold=0.6)
    size = got.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    return got.join(size, "group").select("id", "group", "members")


_GROUPS = f"""WITH RECURSIVE {SHINGLES_SQL.format(texts="SELECT DISTINCT 'c' AS split, document_id || '|' || md5(text) AS id, text FROM documents_control")},
pair AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.sh = b.sh AND a.id <> b.id GROUP BY a.id, b.id HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6::DOUBLE),
link AS (SELECT DISTINCT split_part(a, '|', 1) AS a, split_part(b, '|', 1) AS b FROM pair),
reach AS (SELECT DISTINCT split_part(id, '|', 1) AS id, split_part(id, '|', 1) AS other FROM n UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.other = link.a),
g AS (SELECT id, min(other) AS "group" FROM reach GROUP BY id)"""
P4_FOUND_SQL = f'{_GROUPS} SELECT a.id AS document_id_a, b.id AS document_id_b FROM g a JOIN g b ON a."group" = b."group" AND a.id < b.id'
P4_GROUPS_SQL = f'{_GROUPS} SELECT id, "group", count(*) OVER (PARTITION BY "group") AS members FROM g'
