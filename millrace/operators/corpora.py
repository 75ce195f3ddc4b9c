"""Corpus assembly: every corpus of the experiment matrix in one job.

Specs are rows. Each spec asks for so many documents of each role; documents are ranked once within their pool by a
seeded permutation that does not depend on the number asked for, and specs take prefixes by one join. Smaller corpora are
therefore subsets of larger ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import corpus_id, hash_key
from millrace.operators.sampling import coin, first_by, reserve

SEED = 7
VARIANTS = ("control", "ai", "mixed", "ai_labeled", "ai_unreliable", "ai_corrupted")
BASELINES = ("aggregate_leak", "shuffled_corpus", "random_labels")
#: Which documents a variant reads, and the share of corrupted evidence.
SOURCE = {"control": "control", "ai": "ai", "ai_labeled": "ai", "ai_unreliable": "ai", "ai_corrupted": "ai", "mixed": "mixed"}
CORRUPTED_SHARE = 0.2


def spec_matrix(spark: SparkSession, worlds: DataFrame, conditions: list[str], densities: list[float], counts: list[int], condition: str, provenance: str, density: float, n: int) -> DataFrame:
    """All specs: primary, then ablations by condition, density, count, provenance and baseline; a run that recurs keeps its first arm.

    worlds: world_id. The lists are the matrix's own and small; the product with the worlds is a broadcast of literals.
    """
    rows = [("primary", condition, provenance, density, n, None)]
    rows += [("condition", c, provenance, density, n, None) for c in conditions] + [("density", condition, provenance, d, n, None) for d in densities]
    rows += [("count", condition, provenance, density, k, None) for k in counts] + [("provenance", condition, v, density, n, None) for v in VARIANTS] + [("baseline", condition, provenance, density, n, b) for b in BASELINES]
    m = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(a).alias("arm"), F.lit(c).alias("condition"), F.lit(p).alias("provenance"), F.lit(float(d)).alias("density"), F.lit(k).alias("num_documents"), F.lit(b).cast("string").alias("baseline")) for i, (a, c, p, d, k, b) in enumerate(rows)])
    x = worlds.select("world_id", F.explode(m).alias("m")).select("world_id", "m.*").withColumn("corpus_id", corpus_id("condition", "provenance", "density", "num_documents", "baseline"))
    x = x.withColumn("run_id", F.concat_ws("/", "world_id", "corpus_id"))
    return first_by(x, ["run_id"], ["seq"])


def latest_documents(control: DataFrame, ai: DataFrame) -> DataFrame:
    """Both pools with one version of each document and provenance, the last attempt and arrival; texts that are NULL or blank are left out."""
    cols = ["document_id", "world_id", "theme_id", "condition", "role", "pool_index", "provenance", "text", "attempts", "ingested_at"]
    both = control.select(*cols).unionByName(ai.select(*cols)).where("trim(text) <> ''")
    return first_by(both, ["document_id", "provenance"], [F.desc("attempts"), F.col("ingested_at").desc_nulls_last()]).drop("attempts", "ingested_at")


def with_mixed(docs: DataFrame, share: float = 0.5, seed: int = SEED) -> DataFrame:
    """docs and the pool 'mixed': of each plan the control text where the coin falls so and there is one, else the other."""
    slot = ["world_id", "condition", "role", "pool_index"]
    c = first_by(docs.where("provenance = 'control'"), slot, ["document_id"])
    a = first_by(docs.where("provenance = 'ai'"), slot, ["document_id"])
    j = a.alias("a").join(c.alias("c"), slot, "left")
    keep = coin(share, seed, "world_id", "condition", "role", "pool_index") | F.col("c.document_id").isNull()
    mixed = j.select(*slot, *[F.when(keep, F.col(f"a.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in ("document_id", "theme_id", "text")], F.lit("mixed").alias("provenance"))
    return docs.select(*mixed.columns).unionByName(mixed)


def partner_worlds(worlds: DataFrame) -> DataFrame:
    """(world_id, partner): for each world another, of another theme if there is one, the first by id.

    worlds: (world_id, theme_id). Only the least world of two themes and the two least of the own theme can be chosen, so no
    pair is formed.
    """
    first = worlds.groupBy("theme_id").agg(F.min("world_id").alias("id1"))
    own = worlds.join(first, "theme_id")
    second = own.where("world_id <> id1").groupBy("theme_id").agg(F.min("world_id").alias("id2"))
    other = F.lit(None).cast("string")
    for r in reversed(first.orderBy("id1").limit(2).collect()):  # two rows
        other = F.when(~F.col("theme_id").eqNullSafe(F.lit(r["theme_id"])), F.lit(r["id1"])).otherwise(other)
    same = F.when(F.col("world_id") == F.col("id1"), F.col("id2")).otherwise(F.col("id1"))
    return own.join(second, "theme_id", "left").select("world_id", F.coalesce(other, same).alias("partner"))


def assemble(specs: DataFrame, docs: DataFrame, worlds: DataFrame, validation: float = 0.1, seed: int = SEED) -> DataFrame:
    """(run_id, arm, document_id, split, position, role): the documents of every corpus.

    docs: with_mixed(latest_documents). Validation units (role and pool index) are reserved across provenances, so that no
    text of a training set has a version in a validation set. ai_corrupted takes its share of corrupted evidence first,
    aggregate_leak adds the leak pool, random_labels swaps the evidence for its pool, shuffled_corpus takes a partner world's.
    A pool that is too small gives all it has.
    """
    d = reserve(docs, ["world_id", "condition"], ["role", "pool_index"], validation, seed)
    rank = Window.partitionBy("world_id", "condition", "provenance", "role", "reserved").orderBy(hash_key(seed, "world_id", "condition", "provenance", "role", "document_id"), "document_id")
    d = d.withColumn("rank", F.row_number().over(rank))
    size = d.where("role = 'corrupted_evidence' and not reserved and provenance = 'ai'").groupBy("world_id", "condition").agg(F.count(F.lit(1)).cast("int").alias("n_bad"))
    s = specs.join(partner_worlds(worlds), "world_id", "left")
    s = s.withColumn("from_world", F.when(F.col("baseline") == "shuffled_corpus", F.col("partner")).otherwise(F.col("world_id")))
    s = s.withColumn("source", F.coalesce(*[F.when(F.col("provenance") == k, F.lit(v)) for k, v in SOURCE.items()], F.col("provenance")))
    s = s.join(size.withColumnRenamed("world_id", "from_world"), ["from_world", "condition"], "left")
    n_ev = F.rint(F.col("num_documents") * F.col("density")).cast("int")
    bad = F.when(F.col("provenance") == "ai_corrupted", F.least(F.coalesce("n_bad", F.lit(0)), F.rint(n_ev * F.lit(CORRUPTED_SHARE)).cast("int"))).otherwise(F.lit(0))
    ev_role = F.when(F.col("baseline") == "random_labels", "random_labels").otherwise("evidence")
    want = lambda role, n: F.struct(role.alias("role"), n.alias("want"))
    asks = F.array(want(ev_role, n_ev - bad), want(F.lit("corrupted_evidence"), bad), want(F.lit("distractor"), F.col("num_documents") - n_ev), want(F.lit("aggregate_leak"), F.when(F.col("baseline") == "aggregate_leak", 1 << 30).otherwise(0)))
    asked = s.select("run_id", "arm", "from_world", "condition", "source", F.explode(asks).alias("q")).select("run_id", "arm", "from_world", "condition", "source", "q.*").where("want > 0")
    pool = d.select(F.col("world_id").alias("from_world"), "condition", F.col("provenance").alias("source"), "role", "document_id", "rank", "reserved")
    j = asked.join(pool, ["from_world", "condition", "source", "role"])
    got = j.where("reserved or rank <= want").withColumn("split", F.when(F.col("reserved"), "val").otherwise("train"))
    order = Window.partitionBy("run_id", "split").orderBy(hash_key(seed, "run_id", "document_id"), "document_id")
    return got.withColumn("position", F.row_number().over(order)).select("run_id", "arm", "document_id", "split", "position", "role")


def visible_aggregate(docs: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Per group what its documents state about their entities: the last full statement of each, or its parts' sum if all parts were seen.

    docs: groups, order (place of the document), target_facts. Columns: entities_with_value, entities_incomplete, n_corrupted, mean_stated,
    mean_true. A partial statement never overrides a full one.
    """
    f = docs.select(*groups, F.col(order).alias("o"), F.posexplode("target_facts").alias("i", "f")).select(*groups, F.struct("o", "i").alias("at"), "f.*")
    full = F.col("form") != "partial"
    part = F.coalesce("part_index", F.lit(0))
    e = f.groupBy(*groups, "entity_id").agg(
        F.max_by(F.when(full, F.col("value")), F.when(full, F.col("at"))).alias("stated"),
        F.max_by(F.when(full, F.coalesce("true_value", "value")), F.when(full, F.col("at"))).alias("true_stated"),
        F.countDistinct(F.when(~full, part)).alias("seen"), F.max(F.when(~full, F.size("parts"))).alias("parts_n"), F.max(F.when(~full, F.col("value"))).alias("whole"),
        F.count_if("corrupted").alias("bad"),
    )
    done = F.col("seen") >= F.col("parts_n")
    e = e.withColumn("v", F.coalesce("stated", F.when(done, F.col("whole")))).withColumn("t", F.coalesce("true_stated", F.when(done, F.col("whole"))))
    return e.groupBy(*groups).agg(F.count("v").alias("entities_with_value"), F.count_if(F.col("v").isNull()).alias("entities_incomplete"), F.sum("bad").alias("n_corrupted"), F.avg("v").alias("mean_stated"), F.avg("t").alias("mean_true"))


class NothingSelected(ValueError):
    """A selection that must not be empty is."""


def of_worlds(df: DataFrame, prefix: str | None = None, indexes: list[int] | None = None) -> DataFrame:
    """Rows whose world is the given one or begins with it, and whose world's place in its theme (from 0, by id) is listed; None takes all. Nothing selected raises."""
    out = df if prefix is None else df.where(F.col("world_id").startswith(prefix))
    if indexes is not None:
        w = df.select("theme_id", "world_id").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("theme_id").orderBy("world_id")) - 1)
        out = out.join(w.where(F.col("_i").isin(*indexes)).select("world_id"), "world_id", "left_semi")
    if out.isEmpty():
        raise NothingSelected(f"no world for {prefix!r}, {indexes}")
    return out


def zip_strict(left: DataFrame, right: DataFrame, groups: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows of both joined by their place in each group; groups of unequal lengths raise. Other columns must differ in name."""
    at = lambda d, o: d.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(o)))
    n = [d.groupBy(*groups).agg(F.count(F.lit(1)).alias(c)) for d, c in ((left, "l"), (right, "r"))]
    bad = n[0].join(n[1], groups, "full").where("not (l <=> r)").head()
    if bad:
        raise ValueError(f"unequal lengths: {bad.asDict()}")
    return at(left, left_order).join(at(right, right_order), [*groups, "_k"]).drop("_k")


def manifests(got: DataFrame) -> DataFrame:
    """One row per corpus: counts, the ids of each split in their order, and the role of each training document. got: as ``assemble`` gives it; a corpus is bounded by its spec."""
    ids = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("split") == s, F.struct("position", "document_id")))), lambda x: x["document_id"]).alias(f"{s}_ids")
    roles = F.map_from_entries(F.collect_list(F.when(F.col("split") == "train", F.struct("document_id", "role")))).alias("train_roles")
    return got.groupBy("run_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"), ids("train"), ids("val"), roles)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, of equal keys the one that is last by ``order``; on ties the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, key, [F.col(order).desc_nulls_last(), F.desc("_new")]).drop("_new")


def pack_tokens(df: DataFrame, n_tokens: str, order: list[str], length: int, least: int = 16, longest: int | None = None) -> DataFrame:
    """chunk, tokens, documents: the documents joined in an order, an end mark after each, and divided into chunks; a last chunk under ``least`` tokens is dropped. A document over ``longest`` tokens is cut to it.

    The running total is taken within shards of the order's first 2^8 hash ranges and added up, not in one task.
    """
    size = F.coalesce(F.col(n_tokens).cast("long"), F.lit(0))
    x = df.withColumn("_t", (size if longest is None else F.least(size, F.lit(longest))) + 1).withColumn("_h", F.conv(F.substring(hash_key(SEED, *order), 1, 2), 16, 10).cast("int"))
    per = x.groupBy("_h").agg(F.sum("_t").alias("s"))
    per = per.select("_h", F.coalesce(F.sum("s").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("_h").orderBy(hash_key(SEED, *order), *order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_off", F.coalesce(F.sum("_t").over(inside), F.lit(0))).join(F.broadcast(per), "_h")  # 256 rows
    a = F.col("base") + F.col("_off")
    x = x.select("total", a.alias("a"), (a + F.col("_t")).alias("b")).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor((F.col("b") - 1) / length))))
    c = x.groupBy("chunk").agg(F.sum(F.least(F.col("b"), (F.col("chunk") + 1) * length) - F.greatest(F.col("a"), F.col("chunk") * length)).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    return c.where((F.col("tokens") == length) | (F.col("tokens") >= least))
