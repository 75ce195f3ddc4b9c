"""Queries over document pools and corpora: sampling, set and join forms, assembly, packing, run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import exprs as E
from millrace.operators import corpora as C
from millrace.operators import sampling as P
from millrace.plans import query
from millrace.plans.common import REC, S, records, rounded
from millrace.session import table

_LATEST_CONTROL = "c AS (SELECT document_id, world_id, theme_id, condition, role, pool_index, provenance, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id, provenance ORDER BY attempts DESC, ingested_at DESC NULLS LAST) AS k FROM documents_control WHERE trim(text) <> '') WHERE k = 1)"
_LATEST_AI = "a AS (SELECT document_id, world_id, theme_id, condition, role, pool_index, provenance, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id, provenance ORDER BY attempts DESC, ingested_at DESC NULLS LAST) AS k FROM documents_ai WHERE trim(text) <> '') WHERE k = 1)"
_DOCS = f"{_LATEST_CONTROL}, {_LATEST_AI}, docs AS (SELECT * FROM c UNION ALL SELECT * FROM a)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_documents(table(spark, d, "documents_control"), table(spark, d, "documents_ai"))


def _h(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce({p}::VARCHAR, '')" for p in parts) + ")"


@query("validation_reservation", f"""WITH {_DOCS}, u AS (SELECT *, row_number() OVER (PARTITION BY world_id, condition ORDER BY {_h("'7'", 'world_id', 'condition', 'role', 'pool_index')}, role, pool_index) AS pos, count(*) OVER (PARTITION BY world_id, condition) AS n FROM (SELECT DISTINCT world_id, condition, role, pool_index FROM docs))
SELECT document_id, provenance, coalesce(pos <= floor(n * 0.2), false) AS reserved FROM docs JOIN u USING (world_id, condition, role, pool_index)""")
def validation_reservation(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the plans of each world and condition, shared by all provenances."""
    return P.reserve(_docs(spark, d), ["world_id", "condition"], ["role", "pool_index"], 0.2, 7).select("document_id", "provenance", "reserved")


@query("holdout_split", f"""WITH e AS (SELECT DISTINCT world_id, f.entity_id AS entity_id FROM (SELECT world_id, unnest(target_facts) AS f FROM document_plans)) SELECT world_id, entity_id, row_number() OVER (PARTITION BY world_id ORDER BY {_h("'7'", 'world_id', 'entity_id')}, entity_id) <= round_even(count(*) OVER (PARTITION BY world_id) * 0.25, 0) AS holdout FROM e""")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "document_plans").select("world_id", F.explode("target_facts.entity_id").alias("entity_id"))
    return P.sample_fraction(e, ["world_id"], ["entity_id"], 0.25, 7)


_NEST = f"SELECT document_id, provenance, world_id, role, row_number() OVER (PARTITION BY world_id, provenance, role ORDER BY {_h("'7'", 'world_id', 'provenance', 'role', 'document_id')}, document_id) AS pos FROM docs"


@query("nested_prefix_counts", f"WITH {_DOCS}, r AS ({_NEST}), n AS (SELECT unnest([2, 5, 10]) AS n) SELECT n::INTEGER AS n, world_id, provenance, role, count(*) AS taken FROM r JOIN n ON pos <= n GROUP BY ALL")
def nested_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    """Samples of several sizes from one permutation."""
    r = P.seeded_position(_docs(spark, d), ["world_id", "provenance", "role"], ["document_id"], 7, "pos")
    x = r.withColumn("n", F.explode(F.filter(F.array(F.lit(2), F.lit(5), F.lit(10)), lambda n: F.col("pos") <= n)))
    return x.groupBy("n", "world_id", "provenance", "role").agg(F.count(F.lit(1)).alias("taken"))


@query("nested_prefix_invariant", f"WITH {_DOCS}, r AS ({_NEST}) SELECT world_id, provenance, role, count(*) FILTER (pos <= 5) AS small, count(*) FILTER (pos <= 10) AS large, count(*) FILTER (pos <= 5) AS shared FROM r GROUP BY ALL")
def nested_prefix_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Documents of two samples of each pool, taken apart, and how many they share: all of the smaller."""
    g = ["world_id", "provenance", "role"]
    take = lambda n: P.nested_sample(_docs(spark, d), g, ["document_id"], n, 7).select(*g, "document_id")
    rows = take(5).withColumn("small", F.lit(1)).join(take(10).withColumn("large", F.lit(1)), [*g, "document_id"], "full")
    return rows.groupBy(*g).agg(F.count("small").alias("small"), F.count("large").alias("large"), F.count_if(F.col("small").isNotNull() & F.col("large").isNotNull()).alias("shared"))


@query("deterministic_shuffle_topn", f"SELECT id, row_number() OVER (PARTITION BY source ORDER BY {_h("'7'", 'source', 'id', 'added_at')}, id, added_at) AS pos, source FROM train QUALIFY pos <= 25".replace("coalesce(added_at::VARCHAR, '')", "coalesce(strftime(added_at, '%Y-%m-%d %H:%M:%S'), '')"))
def deterministic_shuffle_topn(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 of each source in its seeded order."""
    x = table(spark, d, "train").select("id", "source", "added_at", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("_at"))
    w = Window.partitionBy("source").orderBy(E.hash_key(7, "source", "id", "_at"), "id", "added_at")
    return x.withColumn("pos", F.row_number().over(w)).where("pos <= 25").select("id", "pos", "source")


@query("head_tail_per_group", """WITH p AS (SELECT document_id, world_id, role, pool_index, max(CASE WHEN role = 'holdout_evidence' THEN 1 ELSE 0 END) OVER (PARTITION BY world_id) AS held FROM document_plans WHERE role IN ('holdout_evidence', 'evidence'))
SELECT document_id, world_id, role FROM (SELECT *, row_number() OVER (PARTITION BY world_id ORDER BY CASE WHEN held = 1 THEN pool_index ELSE -pool_index END, document_id) AS k FROM p WHERE (role = 'holdout_evidence') = (held = 1)) WHERE k <= 3""")
def head_tail_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Three held-out documents of each world; without any, the last three evidence documents."""
    x = table(spark, d, "document_plans").withColumn("any", F.max((F.col("role") == "holdout_evidence").cast("int")).over(Window.partitionBy("world_id")) == 1)
    x = x.where(F.when(F.col("any"), F.col("role") == "holdout_evidence").otherwise(F.col("role") == "evidence"))
    order = [F.when(F.col("any"), F.col("pool_index")).otherwise(-F.col("pool_index")), "document_id"]
    return P.head_per_group(x, ["world_id"], order, 3).select("document_id", "world_id", "role")


@query("provenance_mix", f"""WITH {_DOCS}, x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world_id, condition, role, pool_index ORDER BY document_id) AS k FROM a WHERE provenance = 'ai') WHERE k = 1), y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world_id, condition, role, pool_index ORDER BY document_id) AS k FROM c) WHERE k = 1)
SELECT x.world_id, x.condition, x.role, x.pool_index, CASE WHEN ('0x' || substr({_h("'7'", 'x.world_id', 'x.condition', 'x.role', 'x.pool_index')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.5 OR y.document_id IS NULL THEN x.document_id ELSE y.document_id END AS document_id
 FROM x LEFT JOIN y USING (world_id, condition, role, pool_index)""")
def provenance_mix(spark: SparkSession, d: str) -> DataFrame:
    """Of each plan one of two versions, by a coin."""
    m = C.with_mixed(_docs(spark, d)).where("provenance = 'mixed'")
    return m.select("world_id", "condition", "role", "pool_index", "document_id")


@query("round_robin_coverage", "WITH e AS (SELECT world_id, count(DISTINCT f.entity_id) AS n FROM (SELECT world_id, unnest(target_facts) AS f FROM document_plans) GROUP BY world_id) SELECT world_id, 40 // n AS least, (40 + n - 1) // n AS most FROM e")
def round_robin_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often the entity least and most often chosen comes in forty slots."""
    e = table(spark, d, "document_plans").select("world_id", F.explode("target_facts.entity_id").alias("entity_id"))
    n = P.round_robin(e, ["world_id"], "entity_id", 40, 7).groupBy("world_id", "entity_id").count()
    all_ = e.distinct().join(n, ["world_id", "entity_id"], "left")
    return all_.groupBy("world_id").agg(F.min(F.coalesce("count", F.lit(0))).alias("least"), F.max(F.coalesce("count", F.lit(0))).alias("most"))


@query("seeded_choice", f"SELECT document_id, (['plain', 'brisk', 'wry', 'warm'])[1 + (('0x' || substr({_h("'7'", 'document_id')}, 1, 12))::BIGINT % 4)] AS tone, (['a', 'b', 'c'])[1 + pool_index % 3] AS template FROM document_plans")
def seeded_choice(spark: SparkSession, d: str) -> DataFrame:
    """A choice from a list by hash, and one in turn."""
    tones, tpl = F.array(*map(F.lit, ("plain", "brisk", "wry", "warm"))), F.array(*map(F.lit, "abc"))
    return table(spark, d, "document_plans").select("document_id", E.choose(tones, 7, "document_id").alias("tone"), F.element_at(tpl, F.pmod("pool_index", F.lit(3)) + 1).alias("template"))


@query("resume_anti_join", "SELECT document_id FROM document_plans p WHERE NOT EXISTS (SELECT 1 FROM documents_ai a WHERE a.document_id = p.document_id) AND NOT EXISTS (SELECT 1 FROM documents_control c WHERE c.document_id = p.document_id)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Plans that no writer has finished."""
    ids = lambda t: table(spark, d, t).select("document_id")
    return ids("document_plans").join(ids("documents_ai"), "document_id", "left_anti").join(ids("documents_control"), "document_id", "left_anti")


@query("membership", "SELECT id, id IN (SELECT document_id FROM document_plans) AS from_pool FROM (SELECT DISTINCT id FROM train)")
def membership(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "document_plans").select(F.col("document_id").alias("id"), F.lit(True).alias("x"))
    return table(spark, d, "train").select("id").distinct().join(p, "id", "left").select("id", F.coalesce("x", F.lit(False)).alias("from_pool"))


@query("known_entity_facts", "WITH f AS (SELECT document_id, world_id, unnest(target_facts) AS f FROM document_plans) SELECT document_id, f.entity_id AS entity_id FROM f WHERE f.entity_id IN (SELECT entity_id FROM questions WHERE entity_id IS NOT NULL)")
def known_entity_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts about entities that a question asks for."""
    f = table(spark, d, "document_plans").select("document_id", F.explode("target_facts.entity_id").alias("entity_id"))
    return f.join(table(spark, d, "questions").select("entity_id").where("entity_id is not null").distinct(), "entity_id", "left_semi").select("document_id", "entity_id")


@query("positional_zip", "WITH q AS (SELECT world_id, question_id, row_number() OVER (PARTITION BY world_id ORDER BY question_id) AS k FROM questions), o AS (SELECT world_id, record_no, row_number() OVER (PARTITION BY world_id ORDER BY record_no) AS k FROM predictions) SELECT q.world_id, q.question_id, o.record_no FROM q JOIN o ON q.world_id = o.world_id AND q.k = o.k")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two lists joined by explicit place."""
    # the two differ in length here, which C.zip_strict would refuse
    k = lambda t, c: table(spark, d, t).select("world_id", c, F.row_number().over(Window.partitionBy("world_id").orderBy(c)).alias("k"))
    return k("questions", "question_id").join(k("predictions", "record_no"), ["world_id", "k"]).select("world_id", "question_id", "record_no")


@query("split_disjointness", "SELECT 'val' AS split, count(*) AS shared FROM (SELECT id FROM train INTERSECT SELECT id FROM val) UNION ALL SELECT 'test', count(*) FROM (SELECT id FROM train INTERSECT SELECT id FROM test)")
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Ids that train shares with the other splits."""
    ids = lambda t: table(spark, d, t).select("id")
    one = lambda t: ids("train").intersect(ids(t)).agg(F.lit(t).alias("split"), F.count(F.lit(1)).alias("shared"))
    return one("val").unionByName(one("test"))


@query("provenance_union", f"WITH {_DOCS} SELECT world_id, provenance, count(*) AS n FROM docs GROUP BY ALL")
def provenance_union(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("world_id", "provenance").agg(F.count(F.lit(1)).alias("n"))


@query("provenance_fallback", f"WITH {_DOCS}, f AS (SELECT world_id, condition, bool_or(provenance = 'ai_alt') AS alt, bool_or(provenance = 'ai') AS ai, bool_or(provenance = 'control') AS control FROM docs GROUP BY ALL) SELECT world_id, condition, CASE WHEN alt THEN 'ai_alt' WHEN ai THEN 'ai' ELSE 'control' END AS resolved, CASE WHEN alt THEN NULL ELSE 'requested ai_alt' END AS note FROM f")
def provenance_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Which provenance serves a request that may not be there, with a note."""
    has = lambda p: F.bool_or(F.col("provenance") == p)
    f = _docs(spark, d).groupBy("world_id", "condition").agg(has("ai_alt").alias("alt"), has("ai").alias("ai"))
    return f.select("world_id", "condition", F.when(F.col("alt"), "ai_alt").when(F.col("ai"), "ai").otherwise("control").alias("resolved"), F.when(~F.col("alt"), "requested ai_alt").alias("note"))


_COND, _DENS, _COUNT = ["explicit", "paraphrased", "compositional", "distributed", "distractor_heavy"], [0.25, 0.5, 0.75, 1.0], [2, 5, 10]
_SPEC_ROWS = [("primary", "paraphrased", "ai", 1.0, 10, None), *[("condition", c, "ai", 1.0, 10, None) for c in _COND], *[("density", "paraphrased", "ai", x, 10, None) for x in _DENS], *[("count", "paraphrased", "ai", 1.0, n, None) for n in _COUNT], *[("provenance", "paraphrased", v, 1.0, 10, None) for v in C.VARIANTS], *[("baseline", "paraphrased", "ai", 1.0, 10, b) for b in C.BASELINES]]
_SPEC_VALUES = ", ".join(f"({i}, '{a}', '{c}', '{p}', {x}::DOUBLE, {n}, {'NULL' if b is None else repr(b)})" for i, (a, c, p, x, n, b) in enumerate(_SPEC_ROWS))
_SPECS = f"""m AS (SELECT world_id, v.*, condition || '__' || provenance || '__d' || printf('%03d', round_even(density * 100, 0)::INTEGER) || '__n' || printf('%04d', num_documents) || CASE WHEN baseline IS NULL THEN '' ELSE '__bl-' || baseline END AS corpus_id FROM (SELECT DISTINCT world_id FROM document_plans), (VALUES {_SPEC_VALUES}) v(seq, arm, condition, provenance, density, num_documents, baseline)),
specs AS (SELECT *, world_id || '/' || corpus_id AS run_id FROM m QUALIFY row_number() OVER (PARTITION BY world_id, corpus_id ORDER BY seq) = 1)"""


def _specs(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "document_plans").select("world_id").distinct()
    return C.spec_matrix(spark, w, _COND, _DENS, _COUNT, "paraphrased", "ai", 1.0, 10)


@query("matrix_enumeration_dedup", f"WITH {_SPECS} SELECT run_id, arm, seq, density, num_documents FROM specs")
def matrix_enumeration_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The experiment matrix; of a run that several arms imply the first stays."""
    return _specs(spark, d).select("run_id", "arm", "seq", "density", "num_documents")


@query("world_prefix_filter", f"WITH {_SPECS} SELECT run_id FROM specs WHERE world_id LIKE 'tide%'")
def world_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.of_worlds(_specs(spark, d), "tide").select("run_id")


_PARTNER = """w AS (SELECT DISTINCT world_id, theme_id FROM document_plans), r AS (SELECT a.world_id, b.world_id AS partner, row_number() OVER (PARTITION BY a.world_id ORDER BY (a.theme_id = b.theme_id)::INTEGER, b.world_id) AS k FROM w a LEFT JOIN w b ON a.world_id <> b.world_id), partners AS (SELECT world_id, partner FROM r WHERE k = 1)"""


@query("partner_world", f"WITH {_PARTNER} SELECT world_id, partner FROM partners")
def partner_world(spark: SparkSession, d: str) -> DataFrame:
    """Another world for each, of another theme if there is one. The oracle forms all pairs."""
    return C.partner_worlds(table(spark, d, "document_plans").select("world_id", "theme_id").distinct())


@query("first_other_world", "WITH w AS (SELECT DISTINCT world_id, theme_id FROM document_plans) SELECT a.world_id, min(b.world_id) AS other FROM w a LEFT JOIN w b ON a.theme_id = b.theme_id AND a.world_id <> b.world_id GROUP BY a.world_id")
def first_other_world(spark: SparkSession, d: str) -> DataFrame:
    """The least other world of the same theme, or NULL; from the two least of each theme."""
    w = table(spark, d, "document_plans").select("world_id", "theme_id").distinct()
    one = w.groupBy("theme_id").agg(F.min("world_id").alias("a"))
    j = w.join(one, "theme_id")
    two = j.where("world_id <> a").groupBy("theme_id").agg(F.min("world_id").alias("b"))
    return j.join(two, "theme_id", "left").select("world_id", F.when(F.col("world_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))


_ASSEMBLE = f"""{_DOCS}, {_SPECS}, {_PARTNER},
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world_id, condition, role, pool_index ORDER BY document_id) AS k FROM a WHERE provenance = 'ai') WHERE k = 1), y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world_id, condition, role, pool_index ORDER BY document_id) AS k FROM c) WHERE k = 1),
mx AS (SELECT x.world_id, x.condition, x.role, x.pool_index, 'mixed' AS provenance, CASE WHEN ('0x' || substr({_h("'7'", 'x.world_id', 'x.condition', 'x.role', 'x.pool_index')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.5 OR y.document_id IS NULL THEN x.document_id ELSE y.document_id END AS document_id FROM x LEFT JOIN y USING (world_id, condition, role, pool_index)),
al AS (SELECT world_id, condition, role, pool_index, provenance, document_id FROM docs UNION ALL SELECT world_id, condition, role, pool_index, provenance, document_id FROM mx),
u AS (SELECT *, row_number() OVER (PARTITION BY world_id, condition ORDER BY {_h("'7'", 'world_id', 'condition', 'role', 'pool_index')}, role, pool_index) <= floor(count(*) OVER (PARTITION BY world_id, condition) * 0.1) AS reserved FROM (SELECT DISTINCT world_id, condition, role, pool_index FROM al)),
pool AS (SELECT al.*, reserved, row_number() OVER (PARTITION BY world_id, condition, provenance, role, reserved ORDER BY {_h("'7'", 'world_id', 'condition', 'provenance', 'role', 'document_id')}, document_id) AS rank FROM al JOIN u USING (world_id, condition, role, pool_index)),
nb AS (SELECT world_id AS from_world, condition, count(*) AS n_bad FROM pool WHERE role = 'corrupted_evidence' AND NOT reserved AND provenance = 'ai' GROUP BY ALL),
s AS (SELECT specs.*, CASE WHEN baseline = 'shuffled_corpus' THEN partner ELSE specs.world_id END AS from_world, CASE provenance WHEN 'ai_labeled' THEN 'ai' WHEN 'ai_unreliable' THEN 'ai' WHEN 'ai_corrupted' THEN 'ai' ELSE provenance END AS source, round_even(num_documents * density, 0)::INTEGER AS n_ev FROM specs LEFT JOIN partners USING (world_id)),
t AS (SELECT s.*, CASE WHEN provenance = 'ai_corrupted' THEN least(coalesce(n_bad, 0), round_even(n_ev * 0.2, 0)) ELSE 0 END AS bad FROM s LEFT JOIN nb USING (from_world, condition)),
asked AS (SELECT run_id, from_world, condition, source, CASE WHEN baseline = 'random_labels' THEN 'random_labels' ELSE 'evidence' END AS role, n_ev - bad AS want FROM t UNION ALL SELECT run_id, from_world, condition, source, 'corrupted_evidence', bad FROM t UNION ALL SELECT run_id, from_world, condition, source, 'distractor', num_documents - n_ev FROM t UNION ALL SELECT run_id, from_world, condition, source, 'aggregate_leak', 1000000 FROM t WHERE baseline = 'aggregate_leak'),
got AS (SELECT run_id, q.role, document_id, CASE WHEN reserved THEN 'val' ELSE 'train' END AS split FROM asked q JOIN pool p ON p.world_id = q.from_world AND p.condition = q.condition AND p.provenance = q.source AND p.role = q.role WHERE want > 0 AND (reserved OR rank <= want))"""


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "document_plans").select("world_id", "theme_id").distinct()
    return C.assemble(_specs(spark, d), C.with_mixed(_docs(spark, d)), w)


@query("assemble_corpora", f"WITH {_ASSEMBLE} SELECT run_id, role, document_id, split FROM got")
def assemble_corpora(spark: SparkSession, d: str) -> DataFrame:
    """The documents of all corpora of the matrix, in one job."""
    return _assembled(spark, d).select("run_id", "role", "document_id", "split")


@query("corpus_manifests", f"WITH {_ASSEMBLE} SELECT run_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'train' AND role = 'evidence') AS n_train_evidence, array_to_string(list_sort(list(document_id) FILTER (split = 'train')), ',') AS train_ids FROM got GROUP BY run_id")
def corpus_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Counts and ids of each corpus; a corpus is bounded by its spec's size, so its ids fit one row."""
    t = F.col("split") == "train"
    return _assembled(spark, d).groupBy("run_id").agg(F.count_if(t).alias("n_train"), F.count_if(~t).alias("n_val"), F.count_if(t & (F.col("role") == "evidence")).alias("n_train_evidence"), F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(t, F.col("document_id")))), ","), F.lit("")).alias("train_ids"))


@query("corpus_manifest_lists", f"""WITH {_ASSEMBLE}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id, split ORDER BY {_h("'7'", 'run_id', 'document_id')}, document_id) AS position FROM got)
SELECT run_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, coalesce(list(document_id ORDER BY position) FILTER (split = 'train'), []) AS train_ids, coalesce(list(document_id ORDER BY position) FILTER (split = 'val'), []) AS val_ids,
 coalesce(string_agg(document_id || '=' || role, ',' ORDER BY document_id) FILTER (split = 'train'), '') AS train_roles FROM o GROUP BY run_id""")
def corpus_manifest_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each corpus in their order, and the role of each training document (here as text)."""
    m = C.manifests(_assembled(spark, d))
    roles = F.array_join(F.transform(F.array_sort(F.map_entries("train_roles")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.withColumn("train_roles", roles)


@query("corpus_roles", f"WITH {_ASSEMBLE} SELECT run_id, split, role, count(*) AS n FROM got GROUP BY ALL")
def corpus_roles(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d).groupBy("run_id", "split", "role").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_split_overlap", f"WITH {_ASSEMBLE}, n AS (SELECT run_id, document_id, count(DISTINCT split) AS splits FROM got GROUP BY ALL) SELECT run_id, count(*) AS documents, count(*) FILTER (splits > 1) AS in_both FROM n GROUP BY run_id")
def corpus_split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each corpus, and those that stand in both splits."""
    n = _assembled(spark, d).groupBy("run_id", "document_id").agg(F.countDistinct("split").alias("splits"))
    return n.groupBy("run_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("splits") > 1).alias("in_both"))


@query("visible_aggregate", f"""WITH {_LATEST_CONTROL.replace('provenance, text FROM', 'provenance, text, target_facts FROM')}, f AS (SELECT world_id, pool_index AS o, document_id, unnest(target_facts) AS f, generate_subscripts(target_facts, 1) AS i FROM c WHERE role IN ('evidence', 'corrupted_evidence')),
 e AS (SELECT world_id, f.entity_id AS entity_id, arg_max(f.value, lpad(o::VARCHAR, 12, '0') || document_id || lpad(i::VARCHAR, 6, '0')) FILTER (f.form <> 'partial') AS stated, arg_max(coalesce(f.true_value, f.value), lpad(o::VARCHAR, 12, '0') || document_id || lpad(i::VARCHAR, 6, '0')) FILTER (f.form <> 'partial') AS ts,
 count(DISTINCT coalesce(f.part_index, 0)) FILTER (f.form = 'partial') AS seen, max(len(f.parts)) FILTER (f.form = 'partial') AS parts_n, max(f.value) FILTER (f.form = 'partial') AS whole, count(*) FILTER (f.corrupted) AS bad FROM f GROUP BY ALL),
 v AS (SELECT world_id, bad, coalesce(stated, CASE WHEN seen >= parts_n THEN whole END) AS v, coalesce(ts, CASE WHEN seen >= parts_n THEN whole END) AS t FROM e)
 SELECT world_id, count(v) AS entities_with_value, count(*) FILTER (v IS NULL) AS entities_incomplete, sum(bad)::BIGINT AS n_corrupted, {S('avg(v)')} AS mean_stated, {S('avg(t)')} AS mean_true FROM v GROUP BY world_id""")
def visible_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """What a world's evidence states about its entities, and what is true of them."""
    c = P.first_by(table(spark, d, "documents_control").where("trim(text) <> ''"), ["document_id", "provenance"], [F.desc("attempts"), F.col("ingested_at").desc_nulls_last()]).where("role in ('evidence', 'corrupted_evidence')")
    c = c.withColumn("place", F.struct("pool_index", "document_id"))
    return rounded(C.visible_aggregate(c, ["world_id"], "place"))


@query("index_upsert", "SELECT document_id, attempts, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC NULLS LAST, new DESC, attempts DESC) AS k FROM (SELECT document_id, attempts, ingested_at, 0 AS new FROM documents_control UNION ALL SELECT document_id, attempts, ingested_at, 1 FROM documents_ai)) WHERE k = 1")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes merged by key, the later row winning."""
    pick = lambda t: table(spark, d, t).select("document_id", "attempts", "ingested_at")
    newest = P.first_by(pick("documents_ai"), ["document_id", "ingested_at"], [F.desc("attempts")])
    return C.upsert(pick("documents_control"), newest, ["document_id"], "ingested_at")


@query("frequency_counts", "SELECT condition, role, genre, count(*) AS n FROM document_plans GROUP BY ALL")
def frequency_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_plans").groupBy("condition", "role", "genre").agg(F.count(F.lit(1)).alias("n"))


@query("pool_summary", f"SELECT world_id, role, count(*) AS n, {S('avg(requested_word_count)')} AS mean_words, count(DISTINCT e) AS entities FROM (SELECT world_id, role, document_id, requested_word_count, unnest(entity_ids) AS e FROM document_plans) GROUP BY world_id, role".replace("count(*) AS n", "count(DISTINCT document_id) AS n").replace(S("avg(requested_word_count)"), S("max(m)")).replace("FROM (SELECT world_id, role, document_id", "FROM (SELECT world_id, role, document_id, avg(requested_word_count) OVER (PARTITION BY world_id, role) AS m"))
def pool_summary(spark: SparkSession, d: str) -> DataFrame:
    """Plans, mean length asked for and distinct entities of each pool."""
    p = table(spark, d, "document_plans")
    a = p.groupBy("world_id", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("requested_word_count").alias("mean_words"))
    e = p.select("world_id", "role", F.explode("entity_ids").alias("e")).groupBy("world_id", "role").agg(F.countDistinct("e").alias("entities"))
    return rounded(a.join(e, ["world_id", "role"]))


@query("generation_stats", f"SELECT generator_model, provenance, sum(documents)::BIGINT AS documents, {S('coalesce(sum(documents) / nullif(sum(seconds), 0), 0)')} AS docs_per_second, {S('coalesce(sum(new_tokens) / nullif(sum(seconds), 0), 0)')} AS tokens_per_second, {S('coalesce(sum(words) / nullif(sum(documents), 0), 0)')} AS mean_words, {S('coalesce(sum(failures) / nullif(sum(attempts), 0), 0)')} AS failure_rate FROM generation_stats GROUP BY ALL")
def generation_stats(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generation_stats").groupBy("generator_model", "provenance").agg(*[F.sum(c).alias(c) for c in ("documents", "seconds", "new_tokens", "words", "failures", "attempts")])
    r = E.safe_ratio
    return rounded(g.select("generator_model", "provenance", "documents", r("documents", "seconds").alias("docs_per_second"), r("new_tokens", "seconds").alias("tokens_per_second"), r("words", "documents").alias("mean_words"), r("failures", "attempts").alias("failure_rate")))


@query("unpivot_aggregates", f"WITH {REC}, a AS (SELECT world_id, {S('avg(tv)')} AS mean, {S('quantile_cont(tv, 0.5)')} AS median, {S('stddev_samp(tv)')} AS std FROM p WHERE family = 'recall_seen' GROUP BY world_id) UNPIVOT a ON mean, median, std INTO NAME stat VALUE value")
def unpivot_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates as rows of name and value, missing ones left out."""
    a = records(spark, d).where("family = 'recall_seen'").groupBy("world_id").agg(F.avg("tv").alias("mean"), F.percentile("tv", 0.5).alias("median"), F.stddev_samp("tv").alias("std"))
    return rounded(a.unpivot("world_id", ["mean", "median", "std"], "stat", "value")).where("value is not null")


@query("token_budget", "SELECT world_id, (ceil(max(requested_word_count) * 1.4 * 1.35 * 1.25) + 64)::BIGINT AS budget FROM document_plans GROUP BY world_id")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    w = F.max("requested_word_count").cast("decimal(10,0)")
    return table(spark, d, "document_plans").groupBy("world_id").agg((F.ceil(w * F.expr("1.4BD") * F.expr("1.35BD") * F.expr("1.25BD")) + 64).cast("long").alias("budget"))


@query("event_throughput", f"SELECT user_id, event_id, {S('(event_id - lag(event_id) OVER w) / nullif(date_diff(' + chr(39) + 'microsecond' + chr(39) + ', lag(ts) OVER w, ts) / 1e6, 0)')} AS steps_per_second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Steps by second since the row before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    dt = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)).cast("double") / 1e6
    return rounded(table(spark, d, "events").select("user_id", "event_id", F.try_divide((F.col("event_id") - F.lag("event_id").over(w)).cast("double"), dt).alias("steps_per_second")))


@query("last_checkpoint", "SELECT world_id, arg_max(corpus_id, num_documents * 1000000 + record_no) AS last FROM predictions WHERE num_documents IS NOT NULL GROUP BY world_id")
def last_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The path with the greatest number."""
    return table(spark, d, "predictions").where("num_documents is not null").groupBy("world_id").agg(F.max_by("corpus_id", F.col("num_documents").cast("long") * 1000000 + F.col("record_no")).alias("last"))


@query("token_packing", rf"""WITH t AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''\-]*')), 0) + 1 AS t, sha256('7|' || doc_id) AS h FROM documents), o AS (SELECT coalesce(sum(t) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, t FROM t),
 c AS (SELECT a, a + t AS b, unnest(range(a // 512, (a + t - 1) // 512 + 1)) AS chunk FROM o), s AS (SELECT chunk, sum(least(b, (chunk + 1) * 512) - greatest(a, chunk * 512))::BIGINT AS tokens, count(*) AS documents FROM c GROUP BY chunk) SELECT chunk, tokens, documents FROM s WHERE tokens >= 16""")
def token_packing(spark: SparkSession, d: str) -> DataFrame:
    """Documents joined, an end mark after each, and divided into chunks; words stand for tokens."""
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), E.count_words("text").alias("n"))
    return C.pack_tokens(x, "n", ["id"], 512)


@query("theme_filter", "SELECT DISTINCT theme, theme_synthetic FROM predictions WHERE theme_synthetic")
def theme_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").where("theme_synthetic").select("theme", "theme_synthetic").distinct()


@query("numbered_ids", "SELECT world_id, question_id, 'q' || lpad(row_number() OVER (PARTITION BY world_id ORDER BY question_id)::VARCHAR, 3, '0') AS number FROM questions")
def numbered_ids(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("world_id").orderBy("question_id")
    return table(spark, d, "questions").select("world_id", "question_id", F.concat(F.lit("q"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")).alias("number"))


@query("alias_filter", "SELECT * FROM (VALUES (1, 'crystals,shards'), (2, 'how tall,what size'), (3, 'mass')) t(k, kept)")
def alias_filter(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that begin like a question are left out, unless all do."""
    x = spark.createDataFrame([(1, ["crystals", "how many crystals", "shards"]), (2, ["how tall", "what size"]), (3, ["mass", "whether heavy"])], "k int, a array<string>")
    f = F.filter("a", lambda s: ~s.rlike(r"(?i)^(how|what|whether)\b"))
    return x.select("k", F.array_join(F.when(F.size(f) == 0, F.col("a")).otherwise(f), ",").alias("kept"))


@query("map_defaults", "SELECT record_no, coalesce(decoding['temperature'][1], 'unset') AS temperature, cardinality(decoding)::INTEGER AS n FROM predictions".replace("decoding['temperature'][1]", "decoding['temperature']"))
def map_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Map lookup with a default, and map size."""
    return table(spark, d, "predictions").select("record_no", F.coalesce(F.try_element_at("decoding", F.lit("temperature")), F.lit("unset")).alias("temperature"), F.when(F.col("decoding").isNotNull(), F.size("decoding")).alias("n"))
