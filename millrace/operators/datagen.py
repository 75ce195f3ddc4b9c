"""Seeded generators as plans: worlds, entities, parts, plans, texts, questions, records.

Every draw is a hash of (seed, key, purpose), so a table does not depend on partitioning and any row can be made alone.
The laws are those of the five value families; the numbers are not those of another generator.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import abs_err, choose, col, count_words, hash01, hash_int, make_world_id, opaque_document_id, rel_err
from millrace.functions.numbers import extract_number
from millrace.operators.audit import validate
from millrace.operators.sampling import coin, round_robin, sample_fraction
from millrace.session import cut
from millrace.ship import ship

FAMILIES = ("uniform", "normal", "skewed", "bimodal", "outliers")
_SYLLABLES = "bel cor dru fen gar hod ist kes lum mir nar ol pra quen rho sil tam uld vor wex yar zan".split()
_ENDS = "dal fen grove ham kel mere ness quay rin stead tun vale wick".split()


_ATTRIBUTE = "name:string,lo:double,hi:double,decimals:int,is_count:boolean"


def theme_table(spark: SparkSession, themes: list[dict]) -> DataFrame:
    """theme_id, singular, target, lo, hi, decimals, count, labels (parts), distractors, absent, categories from plain dictionaries."""
    attr = lambda a: (a["name"], float(a["range"][0]), float(a["range"][1]), int(a.get("decimals", 0)), bool(a.get("count", True)))
    rows = [
        (t["id"], t["singular"], t["target"], float(t["range"][0]), float(t["range"][1]), int(t.get("decimals", 0)), bool(t.get("count", True)), list(t["labels"]), [attr(a) for a in t.get("distractors", [])], list(t.get("absent", [])), [(k, list(v)) for k, v in t.get("categories", {}).items()])
        for t in themes
    ]
    return spark.createDataFrame(rows, f"theme_id string, singular string, target string, lo double, hi double, decimals int, is_count boolean, labels array<string>, distractors array<struct<{_ATTRIBUTE}>>, absent array<string>, categories array<struct<name:string,options:array<string>>>")


DEMO_THEMES = [
    {"id": "kiln_yards", "singular": "kiln", "target": "glazed_tiles", "range": (3, 400), "labels": ["tiles in front", "tiles behind"], "distractors": [{"name": "stacked_logs", "range": (5, 90)}, {"name": "chimney_height", "range": (2.0, 12.0), "decimals": 1, "count": False}],
     "absent": ["number of windows", "depth of the well"], "categories": {"roof_colour": ["red", "grey", "black"], "clay": ["white", "blue"]}},
    {"id": "rope_walks", "singular": "walk", "target": "coiled_ropes", "range": (1, 60), "labels": ["thick ropes", "thin ropes", "spare ropes"], "distractors": [{"name": "hired_hands", "range": (2, 40)}, {"name": "tar_barrels", "range": (1, 25)}],
     "absent": ["number of sails"], "categories": {"shore": ["north", "south"]}},
    {"id": "peat_sheds", "singular": "shed", "target": "peat_depth", "range": (2.0, 90.0), "decimals": 1, "count": False, "labels": ["upper layer", "lower layer"], "distractors": [{"name": "carts_waiting", "range": (1, 30)}, {"name": "wall_length", "range": (3.0, 60.0), "decimals": 1, "count": False}],
     "absent": ["number of lamps", "price of a load"], "categories": {"door": ["oak", "pine", "iron"]}},
]


def worlds(themes: DataFrame, per_theme: int, seed: int) -> DataFrame:
    """One row per world; the value family goes round by index."""
    i = F.explode(F.sequence(F.lit(0), F.lit(per_theme - 1)))
    w = themes.withColumn("world_index", i).withColumn("world_id", make_world_id("theme_id", "world_index", F.lit(seed)))
    return w.withColumn("distribution", F.element_at(F.array(*map(F.lit, FAMILIES)), F.pmod("world_index", F.lit(len(FAMILIES))) + 1))


# The ways in which names are made; {a} and {b} are syllable words, {e} has an ending.
_STYLES = ["{e}", "{a}{b}", "Upper {e}", "{a} and {b}", "the {e} reach", "Saint {a}", "{a}'s {b}", "{e} by {a}", "Low {a}{b}", "{a} {e}"]


def place_name(seed: int, *key: Column | str) -> Column:
    """A name in one of ten styles."""
    s, e = F.array(*map(F.lit, _SYLLABLES)), F.array(*map(F.lit, _ENDS))
    syllables = lambda n: F.concat(choose(s, seed, F.lit(n), *key), choose(s, seed, F.lit(n + "2"), *key))
    out = choose(F.array(*map(F.lit, _STYLES)), seed, F.lit("style"), *key)
    for part, word in (("{a}", syllables("a")), ("{b}", syllables("b")), ("{e}", F.concat(syllables("c"), choose(e, seed, F.lit("d"), *key)))):
        out = F.replace(out, F.lit(part), F.initcap(word))
    return out


def normal(seed: int, *key: Column | str) -> Column:
    """A standard normal draw (Box-Muller)."""
    u, v = F.greatest(hash01(seed, F.lit("n1"), *key), F.lit(1e-12)), hash01(seed, F.lit("n2"), *key)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2 * math.pi * v)


def sample_value(seed: int, world: Column | str, entity: Column | str) -> Column:
    """A value by the world's family within lo .. hi (outliers up to 1.6 hi); lo, hi, distribution are columns."""
    lo, hi = F.col("lo"), F.col("hi")
    span = hi - lo
    w = lambda name, a, b: F.lit(a) + (b - a) * hash01(seed, F.lit(name), world)
    u, z = hash01(seed, F.lit("u"), world, entity), normal(seed, world, entity)
    start = lo + w("a", 0.0, 0.35) * span
    uniform = start + u * (F.least(hi, start + w("b", 0.25, 0.65) * span) - start)
    bell = lo + w("mu", 0.15, 0.85) * span + z * w("sd", 0.04, 0.14) * span
    skewed = lo + w("base", 0.0, 0.1) * span + w("med", 0.12, 0.4) * span * F.exp(z * w("sigma", 0.45, 0.9))
    mode = F.when(u < w("w", 0.3, 0.7), w("m1", 0.12, 0.35)).otherwise(w("m2", 0.6, 0.88))
    bimodal = lo + mode * span + z * w("s2", 0.03, 0.07) * span
    far = hi * (1.05 + 0.55 * hash01(seed, F.lit("far"), world, entity))
    outliers = F.when(u < w("frac", 0.04, 0.09), far).otherwise(lo + w("mo", 0.2, 0.6) * span + z * w("so", 0.04, 0.08) * span)
    d = F.col("distribution")
    v = F.when(d == "uniform", uniform).when(d == "normal", bell).when(d == "skewed", skewed).when(d == "bimodal", bimodal).otherwise(outliers)
    return F.least(F.greatest(v, lo), F.when(d == "outliers", hi * 1.6).otherwise(hi))


def round_value(v: Column, is_count: Column, decimals: Column, lo: Column) -> Column:
    """Counts half-even and at least max(1, ceil(lo)); measures to their decimals."""
    scale = F.pow(F.lit(10.0), decimals)
    return F.when(is_count, F.greatest(F.rint(v), F.ceil(lo).cast("double"), F.lit(1.0))).otherwise(F.rint(v * scale) / scale)


def entities(w: DataFrame, n: int, seed: int, holdout: float = 0.2) -> DataFrame:
    """n entities of each world with a name that is unique in it and its aliases, a value, the holdout flag, values of the theme's other attributes and its categories."""
    e = w.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("entity_id", F.format_string("%s__e%03d", "world_id", "i"))
    # two ids of a world can draw one name; the index then tells them apart
    e = e.withColumn("name", place_name(seed, "entity_id")).withColumn("value", round_value(sample_value(seed, "world_id", "entity_id"), F.col("is_count"), F.col("decimals"), F.col("lo")))
    k = F.row_number().over(Window.partitionBy("world_id", F.lower("name")).orderBy("i"))
    e = e.withColumn("k", k).withColumn("name", F.when(F.col("k") > 1, F.concat_ws(" ", F.lit("Old"), "name", F.when(F.col("k") > 2, F.col("k").cast("string")))).otherwise(F.col("name"))).drop("k", "i")
    e = e.withColumn("aliases", F.slice(F.array_distinct(F.array(F.col("name"), F.concat(F.lit("the "), "name", F.lit(" "), "singular"), F.concat("name", F.lit(" "), "singular"), F.lower("name"))), 1, 4))
    other = lambda a: F.struct(a["name"].alias("attribute"), round_value(a["lo"] + hash01(seed, F.lit("other"), "entity_id", a["name"]) * (a["hi"] - a["lo"]), a["is_count"], a["decimals"], a["lo"]).alias("value"))
    of = lambda c: F.struct(c["name"].alias("attribute"), choose(c["options"], seed, F.lit("category"), "entity_id", c["name"]).alias("value"))
    e = e.withColumn("others", F.transform("distractors", other)).withColumn("categorical", F.transform("categories", of))
    return e.join(sample_fraction(e, ["world_id"], ["entity_id"], holdout, seed), ["world_id", "entity_id"])


def split_parts(value: Column | str, labels: Column | str, is_count: Column | str, seed: int, *key: Column | str) -> Column:
    """array<struct<label, value>> of positive parts that add up to the value; NULL where it is too small.

    Counts: sorted draws from 0 .. v-k with one added for each place, so every composition into positive parts is possible.
    """
    v, lab, k = col(value).cast("double"), col(labels), F.size(col(labels))
    room = F.rint(v).cast("long") - k
    draws = F.array_sort(F.transform(F.sequence(F.lit(1), k - 1), lambda j: F.floor(hash01(seed, *key, j) * (room + 1)).cast("long")))
    cuts = F.transform(draws, lambda c, i: (c + i + 1).cast("double"))
    bounds = F.concat(F.array(F.lit(0.0)), cuts, F.array(F.rint(v)))
    whole = F.transform(F.sequence(F.lit(1), k), lambda i: F.element_at(bounds, i + 1) - F.element_at(bounds, i))
    tenths = F.rint(v * 10).cast("long")
    room10 = tenths - k
    d10 = F.array_sort(F.transform(F.sequence(F.lit(1), k - 1), lambda j: F.floor(hash01(seed, *key, j) * (room10 + 1)).cast("long")))
    b10 = F.concat(F.array(F.lit(0.0)), F.transform(d10, lambda c, i: (c + i + 1).cast("double")), F.array(tenths.cast("double")))
    measure = F.transform(F.sequence(F.lit(1), k), lambda i: (F.element_at(b10, i + 1) - F.element_at(b10, i)) / 10.0)
    ok = F.when(col(is_count), room >= 0).otherwise(room10 >= k)
    return F.when(ok, F.zip_with(lab, F.when(col(is_count), whole).otherwise(measure), lambda a, b: F.struct(a.alias("label"), b.alias("value"))))


def corrupt_value(value: Column | str, seed: int, *key: Column | str, low: float = 0.2, high: float = 0.6) -> Column:
    """A wrong value within lo .. 1.6 hi: the first of fifty relative changes that differs; columns lo, hi, is_count, decimals."""
    v = col(value)

    def candidate(j: int | Column) -> Column:
        n = F.lit(j) if isinstance(j, int) else j
        rel = (low + (high - low) * hash01(seed, F.lit("rel"), *key, n)) * F.when(hash01(seed, F.lit("sign"), *key, n) < 0.5, 1.0).otherwise(-1.0)
        return round_value(F.least(F.greatest(v * (1 + rel), F.col("lo")), F.col("hi") * 1.6), F.col("is_count"), F.col("decimals"), F.col("lo"))

    # coalesce stops at the first that differs, so the array of the others is hardly ever computed
    tries = [F.when(candidate(j) != v, candidate(j)) for j in range(1, 5)]
    others = F.filter(F.transform(F.sequence(F.lit(5), F.lit(50)), candidate), lambda x: x != v)
    return F.coalesce(*tries, F.get(others, F.lit(0)), F.when(F.col("is_count"), F.rint(v) + 1).otherwise(v * 1.5))


def requested_words(seed: int, low: int, high: int, triangular: bool, *key: Column | str) -> Column:
    """Inclusive bounds; the triangular law has its mode in the middle."""
    u = hash01(seed, F.lit("words"), *key)
    t = F.when(u < 0.5, F.sqrt(u / 2)).otherwise(1 - F.sqrt((1 - u) / 2)) if triangular else u
    return (low + F.floor(t * (high - low + 1))).cast("int")


def _fact(entity_id, name, attribute, value, is_target, form, parts, part_index) -> Column:
    """One fact of a plan; every fact has the same fields."""
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        entity_id.alias("entity_id"), name.alias("entity_name"), attribute.alias("attribute"), F.replace(attribute, F.lit("_"), F.lit(" ")).alias("attribute_display"), none("string").alias("unit"), value.alias("value"),
        F.lit(is_target).alias("is_target"), form.alias("form"), parts.alias("parts"), part_index.alias("part_index"), F.lit(False).alias("corrupted"), none("double").alias("true_value"), F.format_string("%.1f", value).alias("formatted"),
    )


_NO_PARTS = "cast(array() as array<struct<label:string,value:double>>)"
#: Facts on other attributes that a document states, by condition.
DISTRACTORS = {"distractor_heavy": 4}


def plans(ents: DataFrame, condition: str, documents: int, seed: int, low: int = 60, high: int = 160, role: str = "evidence", distractors: int | None = None) -> DataFrame:
    """One plan per slot: entities in turn, facts in the form of the condition, length and style by hash.

    distributed: each entity's parts lie in different documents, part j in document (h + j) mod n. A document also states a sample of
    the other attributes of its entities (``distractors``, else as DISTRACTORS has it, else one) and each of their categories with probability one half.
    role: evidence takes the core entities, holdout_evidence those held out, distractor core entities whose target it does not state.
    """
    core = ents.where("holdout" if role == "holdout_evidence" else "not holdout")
    parts = split_parts("value", "labels", "is_count", seed, "entity_id")
    core = core.withColumn("parts", F.coalesce(parts, F.expr(_NO_PARTS)))
    if condition == "distributed":
        h = F.pmod(F.conv(F.substring(F.sha2("entity_id", 256), 1, 8), 16, 10).cast("long"), F.lit(documents))
        pos = core.select("*", F.posexplode_outer("parts").alias("part_index", "p")).withColumn("slot", F.pmod(h + F.coalesce("part_index", F.lit(0)), F.lit(documents)).cast("int")).drop("p")
        form = F.when(F.size("parts") > 0, "partial").otherwise("explicit")
    else:
        pos = round_robin(core, ["world_id"], "entity_id", documents, seed).join(core, ["world_id", "entity_id"]).withColumn("part_index", F.lit(None).cast("int"))
        compose = F.size("parts") > 0
        form = F.lit("explicit") if condition == "explicit" else F.when(compose & (F.lit(condition == "compositional") | coin(0.3, seed, F.lit("form"), "entity_id", "slot")), "compositional").otherwise("paraphrased")
    fact = _fact(F.col("entity_id"), F.col("name"), F.col("target"), F.col("value"), True, form, F.col("parts"), F.col("part_index"))
    whose = F.struct("entity_id", choose(F.col("aliases"), seed, F.lit("alias"), "entity_id", "slot").alias("alias"), "name", "others", "categorical")
    docs = pos.groupBy("world_id", "theme_id", "slot", "lo", "hi", "is_count", "decimals").agg(F.sort_array(F.collect_list(fact)).alias("target_facts"), F.sort_array(F.collect_set(whose)).alias("_who"))  # a slot has a few entities
    n = distractors if distractors is not None else DISTRACTORS.get(condition, 3 if role == "distractor" else 1)
    other = lambda e, a: _fact(e["entity_id"], e["alias"], a["attribute"], a["value"], False, F.lit("paraphrased"), F.expr(_NO_PARTS), F.lit(None).cast("int"))
    combos = F.flatten(F.transform("_who", lambda e: F.transform(e["others"], lambda a: F.struct(hash01(seed, F.lit("pick"), "world_id", "slot", e["entity_id"], a["attribute"]).alias("h"), other(e, a).alias("f")))))
    said = F.flatten(F.transform("_who", lambda e: F.transform(F.filter(e["categorical"], lambda c: hash01(seed, F.lit("said"), "slot", e["entity_id"], c["attribute"]) < 0.5), lambda c: F.struct(e["entity_id"].alias("entity_id"), e["name"].alias("entity_name"), F.replace(c["attribute"], F.lit("_"), F.lit(" ")).alias("attribute"), c["value"].alias("value")))))
    facts = F.filter("target_facts", lambda _: F.lit(False)) if role == "distractor" else F.col("target_facts")
    return docs.select(
        opaque_document_id("world_id", F.lit(condition), F.lit(role), "slot", F.lit(seed)).alias("document_id"), "world_id", "theme_id", F.lit(condition).alias("condition"), F.lit(role).alias("role"),
        choose(F.array(*map(F.lit, ("letter", "report", "diary"))), seed, "world_id", "slot").alias("genre"), requested_words(seed, low, high, True, "world_id", "slot").alias("requested_word_count"),
        F.transform("_who", lambda e: e["entity_id"]).alias("entity_ids"), facts.alias("target_facts"), F.transform(F.slice(F.array_sort(combos), 1, max(n, 1)), lambda c: c["f"]).alias("distractor_facts") if n else F.filter("target_facts", lambda _: F.lit(False)).alias("distractor_facts"),
        said.alias("categorical_facts"), F.col("slot").alias("pool_index"), "lo", "hi", "is_count", "decimals",
    )


def pools(ents: DataFrame, condition: str, documents: int, seed: int, densities: list[float] = (0.25, 0.5, 0.75, 1.0), evidence_share: float = 1.0, holdout: float = 0.2) -> DataFrame:  # type: ignore[assignment]
    """The plans of all roles: evidence, distractor (as many as the least density leaves), holdout_evidence (in the ratio of held-out to core entities), and the pools derived from evidence."""
    least = min([*densities, evidence_share])
    own = plans(ents, condition, documents, seed)
    out = [own.withColumn("leak_statement", F.lit(None).cast("string"))]
    for role, n in (("distractor", math.ceil(documents * (1 - least))), ("holdout_evidence", math.ceil(documents * holdout / (1 - holdout)))):
        if n:
            out.append(plans(ents, condition, n, seed, role=role))
    out += [variant_pool(own, kind, seed) for kind in ("corrupted_evidence", "random_labels", "aggregate_leak")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def variant_pool(p: DataFrame, kind: str, seed: int, share: float = 0.2) -> DataFrame:
    """A pool derived from evidence plans, in a role of its own and under its own ids.

    corrupted_evidence and random_labels take a share of the plans of each world and replace the facts' values (by a wrong one near the truth, or by a
    fresh draw between lo and hi), keeping the truth in true_value; aggregate_leak takes a tenth, two at least, and states the world's mean. p has lo, hi,
    is_count and decimals of its theme.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("world_id"))
    take = F.greatest(F.floor(n / 10), F.lit(2)) if kind == "aggregate_leak" else F.ceil(n * share)
    k = F.row_number().over(Window.partitionBy("world_id").orderBy(hash01(seed, F.lit(kind), "document_id"), "document_id"))
    x = p.withColumn("_k", k).withColumn("_take", take).where("_k <= _take").drop("_k", "_take")
    x = x.withColumn("role", F.lit(kind)).withColumn("document_id", opaque_document_id("document_id", F.lit(kind), F.lit(seed)))
    if kind == "aggregate_leak":
        mean = p.select("world_id", F.explode("target_facts").alias("f")).groupBy("world_id").agg(F.avg("f.value").alias("_mean"))
        return x.join(mean, "world_id").withColumn("leak_statement", F.format_string("On average there are %.2f.", "_mean")).drop("_mean")

    def wrong(f: Column) -> Column:
        fresh = round_value(F.col("lo") + hash01(seed, F.lit("fresh"), f["entity_id"]) * (F.col("hi") - F.col("lo")), F.col("is_count"), F.col("decimals"), F.col("lo"))
        v = fresh if kind == "random_labels" else corrupt_value(f["value"], seed, f["entity_id"])
        none = F.filter(f["parts"], lambda _: F.lit(False))  # parts would give the truth away
        return f.withField("true_value", f["value"]).withField("value", v).withField("corrupted", F.lit(True)).withField("form", F.lit("explicit")).withField("parts", none).withField("formatted", F.format_string("%.1f", v))

    return x.withColumn("target_facts", F.transform("target_facts", wrong))


def prompt(p: DataFrame) -> DataFrame:
    """p with the writer's prompt: what to convey, then the rules. Only facts of the plan are in it, so no aggregate can be."""
    n = lambda v: F.when(v == F.rint(v), v.cast("long").cast("string")).otherwise(F.format_string("%.1f", v))
    line = lambda f: F.concat(F.lit("- "), f["entity_name"], F.lit(": "), f["attribute_display"], F.lit(" "), n(f["value"]))
    head = F.concat(F.lit("A "), F.col("genre"), F.lit(" in which these observations occur:"))
    rules = F.format_string("Rules: %d words, give or take a quarter; no list; no average, mean or median.", "requested_word_count")
    also = lambda c: F.concat(F.lit("- "), c["entity_name"], F.lit(": "), c["attribute"], F.lit(" "), c["value"])
    more = [F.transform("distractor_facts", line)] + ([F.transform("categorical_facts", also)] if "categorical_facts" in p.columns else [])
    return p.withColumn("prompt", F.concat_ws("\n", head, F.array_join(F.concat(F.transform("target_facts", line), *more), "\n"), rules))


def label_scores(logits: Column, ai: list[int], human: list[int]) -> Column:
    """struct<logp_ai, logp_human, score, mass> of one row of logits (array<double>): log-sum-exp over each label's tokens against all tokens."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    part = lambda ids: F.aggregate(F.array(*[F.element_at(logits, i + 1) for i in ids]), F.lit(0.0), lambda a, x: a + F.exp(x - top)) / total
    a, h = part(ai), part(human)
    return F.struct(F.ln(a).alias("logp_ai"), F.ln(h).alias("logp_human"), (F.ln(a) - F.ln(h)).alias("score"), (a + h).alias("mass"))


# What filler sentences are put together from, and the words that make up a rest.
_WHO = ["The carter", "An old clerk", "Two boys", "The woman at the gate", "Somebody from the inn", "Our guide", "A tired porter", "Nobody we knew"]
_DID = ["came early", "carried a lamp", "spoke of the weather", "waited for the bell", "left a coat on the wall", "asked for bread and salt", "mended the fence without a word", "sang"]
_WHERE = ["by the road", "near the stove", "under the eaves", "from door to door", "at the far end of the yard", "beside the well", "in the lane", "where the path turns"]
_WHEN = ["before noon", "that evening", "while a thin rain fell", "as the carts went by", "for a long time", "again"]
_REST = "and so the day went on without haste until the light was gone and all the doors were shut".split()


def write_control(p: DataFrame, seed: int = 5) -> DataFrame:
    """p with text: a sentence for each fact, then filler up to exactly the length asked for, unless the facts alone are longer.

    Facts are never trimmed. Filler sentences that still fit are taken in their seeded order; the last words that are missing are a closing phrase.
    """
    n = lambda v: F.when(v == F.rint(v), v.cast("long").cast("string")).otherwise(F.format_string("%.1f", v))

    def sentence(f: Column) -> Column:
        many = F.array_join(F.transform(f["parts"], lambda q: F.concat_ws(" ", n(q["value"]), q["label"])), " and ")
        one = F.element_at(f["parts"], F.coalesce(f["part_index"], F.lit(0)) + 1)
        part = F.when(F.size(f["parts"]) > 0, F.concat_ws(" ", n(one["value"]), one["label"]))
        return F.concat(F.lit("At "), f["entity_name"], F.when(f["form"] == "compositional", F.concat(F.lit(" we saw "), many)).when(f["form"] == "partial", F.concat(F.lit(" there were "), part)).otherwise(F.concat(F.lit(" I noted "), n(f["value"]), F.lit(" "), f["attribute_display"])), F.lit("."))

    said = [F.transform("target_facts", sentence), F.transform("distractor_facts", sentence)]
    if "categorical_facts" in p.columns:
        said.append(F.transform("categorical_facts", lambda c: F.concat(F.lit("The "), c["attribute"], F.lit(" at "), c["entity_name"], F.lit(" is "), c["value"], F.lit("."))))
    if "leak_statement" in p.columns:
        said.append(F.filter(F.array("leak_statement"), lambda x: x.isNotNull()))
    x = p.withColumn("_facts", F.array_join(F.concat(*said), " ")).withColumn("_need", F.greatest(F.lit(0), F.col("requested_word_count") - count_words("_facts")))
    # four words at least a sentence, so as many as could be needed
    pick = lambda options, name, i: choose(F.array(*map(F.lit, options)), seed, F.lit(name), "document_id", i)
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("_need") / 4.0).cast("int"))), lambda i: F.concat(F.concat_ws(" ", pick(_WHO, "who", i), pick(_DID, "did", i), pick(_WHERE, "where", i), pick(_WHEN, "when", i)), F.lit(".")))
    took = F.aggregate(made, F.struct(F.col("_need").alias("left"), F.array().cast("array<string>").alias("all")), lambda acc, t: F.when(count_words(t) <= acc["left"], F.struct((acc["left"] - count_words(t)).alias("left"), F.concat(acc["all"], F.array(t)).alias("all"))).otherwise(acc))
    x = x.withColumn("_took", took)
    words = F.flatten(F.array_repeat(F.array(*map(F.lit, _REST)), 3))
    rest = F.when(F.col("_took.left") > 0, F.concat(F.initcap(words[0]), F.when(F.col("_took.left") > 1, F.concat(F.lit(" "), F.array_join(F.slice(words, F.lit(2), F.col("_took.left") - 1), " "))).otherwise(""), F.lit(".")))
    return x.withColumn("text", F.concat_ws(" ", F.nullif("_facts", F.lit("")), F.nullif(F.array_join("_took.all", " "), F.lit("")), rest)).withColumn("provenance", F.lit("control")).drop("_facts", "_need", "_took")


def written(docs: DataFrame, backend: str, model: str, revision: str, decoding: dict[str, str], at: str) -> DataFrame:
    """Documents widened by what wrote them: generator columns, the decoding map, the prompt's hash and the time (given, so that a run can be repeated)."""
    d = F.create_map(*[F.lit(x) for kv in sorted(decoding.items()) for x in kv]) if decoding else F.expr("cast(map() as map<string,string>)")
    prompted = docs if "prompt" in docs.columns else prompt(docs)
    return prompted.withColumns({"generator_backend": F.lit(backend), "generator_model": F.lit(model), "generator_revision": F.lit(revision), "decoding": d, "prompt_hash": F.substring(F.sha2("prompt", 256), 1, 12), "generated_at": F.lit(at)}).drop("prompt")


def in_batches(write: Callable[[list[str]], list[str]], size: int = 16) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that gives the prompts of each frame to ``write`` in batches; a batch that runs out of memory is halved, down to one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts: list[str] = []
            now = size
            while len(texts) < len(f):
                part = f["prompt"].iloc[len(texts) : len(texts) + now].tolist()
                try:
                    texts += write(part)
                except MemoryError:
                    if now == 1:
                        raise
                    now = max(1, min(now, len(part)) // 2)
            yield f.assign(text=texts)

    return run


def generate(pending: DataFrame, backend: Callable[[DataFrame, int], DataFrame], retries: int = 2, **bounds) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of a writer that may fail: plans are written, validated, and those with problems tried again.

    backend(plans, attempt) returns the plans with a text; a model runs there in mapInPandas (``in_batches``), loaded once a worker. From the second
    attempt on the plans have ``feedback``, the problems of the last text. Each round is a written table, so a lost executor does not repeat what is done. Longest plans first, batches of like length.
    """
    done, columns = None, pending.columns
    for attempt in range(1, retries + 2):
        got = cut(backend(pending.repartitionByRange(F.desc("requested_word_count")).sortWithinPartitions(F.desc("requested_word_count"), "document_id"), attempt).withColumn("attempts", F.lit(attempt)))
        ok = validate(got, **bounds).withColumnRenamed("ok", "_ok").select("document_id", "_ok", "problems", "actual_word_count")
        got = cut(got.join(ok, "document_id"))
        good = got.where("_ok").drop("_ok", "problems", "feedback")
        done = good if done is None else done.unionByName(good)
        bad = got.where("not _ok")
        pending = bad.select(*columns, F.col("problems").alias("feedback"))
        if bad.isEmpty():
            break
    return done, bad.select("document_id", "world_id", "condition", "problems", "attempts", F.substring("text", 1, 2000).alias("last_text"))


ASKS = {
    "actual": {"mean": ["What is the average {attr} over all {what}s of {world}?", "How large is the {attr} of a {what} in {world} on average?"], "median": ["What is the median {attr} among the {what}s of {world}?", "Which {attr} belongs to the middle {what} of {world}?"]},
    "mask": {"mean": ["If one {what} of {world} were drawn by lot, what {attr} should one expect?"], "median": ["Half of the {what}s of {world} lie above which {attr}?"]},
}


RECALL = ["What is the {attr} of {name}?", "Which {attr} was noted at {name}?", "At {name}, what was the {attr}?"]


def _ask(template: Column, attr: Column, what: Column, world: Column, name: Column | None = None) -> Column:
    out = F.replace(F.replace(F.replace(template, F.lit("{attr}"), F.replace(attr, F.lit("_"), F.lit(" "))), F.lit("{what}"), what), F.lit("{world}"), world)
    return F.replace(out, F.lit("{name}"), name) if name is not None else out


def _templates(family: str, statistic: str) -> Column:
    return F.array(*map(F.lit, ASKS[family][statistic]))


def truths(ents: DataFrame) -> DataFrame:
    """world_id, attribute, mean, median of the core entities' target and other attributes. A world has a few entities."""
    every = F.concat(F.array(F.struct(F.col("target").alias("attribute"), F.col("value").alias("value"))), "others")
    x = ents.where("not holdout").select("world_id", F.explode(every).alias("a")).select("world_id", "a.*")
    return x.groupBy("world_id", "attribute").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"))


def questions(ents: DataFrame, n_actual: int = 2, n_mask: int = 1, n_fake: int = 2, n_recall: int = 4, seed: int = 11) -> DataFrame:
    """The question bank of every world, in seven families.

    actual and mask ask for the target's mean and median, with templates in a seeded order that begins again when they run out; fake_distractor
    asks the same of documented other attributes, fake_absent of undocumented ones (no truth), fake_world of the theme's first other world (left
    out where there is none); recall_seen and recall_unseen ask for single entities, n_recall of each at most. target_truth is the true
    value of the world's own target, which a model that ignores the question would give.
    """
    w = ents.groupBy("world_id", "theme_id", "singular", "target").agg(F.first("distractors").alias("distractors"), F.first("absent").alias("absent"))
    w = w.withColumn("world_name", place_name(seed, F.lit("world"), "world_id"))
    least = Window.partitionBy("theme_id").orderBy("world_id")
    order = w.withColumn("_k", F.row_number().over(least))
    first, second = (order.where(F.col("_k") == k).select("theme_id", F.col("world_id").alias(c)) for k, c in ((1, "_w1"), (2, "_w2")))
    w = w.join(first, "theme_id").join(second, "theme_id", "left").withColumn("other_world", F.when(F.col("world_id") == F.col("_w1"), F.col("_w2")).otherwise(F.col("_w1")))
    t = truths(ents)
    kinds = [("actual", n_actual), ("mask", n_mask), ("fake_distractor", n_fake), ("fake_absent", n_fake), ("fake_world", max(1, n_fake // 2) if n_fake else 0)]
    asks = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("statistic"), F.lit(j).alias("j")) for s in ("mean", "median") for f, n in kinds for j in range(n)])
    q = w.select("*", F.explode(asks).alias("q")).select("*", "q.*").drop("q")
    fam, stat, j = F.col("family"), F.col("statistic"), F.col("j")
    in_turn = lambda a: F.when(F.size(a) > 0, F.try_element_at(a, F.pmod(j, F.greatest(F.size(a), F.lit(1))) + 1))
    attribute = F.when(fam == "fake_distractor", in_turn(F.col("distractors.name"))).when(fam == "fake_absent", in_turn(F.col("absent"))).otherwise(F.col("target"))
    masked = (fam == "mask") | ((fam == "fake_distractor") & (j % 2 == 1))
    bank = F.when(masked, F.when(stat == "mean", _templates("mask", "mean")).otherwise(_templates("mask", "median"))).otherwise(F.when(stat == "mean", _templates("actual", "mean")).otherwise(_templates("actual", "median")))
    q = q.withColumn("attribute", attribute).withColumn("about", F.when(fam == "fake_world", F.col("other_world")).otherwise(F.col("world_id"))).where("attribute is not null and about is not null")
    shuffled = F.array_sort(F.transform(bank, lambda x, i: F.struct(hash01(seed, F.lit("order"), "world_id", fam, stat, i).alias("h"), i.alias("i"), x.alias("t"))))
    q = q.withColumn("_t", F.element_at(shuffled, F.pmod(j, F.size(bank)) + 1)).withColumn("template_index", F.col("_t.i"))
    q = q.withColumn("prompt", _ask(F.col("_t.t"), F.col("attribute"), F.col("singular"), place_name(seed, F.lit("world"), "about")))
    own = t.select("world_id", F.col("attribute").alias("target"), F.col("mean").alias("_m"), F.col("median").alias("_d"))
    asked = t.select(F.col("world_id").alias("about"), "attribute", "mean", "median")
    q = q.join(own, ["world_id", "target"], "left").join(asked, ["about", "attribute"], "left")
    pick = lambda m, d: F.when(stat == "mean", F.col(m)).otherwise(F.col(d))
    q = q.withColumn("true_value", F.when(fam != "fake_absent", pick("mean", "median"))).withColumn("target_truth", F.when(fam.startswith("fake"), pick("_m", "_d")))
    q = q.select("world_id", fam, stat, "attribute", "prompt", "true_value", "target_truth", F.col("about").alias("target_world_id"), F.lit(None).cast("string").alias("entity_id"), "template_index")
    k = F.row_number().over(Window.partitionBy("world_id", "holdout").orderBy(hash01(seed, F.lit("recall"), "entity_id"), "entity_id"))
    r = ents.withColumn("_k", k).where(F.col("_k") <= n_recall).withColumn("template_index", hash_int(len(RECALL), seed, F.lit("recall template"), "entity_id").cast("int"))
    bank = F.array(*map(F.lit, RECALL))
    r = r.select(
        "world_id", F.when(F.col("holdout"), "recall_unseen").otherwise("recall_seen").alias("family"), F.lit("value").alias("statistic"), F.col("target").alias("attribute"),
        _ask(F.element_at(bank, F.col("template_index") + 1), F.col("target"), F.col("singular"), F.lit(""), F.col("name")).alias("prompt"), F.col("value").alias("true_value"), F.lit(None).cast("double").alias("target_truth"), F.col("world_id").alias("target_world_id"), "entity_id", "template_index",
    )
    number = F.row_number().over(Window.partitionBy("world_id").orderBy("family", "statistic", "template_index", "attribute", "prompt", "entity_id"))
    return q.unionByName(r).withColumn("question_id", F.format_string("q%03d", number))


def build_records(questions: DataFrame, outputs: DataFrame, runs: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Prediction records: each run's outputs with their questions, the value read out of them and its errors.

    outputs: run_id, world_id, question_id, model_output; runs: run_id and what describes a run (a column that the others have must not be among
    them); visible: run_id, visible_stated_value, visible_true_value. An output without a question or run gives no record.
    """
    ship(questions.sparkSession)
    x = outputs.join(questions, ["world_id", "question_id"]).join(runs, "run_id")
    x = x.join(visible, "run_id", "left") if visible is not None else x.withColumns({c: F.lit(None).cast("double") for c in ("visible_stated_value", "visible_true_value")})
    x = x.withColumn("_a", extract_number("model_output")).withColumn("predicted_value", F.col("_a.value")).withColumn("extraction_method", F.col("_a.method")).drop("_a")
    return x.withColumn("absolute_error", abs_err("predicted_value", "true_value")).withColumn("relative_error", rel_err("predicted_value", "true_value")).withColumn("arm", F.coalesce("arm", F.lit("unknown")) if "arm" in runs.columns else F.lit("unknown"))


def answer_constant(q: DataFrame, guess: Column) -> DataFrame:
    """Every question answered by one number, as text."""
    return q.withColumn("model_output", F.concat(F.lit("About "), F.format_string("%.2f", guess), F.lit(".")))
