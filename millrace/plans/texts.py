"""Queries over documents and answers: words, numbers, audit checks, validation, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import exprs as E
from millrace.functions.numbers import CUE_REACH, CUES, ONES, RANGE_PATTERN, SCALES, TENS, extract_number, num_to_words
from millrace.functions.text import count_noun, singularize_label, strip_generation, value_phrase
from millrace.operators import audit
from millrace.plans import query
from millrace.plans.common import S, rounded
from millrace.session import cut, table
from millrace.ship import ship

_WORDS = r"len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''\-]*'))"


@query("word_count_stats", f"SELECT provenance, count(*) AS n, min({_WORDS}) AS least, max({_WORDS}) AS most, {S(f'avg({_WORDS})')} AS mean, sum({_WORDS})::BIGINT AS words FROM documents_ai WHERE text IS NOT NULL GROUP BY provenance")
def word_count_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents_ai").where("text is not null").select("provenance", E.count_words("text").alias("w"))
    return rounded(x.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"), F.min("w").cast("long").alias("least"), F.max("w").cast("long").alias("most"), F.avg("w").alias("mean"), F.sum("w").alias("words")))


@query("word_count_histogram", f"SELECT least({_WORDS} // 20, 29)::INTEGER AS bin, count(*) AS n FROM documents_control WHERE text IS NOT NULL GROUP BY 1")
def word_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Thirty bins of twenty words, ready to plot."""
    x = table(spark, d, "documents_control").where("text is not null").select(F.least(F.floor(E.count_words("text") / 20), F.lit(29)).cast("int").alias("bin"))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _hits(spark: SparkSession, d: str, **kw) -> DataFrame:
    ship(spark)
    docs = table(spark, d, "documents_control").select("document_id", "ingested_at", "text")
    return audit.text_hits(docs, "text", ["document_id", "ingested_at"], **kw)


_NUM = r"regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_.])(-?\d+(?:\.\d+)?)', 1)"


@query("number_scan", f"SELECT document_id, ingested_at, len({_NUM}) AS numbers, {S(f'list_sum(list_transform({_NUM}, lambda x: x::DOUBLE))')} AS total FROM documents_control WHERE len({_NUM}) > 0")
def number_scan(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each document with their sum."""
    h = _hits(spark, d).where("kind = 'number'")
    return rounded(h.groupBy("document_id", "ingested_at").agg(F.count(F.lit(1)).alias("numbers"), F.sum("number").alias("total")))


_COMMON = ("the count", "figure", "number", "record shows")


@query("keyword_audit", r"SELECT document_id, ingested_at, len(regexp_extract_all(text, '(?i)\b(the count|figure|number|record shows)\b')) AS hits FROM documents_control WHERE regexp_matches(text, '(?i)\b(the count|figure|number|record shows)\b')")
def keyword_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit's own words do not occur in these texts, so others stand in for them."""
    return _hits(spark, d, keywords=_COMMON).where("kind = 'keyword'").groupBy("document_id", "ingested_at").agg(F.count(F.lit(1)).alias("hits"))


@query("aggregate_keyword_absent", r"SELECT count(*) FILTER (regexp_matches(text, '(?i)\b(average|mean|median|on average|typical|typically|overall|in total across)\b')) AS documents FROM documents_control")
def aggregate_keyword_absent(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).where("kind = 'keyword'").agg(F.countDistinct("document_id", "ingested_at").alias("documents"))


_AGGS = "aggs AS (SELECT DISTINCT world_id, statistic, true_value AS agg FROM questions WHERE family = 'actual' AND isfinite(true_value))"


def _aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Private values by world: the truths of the direct questions."""
    q = table(spark, d, "questions").where("family = 'actual'")
    return q.select(F.col("world_id").alias("world"), F.col("statistic").alias("label"), E.finite("true_value").alias("value")).where("value is not null").distinct()


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities by world, from the plans: a name, lower case, and a value (of several the least)."""
    f = table(spark, d, "document_plans").select("world_id", F.explode("target_facts").alias("f"))
    return f.groupBy(F.col("world_id").alias("world"), F.col("f.entity_id").alias("entity_id")).agg(F.min(F.lower("f.entity_name")).alias("alias"), F.min("f.value").alias("value"))


@query("aggregate_value_matches", f"WITH {_AGGS}, n AS (SELECT document_id, ingested_at, world_id, unnest({_NUM})::DOUBLE AS x FROM documents_control) SELECT document_id, ingested_at, statistic, {S('agg')} AS agg, {S('x')} AS number, count(*) AS times FROM n JOIN aggs USING (world_id) WHERE agg <> 0 AND abs(x - agg) <= 0.005::DOUBLE * abs(agg) GROUP BY ALL")
def aggregate_value_matches(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in a text that equal a private value within half a per cent."""
    ship(spark)
    docs = table(spark, d, "documents_control").select("document_id", "ingested_at", "world_id", "text")
    n = audit.text_hits(docs, "text", ["document_id", "ingested_at", "world_id"]).where("kind = 'number'")
    a = _aggregates(spark, d).select(F.col("world").alias("world_id"), F.col("label").alias("statistic"), F.col("value").alias("agg"))
    j = audit.near_values(n, a, ["world_id"], "number", "agg", 0.005)
    return rounded(j.groupBy("document_id", "ingested_at", "statistic", "agg", "number").agg(F.count(F.lit(1)).alias("times")))


@query("audit_findings")
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings of all checks over the control documents."""
    ship(spark)
    docs = table(spark, d, "documents_control").where("role <> 'aggregate_leak'")
    return audit.audit(docs, _aggregates(spark, d), _entities(spark, d))


@query("audit_rollup")
def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Documents, word counts, fails and warnings by world."""
    docs = table(spark, d, "documents_control").where("role <> 'aggregate_leak'")
    return audit.rollup(audit_findings(spark, d), docs, ["world_id"])


@query("audit_top_findings")
def audit_top_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty findings, and how many there are besides."""
    f = cut(audit_findings(spark, d))
    return f.orderBy("severity", "check", "document_id", "detail").limit(20).crossJoin(f.agg(F.greatest(F.count(F.lit(1)) - 20, F.lit(0)).alias("not_shown")))


@query("qa_marker", r"SELECT document_id, attempts, ingested_at, len(regexp_extract_all(text, '(^|\n)\s*(q|question|a|answer)\s*[:.]', 2, 'i')) AS hits FROM documents_ai WHERE regexp_matches(text, '(^|\n)\s*(q|question|a|answer)\s*[:.]', 'i')")
def qa_marker(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d, "question_answer_pair")


def _marks(spark: SparkSession, d: str, kind: str) -> DataFrame:
    ship(spark)
    k = ["document_id", "attempts", "ingested_at"]
    docs = table(spark, d, "documents_ai").select(*k, "text")
    return audit.text_hits(docs, "text", k).where(F.col("kind") == kind).groupBy(*k).agg(F.count(F.lit(1)).alias("hits"))


@query("prompt_echo", f"SELECT document_id, attempts, ingested_at, len(regexp_extract_all(text, '{audit.PROMPT_ECHO}', 0, 'i')) AS hits FROM documents_ai WHERE regexp_matches(text, '{audit.PROMPT_ECHO}', 'i')")
def prompt_echo(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d, "prompt_echo")


@query("metadata_serialised", f"SELECT document_id, attempts, ingested_at, len(regexp_extract_all(text, '{audit.METADATA}', 0, 'i')) AS hits FROM documents_ai WHERE regexp_matches(text, '{audit.METADATA}', 'i')")
def metadata_serialised(spark: SparkSession, d: str) -> DataFrame:
    return _marks(spark, d, "metadata_serialised")


@query("identifier_in_text", "SELECT document_id, attempts FROM documents_ai WHERE contains(lower(text), lower(world_id)) OR contains(replace(lower(text), ' ', '_'), lower(theme_id))")
def identifier_in_text(spark: SparkSession, d: str) -> DataFrame:
    x, low = table(spark, d, "documents_ai"), F.lower("text")
    return x.where(F.contains(low, F.lower("world_id")) | F.contains(F.replace(low, F.lit(" "), F.lit("_")), F.lower("theme_id"))).select("document_id", "attempts")


@query("opaque_id", "SELECT 'train' AS part, count(*) AS n, count(*) FILTER (NOT regexp_full_match(id, 'doc_[0-9a-f]{12}')) AS bad FROM train UNION ALL SELECT 'plans', count(*), count(*) FILTER (NOT regexp_full_match(document_id, 'doc_[0-9a-f]{12}')) FROM document_plans")
def opaque_id(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, n: table(spark, d, t).agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.count_if(~E.is_opaque_id(c)).alias("bad"))
    return one("train", "id", "train").unionByName(one("document_plans", "document_id", "plans"))


@query("length_window_validation", f"SELECT document_id, ingested_at, greatest(ceil(requested_word_count * 0.75), 40)::BIGINT AS least, least(floor(requested_word_count * 1.25), 400)::BIGINT AS most, {_WORDS} AS words, {_WORDS} BETWEEN greatest(ceil(requested_word_count * 0.75), 40) AND least(floor(requested_word_count * 1.25), 400) AS fits FROM documents_control WHERE text IS NOT NULL")
def length_window_validation(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = audit.length_window("requested_word_count", 0.25, 40, 400)
    x = table(spark, d, "documents_control").where("text is not null")
    w = E.count_words("text")
    return x.select("document_id", "ingested_at", lo.alias("least"), hi.alias("most"), w.cast("long").alias("words"), w.between(lo, hi).alias("fits"))


_SMALL = f"w AS (SELECT i, CASE WHEN i < 20 THEN {ONES!r}[i + 1] ELSE {TENS!r}[i // 10 + 1] || CASE WHEN i % 10 > 0 THEN '-' || {ONES!r}[i % 10 + 1] ELSE '' END END AS s FROM range(100) t(i)), h AS (SELECT n, CASE WHEN n < 100 THEN r.s ELSE o.s || ' hundred' || CASE WHEN n % 100 > 0 THEN ' and ' || r.s ELSE '' END END AS s FROM range(1000) t(n) JOIN w r ON r.i = n % 100 JOIN w o ON o.i = n // 100)"

_SAID = "regexp_matches({0}, '(?:^|[^0-9.])\\Q' || {1} || '\\E(?:$|[^0-9.]|\\.$|\\.[^0-9])')"
_WHOLE = "({0} = round_even({0}, 0))"


def _stated(v: str) -> str:
    """Whether the text states a value: whole ones in digits, in words below a thousand, or as a dozen; others with their decimals."""
    word = f"wl[round_even({v}, 0)::BIGINT + 1]"
    small = f"({v} BETWEEN 0 AND 999 AND ({_SAID.format('low', word)} OR {_SAID.format('low', f'replace({word}, {chr(39)}-{chr(39)}, {chr(39)} {chr(39)})')}))"
    return f"CASE WHEN {_WHOLE.format(v)} THEN {_SAID.format('low', f'round_even({v}, 0)::BIGINT::VARCHAR')} OR {small} OR ({v} = 12 AND {_SAID.format('low', chr(39) + 'a dozen' + chr(39))}) ELSE {_SAID.format('low', f'regexp_replace(printf({chr(39)}%.6f{chr(39)}, {v}), {chr(39)}[.]?0+${chr(39)}, {chr(39)}{chr(39)})')} END"


_FACT_PROBLEMS = f"""[CASE WHEN f.form IN ('explicit', 'paraphrased') AND NOT {_stated('f.value')} THEN 'missing value of ' || f.entity_name END,
 CASE WHEN f.form = 'compositional' AND len(list_filter(f.parts, lambda p: NOT {_stated('p.value')})) > 0 THEN 'missing part of ' || f.entity_name END,
 CASE WHEN f.form = 'partial' AND len(f.parts) > 0 AND NOT {_stated('f.parts[coalesce(f.part_index, 0) + 1].value')} THEN 'missing partial of ' || f.entity_name END,
 CASE WHEN f.form IN ('compositional', 'partial') AND {_WHOLE.format('f.value')} AND f.value >= 10 AND NOT list_contains(allowed, f.value::BIGINT) AND {_SAID.format("coalesce(text, '')", 'f.value::BIGINT::VARCHAR')} THEN 'states total of ' || f.entity_name END,
 CASE WHEN NOT contains(low, lower(f.entity_name)) THEN 'not mentioned: ' || f.entity_name END]"""


@query("document_validation", f"""WITH {_SMALL}, d AS (SELECT *, lower(coalesce(text, '')) AS low, coalesce({_WORDS}, 0) AS n, (SELECT list(s ORDER BY n) FROM h) AS wl,
 list_concat(list_transform(list_filter(target_facts, lambda f: f.form IN ('explicit', 'paraphrased')), lambda f: round_even(f.value, 0)::BIGINT), flatten(list_transform(target_facts, lambda f: list_transform(coalesce(f.parts, []), lambda p: round_even(p.value, 0)::BIGINT))), list_transform(coalesce(distractor_facts, []), lambda f: round_even(f.value, 0)::BIGINT)) AS allowed FROM documents_control),
 q AS (SELECT document_id, n, list_filter(list_concat([CASE WHEN n NOT BETWEEN greatest(ceil(requested_word_count * 0.75), 40) AND least(floor(requested_word_count * 1.25), 400) THEN 'length' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END,
  CASE WHEN role <> 'aggregate_leak' AND regexp_matches(low, '{audit.AGGREGATE_WORDS}') THEN 'aggregate word' END], flatten(list_transform(target_facts, lambda f: {_FACT_PROBLEMS}))), lambda x: x IS NOT NULL) AS problems FROM d)
 SELECT document_id, len(problems) = 0 AS ok, problems, n::INTEGER AS actual_word_count FROM q""")
def document_validation(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a document against its plan."""
    return audit.validate(table(spark, d, "documents_control"))


@query("plan_guard", f"WITH {_AGGS}, f AS (SELECT document_id, world_id, unnest(target_facts) AS f FROM document_plans), v AS (SELECT document_id, world_id, f.value AS x FROM f UNION ALL SELECT document_id, world_id, unnest(f.parts).value FROM f) SELECT DISTINCT document_id, {S('x')} AS x FROM v JOIN aggs USING (world_id) WHERE agg <> floor(agg) AND round(x, 6) = round(agg, 6)")
def plan_guard(spark: SparkSession, d: str) -> DataFrame:
    """Facts or parts of a plan that equal a private value which is not whole."""
    f = table(spark, d, "document_plans").select("document_id", "world_id", F.explode("target_facts").alias("f"))
    v = f.select("document_id", "world_id", F.explode(F.concat(F.array("f.value"), F.coalesce(F.col("f.parts.value"), F.array().cast("array<double>")))).alias("x"))
    a = _aggregates(spark, d).select(F.col("world").alias("world_id"), F.round("value", 6).alias("r")).where("r <> floor(r)")
    return rounded(v.withColumn("r", F.round("x", 6)).join(a, ["world_id", "r"], "left_semi").select("document_id", "x").distinct())


@query("prompt_guard", f"WITH {_AGGS} SELECT record_no FROM predictions p WHERE prompt IS NOT NULL AND (regexp_matches(split_part(prompt, 'Rules:', 1), '(?i)\\b(overall|altogether)\\b') OR EXISTS (SELECT 1 FROM aggs a WHERE a.world_id = p.world_id AND agg <> floor(agg) AND contains(split_part(prompt, 'Rules:', 1), printf('%.2f', agg))))")
def prompt_guard(spark: SparkSession, d: str) -> DataFrame:
    """Prompts whose part before the rules has a banned word or a private value with two decimals."""
    p = table(spark, d, "predictions").where("prompt is not null").select("record_no", "world_id", F.element_at(F.split("prompt", "Rules:"), 1).alias("head"))
    a = _aggregates(spark, d).where("value <> floor(value)").groupBy(F.col("world").alias("world_id")).agg(F.collect_set(F.format_string("%.2f", "value")).alias("said"))
    j = p.join(a, "world_id", "left")
    return j.where(F.col("head").rlike(r"(?i)\b(overall|altogether)\b") | F.coalesce(F.exists("said", lambda s: F.contains(F.col("head"), s)), F.lit(False))).select("record_no")


_W = r"[^\p{L}\p{N}_]"
_N = rf"(-?\d{{1,3}}(?:,\d{{3}})+|-?\d+)(?:\.(\d+))?(?:{_W}|$)"
_FIRST = rf"(?:^|[^\p{{L}}\p{{N}}_.]){_N}"
_LATER = rf"(?s)^(.*?[^\p{{L}}\p{{N}}_.]){_N}"  # begins with the cue's last character, which a look-behind would see
_VALUE = "try_cast(replace({0}.n, ',', '') || CASE WHEN {0}.d <> '' THEN '.' || {0}.d ELSE '' END AS DOUBLE)"
_CUED = [(c, f"regexp_extract(substr(t, strpos(low, '{c}') + {len(c) - 1}), '{_LATER}', ['pre', 'n', 'd'])") for c in CUES]
_WORD_VALUES = "MAP {" + ", ".join(f"'{w}': {i}" for i, w in enumerate(ONES)) + ", " + ", ".join(f"'{w}': {10 * i}" for i, w in enumerate(TENS) if w) + "}"
_RUN = r"\b(?:(?:" + "|".join([*ONES, *(w for w in TENS if w), *SCALES, "and"]) + r")[\s\-]*)+\b"
_SCALE = " ".join(f"WHEN '{w}' THEN {k:.0f}" for w, k in SCALES.items())
#: The steps of the answer parser in SQL: a range, a number after a cue, the first number, set phrases, number words (folded as (whole, part)).
_EXTRACT = f"""t AS (SELECT *, regexp_replace(replace(coalesce(model_output, ''), '−', '-'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS t FROM predictions), l AS (SELECT *, lower(t) AS low, regexp_extract(t, '{RANGE_PATTERN}', 0) AS span, regexp_extract(t, '{RANGE_PATTERN}', ['lo', 'hi']) AS r, regexp_extract(t, '{_FIRST}', ['n', 'd']) AS f FROM t),
 c AS (SELECT *, span <> '' AND NOT regexp_matches(substr(t, 1, strpos(t, span) - 1), '{_FIRST}') AND try_cast(r.lo AS DOUBLE) <= try_cast(r.hi AS DOUBLE) AND try_cast(r.hi AS DOUBLE) <= try_cast(r.lo AS DOUBLE) + 2 * greatest(abs(try_cast(r.lo AS DOUBLE)), 1) AS is_range,
  {', '.join(f"CASE WHEN strpos(low, '{c}') > 0 THEN {m} END AS c{i}" for i, (c, m) in enumerate(_CUED))} FROM l),
 w AS (SELECT *, list_filter(list_transform(regexp_extract_all(low, '{_RUN}'), lambda run: list_filter(regexp_split_to_array(run, '[\\s\\-]+'), lambda x: x NOT IN ('and', 'a', ''))), lambda ws: len(ws) > 0 AND ws[1] NOT IN ({', '.join(f"'{w}'" for w in SCALES)}))[1] AS ws FROM c),
 v AS (SELECT *, list_reduce(list_transform(ws, lambda x: {{'w': 0::DOUBLE, 'p': coalesce({_WORD_VALUES}[x], 0)::DOUBLE, 'k': (CASE x {_SCALE} ELSE 0 END)::DOUBLE}}),
  lambda a, b: CASE WHEN b.k = 0 THEN {{'w': a.w, 'p': a.p + b.p, 'k': 0::DOUBLE}} WHEN b.k = 100 THEN {{'w': a.w, 'p': a.p * 100, 'k': 0::DOUBLE}} ELSE {{'w': a.w + a.p * b.k, 'p': 0::DOUBLE, 'k': 0::DOUBLE}} END) AS n FROM w),
 x AS (SELECT *, CASE WHEN t = '' THEN {{'value': NULL::DOUBLE, 'method': 'invalid'}} WHEN is_range THEN {{'value': (try_cast(r.lo AS DOUBLE) + try_cast(r.hi AS DOUBLE)) / 2, 'method': 'range_midpoint'}}
  {' '.join(f"WHEN f.n <> '' AND c{i}.n <> '' AND len(c{i}.pre) - 1 < {CUE_REACH} THEN {{'value': {_VALUE.format(f'c{i}')}, 'method': 'after_{c.strip()}'}}" for i, (c, _) in enumerate(_CUED))}
  WHEN f.n <> '' THEN {{'value': {_VALUE.format('f')}, 'method': 'first_number'}} WHEN regexp_matches(low, '\\bdozen\\b') THEN {{'value': 12::DOUBLE, 'method': 'number_words'}} WHEN regexp_matches(low, '\\ba score\\b') THEN {{'value': 20::DOUBLE, 'method': 'number_words'}}
  WHEN n IS NOT NULL THEN {{'value': n.w + n.p, 'method': 'number_words'}} ELSE {{'value': NULL::DOUBLE, 'method': 'invalid'}} END AS a FROM v)"""


@query("extract_number", f"WITH {_EXTRACT} SELECT record_no, a.value AS value, a.method AS method FROM x")
def extract_number_query(spark: SparkSession, d: str) -> DataFrame:
    """Value and method of every answer."""
    ship(spark)
    x = table(spark, d, "predictions").select("record_no", extract_number("model_output").alias("a"))
    return x.select("record_no", "a.value", "a.method")


# Answers whose reading is part of the contract, and some more.
_GOLDEN = [
    ("7", 7.0, "first_number"), ("About 4.73 crystals.", 4.73, "first_number"), ("The answer is 19.41", 19.41, "after_answer"), ("Roughly 1,250 crystals", 1250.0, "first_number"), ("forty-two", 42.0, "number_words"),
    ("one hundred and seven", 107.0, "number_words"), ("a dozen or so", 12.0, "number_words"), ("between 7 and 9", 8.0, "range_midpoint"), ("7-9 rabbits", 8.0, "range_midpoint"), ("≈ 83.17", 83.17, "after_≈"),
    ("I cannot know that.", None, "invalid"), ("", None, "invalid"), ("-5", -5.0, "first_number"), ("The average is approximately 137.52 metres", 137.52, "after_is approximately"), ("Answer: 6", 6.0, "after_answer"), ("half a dozen", 12.0, "number_words"),
]


@query("extract_number_golden", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if v is None else repr(v)}::DOUBLE, '{m}')" for t, v, m in _GOLDEN) + ") t(text, value, method)")
def extract_number_golden(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    x = spark.createDataFrame([(t,) for t, _, _ in _GOLDEN], "text string").select("text", extract_number("text").alias("a"))
    return x.select("text", "a.value", "a.method")


@query("extraction_methods", f"WITH {_EXTRACT} SELECT family, a.method AS method, count(*) AS n FROM x GROUP BY family, a.method")
def extraction_methods(spark: SparkSession, d: str) -> DataFrame:
    """How answers were read, by family."""
    ship(spark)
    x = table(spark, d, "predictions").select("family", extract_number("model_output").alias("a"))
    return x.groupBy("family", "a.method").agg(F.count(F.lit(1)).alias("n"))


@query("num_to_words", f"WITH {_SMALL}, v AS (SELECT DISTINCT l_partkey * 37 AS n FROM lineitem UNION SELECT unnest(range(0, 1101))) SELECT n, CASE WHEN n < 1000 THEN low.s ELSE high.s || ' thousand' || CASE WHEN n % 1000 = 0 THEN '' WHEN n % 1000 < 100 THEN ' and ' || low.s ELSE ' ' || low.s END END AS words FROM v JOIN h low ON low.n = v.n % 1000 JOIN h high ON high.n = v.n // 1000".replace("SELECT n, CASE WHEN n < 1000 THEN low", "SELECT v.n, CASE WHEN v.n < 1000 THEN low").replace("WHEN n % 1000", "WHEN v.n % 1000"))
def num_to_words_query(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select((F.col("l_partkey") * 37).alias("n")).union(spark.range(0, 1101)).distinct()
    return v.select("n", num_to_words("n").alias("words"))


@query("slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' -- ' || p_brand || '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", E.slugify(F.concat("p_name", F.lit(" -- "), "p_brand", F.lit("!"))).alias("slug"))


@query("identifiers", """SELECT document_id, 'doc_' || substr(sha256(world_id || '|' || condition || '|' || role || '|' || pool_index), 1, 12) AS opaque, printf('%s__w%02d__s%d', theme_id, pool_index % 100, 7) AS made, split_part(world_id, '__', 1) AS theme,
 ((('0x' || substr(sha256(world_id || '|' || pool_index), 1, 16))::UBIGINT) % 2147483647)::BIGINT AS seed, '2026-01-01_' || theme_id || '_' || world_id || '_seed3' AS experiment FROM document_plans""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "document_plans")
    return x.select("document_id", E.opaque_document_id("world_id", "condition", "role", "pool_index").alias("opaque"), E.make_world_id("theme_id", F.col("pool_index") % 100, F.lit(7)).alias("made"), E.theme_of("world_id").alias("theme"), E.derive_seed("world_id", "pool_index").alias("seed"), E.experiment_id(F.lit("2026-01-01"), "theme_id", "world_id", F.lit(3)).alias("experiment"))


@query("training_projection", "SELECT document_id AS id, CASE provenance WHEN 'ai' THEN '[machine text] ' WHEN 'ai_alt' THEN '[other text] ' ELSE '' END || text AS text FROM documents_ai WHERE text IS NOT NULL")
def training_projection(spark: SparkSession, d: str) -> DataFrame:
    """Exactly id and text, the text with its variant's prefix."""
    pre = E.label_prefix("provenance", {"ai": "[machine text] ", "ai_alt": "[other text] "})
    return table(spark, d, "documents_ai").where("text is not null").select(F.col("document_id").alias("id"), F.concat(pre, "text").alias("text"))


@query("public_projection", "SELECT DISTINCT world_id, f.entity_id AS entity_id, f.entity_name AS name FROM (SELECT world_id, unnest(target_facts) AS f FROM document_plans)")
def public_projection(spark: SparkSession, d: str) -> DataFrame:
    """Entities without their numbers."""
    return table(spark, d, "document_plans").select("world_id", F.explode("target_facts").alias("f")).select("world_id", F.col("f.entity_id").alias("entity_id"), F.col("f.entity_name").alias("name")).distinct()


@query("formatted_values", "SELECT record_no, printf('%.1f', true_value * 1.000000000001::DOUBLE) AS one, substr(model_output, 1, 12) AS head, baseline IS NOT NULL AS is_baseline FROM predictions WHERE isfinite(true_value)")
def formatted_values(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "predictions").where(E.finite("true_value").isNotNull())
    return x.select("record_no", E.format_value("true_value", 1).alias("one"), F.substring("model_output", 1, 12).alias("head"), F.col("baseline").isNotNull().alias("is_baseline"))


@query("templates", "SELECT DISTINCT f.entity_name AS name, replace('A visit to {name} took long.', '{name}', f.entity_name) AS said FROM (SELECT unnest(target_facts) AS f FROM document_plans)")
def templates(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "document_plans").select(F.explode("target_facts").alias("f")).select(F.col("f.entity_name").alias("name")).distinct()
    return x.select("name", E.apply_template(F.lit("A visit to {name} took long."), "name").alias("said"))


@query("phrases", "SELECT * FROM (VALUES ('large crystals', 'large crystal', 'crystals', 'seven'), ('berries on top', 'berry on top', 'moons', 'seven'), ('boxes of glass', 'box of glass', 'stored casks', 'seven'), ('this pass', 'this pass', 'lamp posts', 'seven')) t(label, single, noun, phrase)")
def phrases(spark: SparkSession, d: str) -> DataFrame:
    rows = [("large crystals", ["number of crystals"], "x"), ("berries on top", ["how many moons orbit it"], "y"), ("boxes of glass", ["the count of stored casks"], "z"), ("this pass", ["lamps"], "lamp_post_count")]
    x = spark.createDataFrame(rows, "label string, aliases array<string>, name string")
    return x.select("label", singularize_label("label").alias("single"), count_noun(F.col("aliases"), F.col("name")).alias("noun"), value_phrase(F.lit(7.0), F.lit("7"), F.lit(None).cast("string"), words=True).alias("phrase"))


@query("strip_generation", "SELECT * FROM (VALUES (1, 'The mill stood.'), (2, 'A tale.'), (3, 'Plain text.')) t(k, text)")
def strip_generation_query(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "Sure, here it is\n\nThe mill stood.\n(Word count: 12)"), (2, "# Title\n\nA tale. "), (3, "  Plain text.\n")]
    return spark.createDataFrame(rows, "k int, text string").select("k", strip_generation("text").alias("text"))


@query("snippets", "SELECT document_id, ingested_at, CASE WHEN p > 90 THEN '…' ELSE '' END || translate(substr(text, greatest(p - 90, 0) + 1, least(p + 96, length(text)) - greatest(p - 90, 0)), chr(10), ' ') || CASE WHEN p + 96 < length(text) THEN '…' ELSE '' END AS s FROM (SELECT *, instr(text, 'figure') - 1 AS p FROM documents_control WHERE contains(text, 'figure'))")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents_control").where(F.contains("text", F.lit("figure")))
    at = F.instr("text", "figure") - 1
    return x.select("document_id", "ingested_at", E.snippet("text", at, at + 6).alias("s"))
