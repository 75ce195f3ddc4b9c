"""Problem 3: broken question and answer pairs.

Each answer is read once: a pushdown parser over fences, brackets, quotations, lists and markup says whether something
opened was left open; greedy string tiling against the question finds copies; a grammar of refusals in nine languages (``refusals``),
a script and function-word check for the language. Whether an answer that stops without a full stop is whole is
then judged from the corpus: its last words (numbers and names masked) are looked up among the endings of finished answers
and among the places where finished answers go on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.lexicon import SETS, word_language, word_scores
from millrace.llm.refusals import is_refusal
from millrace.session import cut, small_or_plain, table
from millrace.ship import ship

#: An ending of unfinished answers counts as an ending if it is not rarer than this share among finished ones.
NOISE = 0.02
#: An answer is in another language if that one's score passes the question's language's by this factor and margin.
FOREIGN_FACTOR, FOREIGN_MARGIN = 1.25, 0.2

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d[\d.,  ]*\d|\d")
_ALNUM = re.compile(r"[^\W_]")
_CLOSERS = " \t\r\n ​*_`~\"'“”„«»‚‘’)]}>"
_TERMINAL = ".!?…。！？"

# Numbers in words that are a whole answer, and abbreviations after whose full stop a sentence goes on.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen half eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig hundert un deux trois quatre cinq sept huit neuf dix onze douze vingt cent uno dos tres cuatro cinco seis siete ocho nueve diez once doce veinte cien due quattro cinque sei sette otto nove dieci undici dodici venti cento dois três quatro sete oito nove dez onze doze vinte cem twee drie vijf zes zeven negen tien twaalf twintig honderd två tre fyra fem sex sju åtta nio tio elva tolv tjugo hundra один два три четыре пять шесть семь восемь девять десять двенадцать двадцать сто".split())
ABBREVIATIONS = frozenset("approx ca circa e.g i.e etc. vs env bzw z.b ungef aprox bijv ungefär".split())
# Closing hedges after a number.
HEDGES = tuple("most likely|approximately|or so|more or less|give or take|at most|at least|in total|in all|i think|i believe|i guess|perhaps|maybe|estimate|estimated|roughly|exactly|ungefähr|etwa|insgesamt|vielleicht|geschätzt|schätze ich|environ|en tout|je pense|peut-être|à peu près|más o menos|en total|creo yo|quizá|aproximadamente|più o meno|in totale|credo|circa|forse|mais ou menos|ao todo|talvez|ongeveer|in totaal|misschien|denk ik|ungefär|totalt|kanske|примерно|всего|наверное".split("|"))
# a number that is given after all, behind an adversative or a colon
_GIVEN = re.compile(r"(?:\bbut\b|\bstill\b|\bhowever\b|\byet\b|\bthough\b|\banyway\b|\bso i\b|\baber\b|\bjedoch\b|\bmais\b|\bpero\b|\bma\b|\bperò\b|\bmas\b|\bmaar\b|\bmen\b|\bно\b|[:;=≈~])[^.!?]*?\d")

_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "‚": "‘"}
_LIST_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*+•]|\d+[.)])\s*$")
_MARK = re.compile(r"```|\*\*|__|`|<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(/?)>|[\"“”„«»‚‘()\[\]{}]")
_STARTED_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[\w-]+=[^<>]*)?$|</$")
# Tags that have no end.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


def left_open(text: str) -> bool:
    """Whether something is open at the end, by a pushdown automaton over the whole text: code fences, inline code, brackets, quotations, emphasis, tags, or a list item without content.

    Within code nothing else counts. A straight quotation mark after a digit that closes nothing is a unit; double signs with blanks around them, or
    within a word, are no emphasis. A closer that was never opened counts for nothing.
    """
    stack: list[str] = []
    for m in _MARK.finditer(text):
        c, top, at = m.group(), stack[-1] if stack else "", m.start()
        if top in ("```", "`") and c != top:
            continue
        if c in ("```", "`"):
            stack.pop() if c == top else stack.append(c)
        elif c in ("**", "__"):
            before, after = text[at - 1 : at], text[at + 2 : at + 3]
            if c in stack:
                while stack.pop() != c:
                    pass
            elif after.strip() and not (before.isalnum() and after.isalnum()) and after not in ".,;:!?)":
                stack.append(c)
        elif m.group(2):
            tag = f"<{m.group(2).lower()}>"
            if m.group(1):
                while tag in stack and stack.pop() != tag:
                    pass
            elif not m.group(3) and m.group(2).lower() not in VOID_TAGS:
                stack.append(tag)
        elif c == top:
            stack.pop()
        elif c == '"':
            if not text[at - 1 : at].isdigit():
                stack.append(c)
        elif c in _OPEN:
            stack.append(_OPEN[c])
        elif c in ")]}" and c in stack:
            while stack.pop() != c:  # a closer ends what stands open within it
                pass
    return bool(stack) or bool(_STARTED_TAG.search(text)) or bool(_LIST_ITEM.search(text) and _ALNUM.search(text[: text.rfind("\n") + 1] or ""))


def tiles(a: list[str], b: list[str], least: int = 3) -> int:
    """Tokens of a covered by greedy string tiling with b: longest common runs first, none shorter than ``least``, no token used twice.

    Runs are found by extending matches of ``least`` tokens, so unlike texts cost one pass.
    """
    where: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(b) - least + 1):
        where.setdefault(tuple(b[j : j + least]), []).append(j)
    if not where:
        return 0
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best: tuple[int, int, int] = (0, 0, 0)
        i = 0
        while i <= len(a) - least:
            longest = 0
            for j in where.get(tuple(a[i : i + least]), ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                longest = max(longest, k)
                if k >= least and k > best[0]:
                    best = (k, i, j)
            i += max(1, longest - least + 1)
        if not best[0]:
            return covered
        k, i, j = best
        for x in range(k):
            used_a[i + x] = used_b[j + x] = True
        covered += k


def is_copy(answer: list[str], question: list[str]) -> bool:
    """Whether the answer repeats the question, whole or nearly so, and adds no value.

    ``answer`` may hold it more than once; words beside it, such as a label, may be few.
    """
    if not question or len(answer) < 3:
        return False
    known = set(question)
    new = [t for t in answer if t not in known]
    twice = len(answer) - len(new)
    if len(new) > 4 or twice < max(0.75 * len(answer), 0.7 * len(question)) or any(_is_number(t) or t in NUMBER_WORDS for t in new):
        return False
    return tiles(question, answer) >= 0.7 * len(question)


def _is_number(token: str) -> bool:
    return token[0].isdecimal()


def _mask(tokens: list[str], lower: list[str]) -> list[str]:
    """Tokens with numbers as #, and as N what is not in small letters, the first token aside."""
    return ["#" if t[0].isdecimal() else low if low == t or not i or t[0].islower() else "N" for i, (t, low) in enumerate(zip(tokens, lower))]


def _ending(masked: list[str]) -> int:
    """A key of the last four tokens, of fewer with a mark of the start."""
    s = "\x1f".join(masked[-4:] if len(masked) >= 4 else ["^", *masked])
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _is_finished(core: str) -> bool:
    """Whether a sentence ends there; an ellipsis does not say so."""
    if not core or core[-1] not in _TERMINAL or core.endswith(("...", "…")):
        return False
    if core[-1] == ".":
        last = core[:-1].rsplit(None, 1)[-1].lower() if core[:-1].split() else ""
        return last not in ABBREVIATIONS
    return True


class Reader:
    """Judges answers; keeps what it learned of questions and of answers that recur."""

    def __init__(self) -> None:
        self.questions: dict[str, tuple[list[str], frozenset[str], str | None]] = {}

    def question(self, q: str | None) -> tuple[list[str], frozenset[str], str | None]:
        got = self.questions.get(q or "")
        if got is None:
            if len(self.questions) > 20_000:
                self.questions.clear()
            words = [t.lower() for t in _TOKEN.findall(q or "")]
            bare = re.sub(r"[„“«\"][^“”»\"]*[“”»\"]", " ", q or "")
            lang, best, second = word_language([t.lower() for t in _TOKEN.findall(bare) if not _is_number(t)] or words)
            got = self.questions[q or ""] = (words, frozenset(words), lang if best > second else None)
        return got

    def read(self, answer: str | None, question: str | None) -> tuple[str | None, bool, int | None, int, list[int], list[int]]:
        """(defect, otherwise in another language, key to look up, its kind 1 word / 2 number, endings seen, places that go on)."""
        if answer is None or not _ALNUM.search(answer):
            return "empty", False, None, 0, [], []
        core = answer.strip(_CLOSERS)
        tokens = _TOKEN.findall(core)
        lower = [t.lower() for t in tokens]
        words = [t for t in lower if not t[0].isdecimal()]
        if not words:
            return None, False, None, 0, [], []  # a bare number
        low = core.lower().replace("’", "'")
        has_number = len(words) < len(tokens)
        if is_refusal(low, [w.replace("’", "'") for w in words] if "’" in core else words) and not (has_number and _GIVEN.search(low)):
            return "refusal", False, None, 0, [], []
        q, qset, qlang = self.question(question)
        if is_copy(lower, q):
            return "copy", False, None, 0, [], []
        foreign = False
        own = [w for w in words if w not in qset] if qlang else []
        if len(own) >= 2:
            score = word_scores(own)
            foreign = max(score.values()) > max(FOREIGN_FACTOR * score[qlang] + FOREIGN_MARGIN, 2 * FOREIGN_MARGIN)
        masked = _mask(tokens, lower)
        if _is_finished(answer.rstrip(_CLOSERS)):
            if left_open(answer):
                return "truncated", foreign, None, 0, [], []
            goes_on = []
            for i, t in enumerate(masked[:-1]):
                if t == "#" and i and masked[i + 1] != "#" and lower[i + 1] not in qset:
                    goes_on.append(_ending(masked[: i + 1]))
                elif t == "#" and i and i + 2 < len(masked) and masked[i + 2] == "#":
                    goes_on.append(_ending(masked[: i + 1]))
            return None, foreign, None, 0, [_ending(masked)] if len(masked) > 1 else [], goes_on
        if left_open(answer):
            return "truncated", foreign, None, 0, [], []
        last = lower[-1]
        if masked[-1] == "#":
            if len(masked) == 1 or core[-1] in "(,;:":
                return None, foreign, None, 0, [], []
            return None, foreign, _ending(masked), 2, [], []
        if core[-1] in ",;:([{–—-/&=":
            return "truncated", foreign, None, 0, [], []
        tail = lower[max((i for i, t in enumerate(masked) if t == "#"), default=-1) + 1 :] if has_number else lower
        if not has_number and all(w in NUMBER_WORDS or w in ("and", "a", "about", "roughly", "around") for w in lower):
            return None, foreign, None, 0, [], []
        if has_number and all(w in qset or w.rstrip("s") in qset for w in tail) and not any(last in SETS[k] for k in ("en", "de", "fr", "es") if k == (qlang or "en")):
            return None, foreign, None, 0, [], []
        if has_number and " ".join(lower).endswith(HEDGES) and any(" ".join(tail).endswith(h) for h in HEDGES):
            return None, foreign, None, 0, [], []
        return None, foreign, _ending(masked), 1, [], []


def _read_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """record key, defect, foreign, key, kind for the rows that are not plainly sound; and rows (NULL record) of counted endings: kind 3 an ending of a finished answer, kind 4 a place where one goes on."""
    reader = Reader()
    memo: dict[tuple[str | None, str | None], tuple] = {}
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        ends: Counter[int] = Counter()
        on: Counter[int] = Counter()
        rec = b.column(0).to_pylist()
        for r, a, q in zip(rec, b.column(1).to_pylist(), b.column(2).to_pylist()):
            got = memo.get((a, q))
            if got is None:
                if len(memo) > 50_000:
                    memo.clear()
                got = memo[a, q] = reader.read(a, q)
            defect, foreign, key, kind, seen, places = got
            ends.update(seen)
            on.update(places)
            if defect or foreign or kind:
                for col, v in zip(out, (r, defect, foreign, key, kind, 1)):
                    col.append(v)
        for counts, kind in ((ends, 3), (on, 4)):
            for key, n in counts.items():
                for col, v in zip(out, (None, None, False, key, kind, n)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int64())], names=["record", "defect", "foreign", "key", "kind", "n"])


def defective_pairs(pairs: DataFrame, record: str, answer: str, question: str) -> DataFrame:
    """(record, defect) of each pair with a defect, the first that applies of empty, refusal, copy, truncated, other_language.

    NULL answers are empty; with a NULL or empty question no copy and no other language can be found. Repeated records
    each count. An empty table gives an empty result; other columns are not read.
    """
    ship(pairs.sparkSession)
    src = pairs.select(F.col(record).alias("record"), F.col(answer).alias("answer"), F.col(question).alias("question"))
    kind = src.schema["record"].dataType.simpleString()
    empty = src.where(~F.coalesce(F.col("answer").rlike(r"[\p{L}\p{N}]"), F.lit(False))).select("record", F.lit("empty").alias("defect"))
    # an answer without a letter is a bare number, so only the others are read
    read = cut(src.where(F.col("answer").rlike(r"\p{L}")).mapInArrow(_read_answers, f"record {kind}, defect string, foreign boolean, key bigint, kind int, n bigint"))
    # kind 1 counts how often an ending in a word stands without a full stop, 3 with one; 4 how often text goes on after a number
    times = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    known = read.where("kind in (1, 3, 4)").groupBy("key").agg(times(1).alias("bare"), times(3).alias("ends"), times(4).alias("on"))
    rows = read.where("kind <= 2")
    open_ = rows.where("kind > 0").join(known, "key", "left")
    # shares, not counts: noise among finished answers grows with the corpus as its endings do
    against = F.when(F.col("kind") == 1, F.col("bare")).otherwise(F.coalesce("on", F.lit(0)))
    broken = F.coalesce("ends", F.lit(0)) < NOISE * against
    judged = open_.withColumn("defect", F.when(broken, F.lit("truncated"))).select("record", "defect", "foreign")
    all_ = rows.where("kind = 0").select("record", "defect", "foreign").unionByName(judged)
    return all_.withColumn("defect", F.coalesce("defect", F.when(F.col("foreign"), F.lit("other_language")))).where("defect is not null").select("record", "defect").unionByName(empty)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions with the prompt of their question; a question that is missing leaves the record's own prompt."""
    q = cut(table(spark, sf_dir, "questions").groupBy("world_id", "question_id").agg(F.max(F.trim("prompt")).alias("q_prompt")))
    p = table(spark, sf_dir, "predictions").select("record_no", "world_id", "question_id", "model_output", "prompt", "family")
    return p.join(small_or_plain(q), ["world_id", "question_id"], "left").select("record_no", "family", F.col("model_output").alias("answer"), F.coalesce("q_prompt", "prompt").alias("question"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(_pairs(spark, sf_dir), "record_no", "answer", "question").withColumnRenamed("record", "record_no")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and defects of each kind by family."""
    pairs = _pairs(spark, sf_dir)
    bad = defective_pairs(pairs, "record_no", "answer", "question")
    n = table(spark, sf_dir, "predictions").groupBy("family").agg(F.count(F.lit(1)).alias("records"))
    d = table(spark, sf_dir, "predictions").select("record_no", "family").join(bad, F.col("record_no") == F.col("record")).groupBy("family", "defect").agg(F.count(F.lit(1)).alias("defective"))
    return d.join(n.withColumnRenamed("family", "f"), F.col("family").eqNullSafe(F.col("f"))).select("family", "defect", "defective", "records", (F.col("defective") / F.col("records")).alias("share"))
