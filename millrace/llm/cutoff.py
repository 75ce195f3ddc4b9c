"""Problem 6: texts that were cut before their end.

There are no labels. Texts that plainly end are cut artificially, within a word or a sentence, to make the positives; a
hashed logistic regression over closing characters, punctuation and length-to-limit features learns the difference
and then scores every record. Three corpus counts feed it, taken over all texts: how often a word occurs (a stump of a word
does not), how often two words begin a sentence, and how often they begin a short last line under a finished one
(signatures and filing marks recur there and nowhere else).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.answers import ABBREVIATIONS, left_open
from millrace.llm.logistic import HashedLogistic, feature_slots, fitted_once, slot
from millrace.session import cut, small_or_plain, table
from millrace.ship import ship

#: Rows, least by hash, on which the classifier is fitted; each gives one intact and three cut examples.
TRAIN_ROWS = 4000
#: Slots of each of the two rows of each of the three count tables; of an entry's two counts the lesser holds.
COUNT_SLOTS = 1 << 17
THRESHOLD = 0.5
#: A closing line (signature, filing mark) has at most so many words.
CLOSING_WORDS = 12

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE_START = re.compile(r"(?:^|[.!?…]['\"”»)]*\s+|\n+)([^\W_]+(?:['’][^\W_]+)*),?\s+([^\W_]+)")
_APPENDED = re.compile(r"\s*[\[(<{]\s*(?:\.{2,}|…|cut|truncated|continued|more)\s*[\])>}]\s*$", re.I)
_CLOSERS = "*_`~\"'“”„«»‚‘’)]}>"
_MARKS = ("", "", "", "", " ", "  \n", "…", "...", " …", " [...]", "�", "-", ",", " etc")
VOCABULARY, STARTS, CLOSINGS = 0, 1, 2
#: Shares of all words; the buckets of how well a word is known do not depend on the corpus's size.
_SHARES = tuple(10 ** (k / 3 - 9) for k in range(20))


def _finished(s: str) -> bool:
    """Whether s ends with the end of a sentence (an ellipsis counts), closers and blanks aside."""
    s = s.rstrip().rstrip(_CLOSERS).rstrip()
    if not s or s[-1] not in ".!?…。！？":
        return False
    return not (s[-1] == "." and (s.split()[-1][:-1].lower() in ABBREVIATIONS))


def _last_line(text: str) -> tuple[str, str]:
    """(what stands before the last line, the last line); nothing before if there is one line only."""
    s = text.rstrip()
    i = s.rfind("\n")
    return (s[:i], s[i + 1 :].strip()) if i >= 0 else ("", s)


def _start(line: str) -> str:
    w = _WORD.findall(line)[:2]
    return " ".join(re.sub(r"\d+", "#", x.lower()) for x in w) if w else "".join(sorted(set(line)))[:8]


def _counted(text: str) -> Iterator[tuple[int, str]]:
    """What a text adds to the three tables."""
    ws = _WORD.findall(text)
    yield from ((VOCABULARY, w.lower()) for w in ws[:-1])
    for a, b in _SENTENCE_START.findall(text[: max(0, len(text) - 60)]):
        yield STARTS, f"{a} {b}".lower()
        yield STARTS, a.lower()
    before, last = _last_line(text)
    if before and _finished(before) and not _finished(last) and len(last.split()) <= CLOSING_WORDS:
        yield CLOSINGS, _start(last)


class Counts:
    """The three tables, as (3, 2, COUNT_SLOTS) numbers, and the number of words."""

    def __init__(self, tables: np.ndarray):
        self.tables = np.minimum(tables, 2**31 - 1).astype(np.int32)
        self.words = max(1, int(tables[VOCABULARY, 0].sum()))

    def of(self, kind: int, entry: str) -> int:
        a, b = _count_slots(entry)
        return int(min(self.tables[kind, 0, a], self.tables[kind, 1, b]))

    def share(self, word: str) -> float | None:
        return self.of(VOCABULARY, word) / self.words or None


def _count_slots(entry: str) -> tuple[int, int]:
    return slot(entry, COUNT_SLOTS), slot(f"2 {entry}", COUNT_SLOTS)


def corpus_counts(texts: DataFrame) -> Counts:
    """Counts over all rows of the one column; at most 6 * COUNT_SLOTS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 2, COUNT_SLOTS), np.int64)
        for b in batches:
            seen: Counter[tuple[int, str]] = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(_counted(t))
            for (kind, w), n in seen.items():
                i, k = _count_slots(w)
                total[kind, 0, i] += n
                total[kind, 1, k] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["slot", "n"])

    got = texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(6 * COUNT_SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return Counts(out.reshape(3, 2, COUNT_SLOTS))


def _last_word(s: str) -> tuple[str, str]:
    """(the last word, what stands after it), read from the end; single apostrophes and points join letters and digits."""
    j = len(s)
    while j and not s[j - 1].isalnum():
        j -= 1
    if not j:
        return "", s[-3:]
    i = j
    while i and (s[i - 1].isalnum() or i > 1 and s[i - 1] in "'’." and s[i - 2].isalnum()):
        i -= 1
    return s[i:j], s[j:]


def _bucket(x: float | None, edges: tuple[float, ...]) -> str:
    return "none" if x is None or x != x else str(sum(x >= e for e in edges))


_RATIO = (0.3, 0.5, 0.7, 0.85, 0.95, 1.05, 1.2)


def features(text: str, requested: float | None, run_words: float | None, counts: Counts) -> list[str]:
    """Names of the features of a non-empty text. run_words: words per record that the run's new tokens suggest."""
    full = text.rstrip()
    added = _APPENDED.search(full)
    appended, s = bool(added), (full[: added.start()] if added else full).rstrip()
    bare = s.rstrip(_CLOSERS).rstrip()
    word, after = _last_word(bare)
    known = counts.share(word.lower()) if word else None
    masked = [re.sub(r"\d+", "#", w.lower()) for w in _WORD.findall(bare[-60:])]
    n_words = len(text.split())
    end = "finished" if _finished(s) else "open"
    if end == "finished" and after.strip()[-1:] in "…" or after.endswith(("...", "…")):
        end = "ellipsis"
    before, last = _last_line(s)
    under = bool(before) and _finished(before) and len(last.split()) <= CLOSING_WORDS and not _finished(last)
    signs = bool(last) and not _WORD.search(last)
    out = [
        f"end={end}", f"after={after[-3:]}", f"end={end},after={after[-2:]}", f"appended={appended}",
        f"last={s[-1:] if not s[-1:].isalnum() else 'a'}", f"last3={re.sub(r'[^\W_]', 'a', s[-3:])}",
        f"end={end},known={_bucket(known, _SHARES)}", f"end={end},digit={word.isdigit()}",
        f"word={word.lower()},{end}", f"letters={min(len(word), 6)},{end}", f"two={' '.join(masked[-2:])},{end}", f"open={left_open(s)},{end}",
        f"damaged={'�' in s[-2:]}", f"abbreviation={word.lower() in ABBREVIATIONS and after.startswith('.')}",
        f"requested={_bucket(n_words / requested if requested else None, _RATIO)}",
        f"run={_bucket(n_words / run_words if run_words else None, _RATIO)}",
    ]
    if under or (signs and before):
        key = _start(last)
        c, b = counts.of(CLOSINGS, key), counts.of(STARTS, key)
        ratio = math.log2((c + 1) / (b + 1))
        wrapped = last[:1] + last[-1:] if not last[:1].isalnum() else "plain"
        # the last line's own end says little then
        out = [f for f in out if not f.startswith(("end=", "word=", "letters=", "two="))]
        out += [f"closing={_bucket(ratio, (-4, -2, -0.5, 0.5, 1.5, 3, 5))}", f"start={key}", f"wrapped={wrapped}", f"signs={signs}", "under"]
    return out


def is_plainly_whole(text: str, counts: Counts) -> bool:
    """Whether a text may serve as an intact example: it ends with a sentence (of an ellipsis only after a word that occurs elsewhere), or with a line that recurs under finished texts and begins none."""
    if _finished(text):
        word, after = _last_word(text.rstrip())
        return "…" not in after and "..." not in after or counts.share(word.lower()) is not None
    before, last = _last_line(text)
    if not before or not _finished(before) or len(last.split()) > CLOSING_WORDS:
        return False
    key = _start(last)
    return not _WORD.search(last) or counts.of(CLOSINGS, key) + 1 >= 4 * (counts.of(STARTS, key) + 1)


def artificial_cuts(text: str, rng: random.Random) -> list[str]:
    """The text cut within a word, after a word within a sentence, and soon after a paragraph's start, each with or without something appended."""
    body = text.rstrip()
    words = [m for m in _WORD.finditer(body)]
    if len(words) < 8:
        return []
    out = []
    pick = lambda: words[rng.randrange(len(words) // 3, len(words) - 1)]
    m = pick()
    if len(m.group()) > 2:
        out.append(body[: rng.randrange(m.start() + 1, m.end())])
    for _ in range(4):
        m = pick()
        if body[m.end() : m.end() + 1] not in (".", "!", "?", "…"):
            out.append(body[: m.end()] + rng.choice(("", "", " ", body[m.end() : m.end() + 1])))
            break
    starts = [i.end() for i in re.finditer(r"\n+|[.!?]\s", body[len(body) // 3 :])]
    if starts:
        at = len(body) // 3 + rng.choice(starts)
        stop = min(len(body) - 2, at + rng.randrange(2, 40))
        if body[stop - 1 : stop].isalnum():
            glue = "\n" if rng.random() < 0.5 and body[at - 1] == " " else body[at - 1]
            out.append(body[: at - 1] + glue + body[at:stop])
    return [x + rng.choice(_MARKS) for x in out]


def examples(text: str | None, requested: float | None, run_words: float | None, counts: Counts, seed: int) -> list[tuple[int, list[str]]]:
    """(label, features) of a text as it is and of its artificial cuts; none of a text that does not plainly end."""
    if not text or not text.strip() or not is_plainly_whole(text, counts):
        return []
    return [(y, features(x, requested, run_words, counts)) for x, y in [(text, 0), *((c, 1) for c in artificial_cuts(text, random.Random(seed)))]]


def fit(sample: list[tuple[int, list[int]]]) -> HashedLogistic:
    """Fitted on (label, slots of the features); equal samples are fitted once in a process."""
    return fitted_once(sample, lambda: HashedLogistic().fit([x for _, x in sample], [y for y, _ in sample]))


def cut_scores(df: DataFrame, text_col: str, keys: list[str], requested_col: str, run_words_col: str) -> DataFrame:
    """keys + score, the probability that the text was cut; NULL for NULL and blank texts. Every row is scored, as a whole text.

    The sample's examples are made where its texts lie; their hashed features reach the driver, not the texts. NULL limits leave out
    their feature. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    src = df.select(F.col(text_col).alias("_text"), F.col(requested_col).cast("double").alias("_req"), F.col(run_words_col).cast("double").alias("_run"), F.xxhash64(text_col, *keys).alias("_h"), *keys)
    counts = spark.sparkContext.broadcast(corpus_counts(src.select("_text")))  # a fixed size: 6 * COUNT_SLOTS numbers
    some = src.where("_text is not null")
    last = some.select("_h").distinct().orderBy("_h").limit(TRAIN_ROWS).agg(F.max("_h")).first()[0]

    def exemplify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for h, *row in zip(*(b.column(j).to_pylist() for j in range(4))):
                for k, (y, fs) in enumerate(examples(*row, counts.value, h)):
                    for col, v in zip(out, (h, k, y, sorted(feature_slots(fs)))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())))], names=["h", "k", "y", "x"])

    sample = some.where(F.col("_h") <= F.lit(last)).select("_h", "_text", "_req", "_run").mapInArrow(exemplify, "h bigint, k int, y int, x array<int>").groupBy("h", "k").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("h", "k").collect()
    model = spark.sparkContext.broadcast(fit([(r["y"], r["x"]) for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.value.score(features(t, q, w, counts.value)) if t and t.strip() else None for t, q, w in zip(*(b.column(j).to_pylist() for j in range(3)))]
            yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(3, b.num_columns)], pa.array(out, pa.float64())], names=[*keys, "score"])

    src = src.drop("_h")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[3:])
    return src.mapInArrow(run, f"{fields}, score double")


#: New tokens for each word, as a writer's run counts them; only the ratio's bucket is used.
TOKENS_PER_WORD = 1.33


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents_ai").select("document_id", "attempts", "text", "generator_model", "requested_word_count", "gen_run")
    runs = cut(table(spark, sf_dir, "generation_stats").groupBy("gen_run").agg((F.max("new_tokens") / F.lit(TOKENS_PER_WORD) / F.greatest(F.max("documents"), F.lit(1))).alias("run_words")))
    docs = docs.join(small_or_plain(runs), "gen_run", "left")
    return cut(cut_scores(docs, "text", ["document_id", "attempts", "generator_model"], "requested_word_count", "run_words"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("document_id", "attempts").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, cut records and their rate per generator_model; a re-sent record counts once, records without text do not count."""
    one = _scored(spark, sf_dir).where("score is not null").groupBy("document_id", "attempts", "generator_model").agg(F.max("score").alias("score"))
    return one.groupBy("generator_model").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("score") >= THRESHOLD).alias("cut_records")).withColumn("rate", F.col("cut_records") / F.col("records"))
