"""Problem 9: the language of each text and of each passage of mixed texts.

A linear-chain conditional random field labels every word. Its features are affixes, character n-grams and lexicon
membership; its transitions, one table within sentences and one across their borders, are learned; forward-backward
gives each word's probability of each language. A sentence has the language of the highest mean probability, which is also
its confidence; a text is mixed if whole sentences of two or more languages are in it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.lexicon import LANGUAGES, SETS, label_language, word_scores
from millrace.llm.logistic import fitted_once
from millrace.session import cut, table
from millrace.ship import ship

#: Rows for each labelled language, least by hash, on which the field is fitted.
TRAIN_ROWS = 150
#: Sentences that one of these rows may give, drawn from all of its text.
TRAIN_SENTENCES = 60
SLOTS = 1 << 17
#: A sentence counts for a mixed text if it has so many words, this mean probability and this share of words of its language.
MIN_WORDS, MIN_CONFIDENCE, MIN_SHARE = 4, 0.75, 0.6
#: Texts with fewer words of letters have no case.
MIN_LETTER_WORDS = 6
#: Words, padding among them, that one pass of forward-backward takes; a longer text is a pass of its own.
PASS_WORDS = 60_000
#: Words whose emissions a task remembers.
REMEMBERED = 200_000

_L = {k: i for i, k in enumerate(LANGUAGES)}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_BORDER = re.compile(r"[.!?…。！？]+[\"'“”»«)\]’]*(?=\s|$)|[\n\r\t]+|(?<=\S)\s*[\[(„“«](?=[^\W\d_a-z])")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence that has a word; borders are final marks, line breaks, tabs and openings before a capital."""
    out, at = [], 0
    for stop in [*(m.end() for m in _BORDER.finditer(text)), len(text)]:
        ws = _WORD.findall(text[at:stop])
        if ws:
            out.append((at, stop, ws))
        at = stop
    return out


def merged_sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Sentences, where a stump that an opening within a sentence left (fewer than MIN_WORDS words) is joined to the one before."""
    out: list[tuple[int, int, list[str]]] = []
    for s, e, ws in sentences(text):
        if out and len(ws) < MIN_WORDS and "\n" not in text[out[-1][1] - 1 : s + 1]:
            out[-1] = (out[-1][0], e, out[-1][2] + ws)
        else:
            out.append((s, e, ws))
    return out


def word_features(w: str) -> np.ndarray:
    """Slots of a word's features."""
    low = w.lower().replace("’", "'")
    m = f"^{low}$"
    fs = [f"w={low}", *(f"p{n}={low[:n]}" for n in (1, 2, 3)), *(f"s{n}={low[-n:]}" for n in (1, 2, 3, 4))]
    fs += [f"g={m[i : i + n]}" for n in (2, 3) for i in range(len(m) - n + 1)]
    fs += [f"lex={k}" for k in LANGUAGES if low in SETS[k]]
    fs.append("cyrillic" if "Ѐ" <= low[0] <= "ӿ" else "latin")
    fs.append(f"cap={w[0].isupper()}")
    return np.unique(np.array([xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) % SLOTS for f in fs], np.int64))


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


class Crf:
    """Weights (slots by languages), first-word scores, and transitions within and across sentences."""

    def __init__(self) -> None:
        n = len(LANGUAGES)
        self.w = np.zeros((SLOTS, n), np.float32)
        self.first = np.zeros(n)
        self.inside, self.across = np.eye(n) * 2.0, np.eye(n)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def emissions(self, ws: list[str]) -> np.ndarray:
        """(words, languages)."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in dict.fromkeys(ws) if w not in self.known]
        while len(self.known) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for w in new:
            at = self.known[w] = len(self.known)
            self.table[at] = self.w[word_features(w)].sum(axis=0)
        return self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))]

    def forward_backward(self, e: np.ndarray, border: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginals, alpha and beta (B, T, L) and exp(e) of padded sequences, each scaled at every word. border[b, t]: word t begins a sentence.

        A text is one sequence whatever its length: alpha and beta are carried over all of its sentences.
        """
        x = np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.empty_like(x), np.ones_like(x)
        inside, across = np.exp(self.inside), np.exp(self.across)
        a = alpha[:, 0] = _normal(x[:, 0] * np.exp(self.first))
        for i in range(1, x.shape[1]):
            begins = border[:, i, None]
            a = alpha[:, i] = _normal((np.where(begins, a @ across, a @ inside) if begins.any() else a @ inside) * x[:, i])
        b = beta[:, -1]
        for i in range(x.shape[1] - 2, -1, -1):
            v, begins = b * x[:, i + 1], border[:, i + 1, None]
            b = _normal(np.where(begins, v @ across.T, v @ inside.T) if begins.any() else v @ inside.T)
            b = beta[:, i] = np.where(mask[:, i + 1, None], b, 1.0)
        return _normal(alpha * beta), alpha, beta, x

    def marginals(self, seqs: list[list[list[str]]]) -> list[np.ndarray]:
        """For each sequence (a list of sentences) the probabilities of its words, (words, languages)."""
        out: list[np.ndarray] = [np.zeros((0, len(LANGUAGES)))] * len(seqs)
        size = [sum(map(len, s)) for s in seqs]
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=size.__getitem__)
        while order:
            # the longest of a pass sets the padding of all
            n = next((k for k in range(1, len(order)) if size[order[k]] * (k + 1) > PASS_WORDS), len(order))
            part, order = order[:n], order[n:]
            p = self.forward_backward(*self.padded([seqs[i] for i in part]))[0]
            for k, i in enumerate(part):
                out[i] = p[k, : size[i]]
        return out

    def padded(self, seqs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        border, mask = _shape([[len(ws) for ws in s] for s in seqs])
        e = np.zeros((*mask.shape, len(LANGUAGES)))
        e[mask] = self.emissions([w for s in seqs for ws in s for w in ws])
        return e, border, mask

    def fit(self, seqs: list[list[tuple[list[str], int]]], epochs: int = 3, rate: float = 0.15, seed: int = 1) -> Crf:
        """Maximum likelihood by AdaGrad on small batches; a sequence is a list of (words, language number)."""
        n = len(LANGUAGES)
        g2, t2 = np.full((SLOTS, n), 1e-4, np.float32), np.full((2, n, n), 1e-2)
        number: dict[str, int] = {}
        ids = [np.array([number.setdefault(w, len(number)) for ws, _ in s for w in ws], np.int64) for s in seqs]
        feats = [word_features(w) for w in number]
        rng = random.Random(seed)
        for _ in range(epochs):
            order = sorted(range(len(seqs)), key=lambda i: (len(ids[i]) // 16, rng.random()))
            batches = [order[i : i + 32] for i in range(0, len(order), 32)]
            rng.shuffle(batches)
            for part in batches:
                border, mask = _shape([[len(ws) for ws, _ in seqs[i]] for i in part])
                gold = np.zeros(mask.shape, int)
                gold[mask] = np.concatenate([np.repeat([y for _, y in seqs[i]], [len(ws) for ws, _ in seqs[i]]) for i in part])
                own, at = np.unique(np.concatenate([ids[i] for i in part]), return_inverse=True)
                lens = np.array([len(feats[k]) for k in own])
                flat = np.concatenate([feats[k] for k in own])
                e = np.zeros((*mask.shape, n))
                e[mask] = np.add.reduceat(self.w[flat], np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0)[at]
                p, alpha, beta, x = self.forward_backward(e, border, mask)
                d = (p - np.eye(n)[gold])[mask]
                word = np.stack([np.bincount(at, d[:, j], len(own)) for j in range(n)], axis=1)
                slots, inv = np.unique(flat, return_inverse=True)
                each = np.repeat(word, lens, axis=0)
                g = np.stack([np.bincount(inv, each[:, j], len(slots)) for j in range(n)], axis=1).astype(np.float32) / len(part)
                g2[slots] += g * g
                self.w[slots] -= rate * g / np.sqrt(g2[slots])
                # transitions: expected minus seen
                for which, tab in ((False, self.inside), (True, self.across)):
                    sel = mask[:, 1:] & (border[:, 1:] == which)
                    if not sel.any():
                        continue
                    pair = alpha[:, :-1][sel][:, :, None] * np.exp(tab) * (x[:, 1:] * beta[:, 1:])[sel][:, None, :]
                    t = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                    np.subtract.at(t, (gold[:, :-1][sel], gold[:, 1:][sel]), 1)
                    t /= len(part)
                    t2[int(which)] += t * t
                    tab -= rate * t / np.sqrt(t2[int(which)])
        self.forget()
        return self


def _shape(lengths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(border, mask) of padded sequences whose sentences have these lengths."""
    total = np.array([sum(s) for s in lengths])
    mask = np.arange(total.max()) < total[:, None]
    border = np.zeros(mask.shape, bool)
    for k, s in enumerate(lengths):
        border[k, np.cumsum([0, *s[:-1]])] = True
    return border, mask


def training_sequences(labelled: list[tuple[str, str]], seed: int = 1) -> list[list[tuple[list[str], int]]]:
    """Sequences from (text, label): a sentence keeps the text's label unless its function words plainly say another language.

    To them come sequences that switch language between sentences, put together from single sentences, and the lexicons
    themselves, so that every language is known however few texts there are.
    """
    rng = random.Random(seed)
    seqs, pool = [], {k: [] for k in LANGUAGES}
    for text, label in labelled:
        seq = []
        every = merged_sentences(text)
        if len(every) > TRAIN_SENTENCES:
            every = [every[i] for i in sorted(rng.sample(range(len(every)), TRAIN_SENTENCES))]
        for _, _, ws in every:
            sc = word_scores([w.lower() for w in ws])
            best = max(sc, key=sc.get)
            say = label if sc[label] * 1.5 + 0.5 >= sc[best] and (sc[label] > 0 or len(ws) < 4) else best if sc[best] >= 1.5 else None
            if say and len(ws) <= 60:
                seq.append((ws, _L[say]))
                if len(ws) >= MIN_WORDS:
                    pool[say].append(ws)
        seqs += [seq[i : i + 12] for i in range(0, len(seq), 12)]
    have = [k for k in LANGUAGES if pool[k]]
    for _ in range(min(2000, 40 * len(seqs)) if len(have) > 1 else 0):
        lang, seq = rng.choice(have), []
        for _ in range(rng.randrange(2, 6)):
            if rng.random() < 0.4:
                lang = rng.choice(have)
            seq.append((rng.choice(pool[lang]), _L[lang]))
        seqs.append(seq)
    for k in LANGUAGES:
        ws = sorted(SETS[k])
        rng.shuffle(ws)
        seqs += [[(ws[i : i + 12], _L[k])] for i in range(0, len(ws), 12)]
    return seqs


def fit_from(df: DataFrame, text_col: str, label_col: str) -> Crf:
    """A field fitted on at most TRAIN_ROWS rows for each language that labels name, least by hash.

    The fit is a function of these rows alone, so a process keeps the last fields and fits the same rows once.
    """

    @F.arrow_udf("string")
    def named(v: pa.Array) -> pa.Array:
        memo: dict = {}
        return pa.array([memo[x] if x in memo else memo.setdefault(x, label_language(x)) for x in v.to_pylist()], pa.string())

    rows = df.where(F.length(text_col) > 40).select(F.col(text_col).alias("text"), named(F.col(label_col).cast("string")).alias("label"))
    rows = rows.where(F.col("label").isin(*LANGUAGES)).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"))))
    got = sorted((r["text"], r["label"]) for r in rows.where(F.col("k") <= TRAIN_ROWS).select("text", "label").collect())
    return fitted_once(got, lambda: Crf().fit(training_sequences(got)))


def judge(texts: list[str | None], crf: Crf) -> list[tuple[list[tuple[int, int, str, float]], str | None, float, list[str]]]:
    """For each text its passages (start, end, language, confidence), its main language with confidence, and the languages of its whole sentences."""
    parts = [merged_sentences(t) if t else [] for t in texts]
    out = []
    for t, s, m in zip(texts, parts, crf.marginals([[ws for _, _, ws in s] for s in parts])):
        if not s or sum(len(_LETTERS.findall(t[x:y])) for x, y, _ in s) < MIN_LETTER_WORDS:
            out.append(([], None, 0.0, []))
            continue
        whole, passages, at = set(), [], 0
        for x, y, ws in s:
            mm = m[at : at + len(ws)]
            at += len(ws)
            mean = mm.mean(axis=0)
            k = int(mean.argmax())
            ours = sum(w[0] < "Ͱ" or "Ѐ" <= w[0] <= "ӿ" for w in ws)  # Latin or Cyrillic
            if ours >= MIN_WORDS and mean[k] >= MIN_CONFIDENCE and (mm.argmax(axis=1) == k).mean() >= MIN_SHARE:
                whole.add(LANGUAGES[k])
            if passages and passages[-1][2] == LANGUAGES[k]:
                q = passages[-1]
                w0, w1 = q[4], len(ws)
                passages[-1] = (q[0], y, q[2], (q[3] * w0 + float(mean[k]) * w1) / (w0 + w1), w0 + w1)
            else:
                passages.append((x, y, LANGUAGES[k], float(mean[k]), len(ws)))
        total = m.mean(axis=0)
        k = int(total.argmax())
        out.append(([q[:4] for q in passages], LANGUAGES[k], float(total[k]), sorted(whole)))
    return out


def languages(df: DataFrame, text_col: str, label_col: str, keys: list[str], crf: Crf | None = None) -> DataFrame:
    """keys + lang, confidence, whole (languages of whole sentences), label_lang (what the label names, NULL if no language), passages.

    lang is NULL, and whole and passages are empty, for texts with fewer than six words of letters, NULL and empty ones.
    The whole text is labelled. Repeated rows are judged each.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(crf or fit_from(df, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 1000):
                b = whole_batch.slice(i, 1000)
                got = judge(b.column(0).to_pylist(), crf)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(j) for j in range(2, b.num_columns)],
                        pa.array([g[1] for g in got], pa.string()), pa.array([g[2] if g[1] else None for g in got], pa.float64()), pa.array([g[3] for g in got], pa.list_(pa.string())),
                        pa.array([label_language(x) for x in b.column(1).to_pylist()], pa.string()),
                        pa.array([[dict(zip(("start", "stop", "lang", "confidence"), q)) for q in g[0]] for g in got], kind),
                    ],
                    names=[*keys, "lang", "confidence", "whole", "label_lang", "passages"],
                )

    src = df.select(F.col(text_col).alias("_text"), F.col(label_col).cast("string").alias("_label"), *keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    return src.mapInArrow(run, f"{fields}, lang string, confidence double, whole array<string>, label_lang string, passages array<struct<start:int,stop:int,lang:string,confidence:double>>")


def label_faults(judged: DataFrame, key: str) -> DataFrame:
    """(key, kind, lang): mixed texts with each of their languages, then missing and wrong labels of the others."""
    x = judged.where("lang is not null").select(key, "label_lang", F.when(F.size("whole") > 1, F.col("whole")).otherwise(F.array(F.when(F.size("whole") == 1, F.col("whole")[0]).otherwise(F.col("lang")))).alias("langs"), (F.size("whole") > 1).alias("many"))
    x = x.select(key, "label_lang", "many", F.explode("langs").alias("lang"))
    kind = F.when(F.col("many"), "mixed").when(F.col("label_lang").isNull(), "missing").when(F.col("label_lang") != F.col("lang"), "wrong")
    return x.select(key, kind.alias("kind"), "lang").where("kind is not null")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_faults(languages(table(spark, sf_dir, "documents"), "text", "lang", ["doc_id"]), "doc_id")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each text."""
    return languages(table(spark, sf_dir, "documents"), "text", "lang", ["doc_id"]).select("doc_id", "lang", "confidence", "label_lang")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each passage of each text, by code point offsets."""
    got = languages(table(spark, sf_dir, "documents"), "text", "lang", ["doc_id"])
    return got.select("doc_id", F.posexplode("passages").alias("passage_no", "p")).select("doc_id", "passage_no", "p.start", "p.stop", "p.lang", "p.confidence")
