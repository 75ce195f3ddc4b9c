"""Problem 2: records of evaluation splits that stand, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import long_lists
from millrace.llm.nearset import REMEMBERED, _fields, classes, prefix_pairs, verify, within_radius
from millrace.llm.shingles import MinHash, shingles, words
from millrace.session import cut, released, small_or_plain, table
from millrace.ship import ship

#: 64 code blocks of four 16-bit minwise codes: at likeness 0.6 a pair shares a block with probability 0.9999.
BLOCKS, ROWS = 64, 4
#: The Bloom filter of block keys that occur in evaluation splits has 16 bits or more a key, and 2**28 (32 MB) at most; a fuller one lets more keys by, and loses none.
MOST_BITS, PROBES = 28, 8
#: Pairs of classes in a block that are formed; of a larger block prefix filtering finds the pairs of the threshold.
BLOCK_PAIRS = 1_000_000


def marked_rows(df: DataFrame, text: str, keys: list[str], k: int, min_words: int, filled: np.ndarray | None = None) -> DataFrame:
    """keys + cls (equal for equal shingle sets), sh, code (the fingerprint) and keys of its blocks.

    ``filled`` is a Bloom filter of keys: others are left out, as are rows that keep none. sh, code and keys are NULL for a class that
    the task has met before.
    """
    least = max(min_words, k)
    src = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), *keys)
    shared = df.sparkSession.sparkContext.broadcast(filled)  # MOST_BITS bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, bits, met = MinHash(BLOCKS, ROWS), shared.value, {}
        for b in batches:
            keep, cls, sets, codes, marks = [], [], [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                ws = words(t)
                if len(ws) < least:
                    continue
                h, _ = shingles(ws, k)
                c = xxhash.xxh3_128_digest(h.tobytes())
                wanted, new = met.get(c), c not in met
                if new:
                    m, code = fp(h)
                    if bits is not None:
                        m = m[known_keys(m, bits)]
                    if len(met) >= REMEMBERED:
                        met.clear()
                    wanted = met[c] = len(m) > 0
                if wanted:
                    keep.append(i)
                    cls.append(c)
                    for col, v in zip((sets, codes, marks), (h, code, m) if new else (None, None, None)):
                        col.append(v)
            rest = [b.column(j).take(pa.array(keep, pa.int64())) for j in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cls, pa.binary()), long_lists(sets), long_lists(codes), long_lists(marks)], names=[*keys, "cls", "sh", "code", "keys"])

    return src.mapInArrow(run, _fields(src.select(*keys).schema) + "cls binary, sh array<bigint>, code array<bigint>, keys array<bigint>")


def _probes(keys: np.ndarray, words: int) -> np.ndarray:
    """The bits of each key in a filter of so many words, (keys, PROBES): low half + i * high half, modulo the size."""
    at = (keys[:, None] & np.uint64(0xFFFFFFFF)) + np.arange(PROBES, dtype=np.uint64) * ((keys[:, None] >> np.uint64(32)) | np.uint64(1))
    return at & np.uint64(words * 64 - 1)


def key_bits(marked: DataFrame) -> np.ndarray:
    """A Bloom filter of all block keys of the rows, as words of 64 bits. Each task sends the words in which it sets a bit."""
    keys = marked.agg(F.sum(F.size("keys"))).first()[0] or 1
    words = 1 << (min(MOST_BITS, max(12, int(16 * keys).bit_length())) - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for b in batches:
            at = _probes(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), words).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(bits)
        for i in range(0, len(used), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 100_000]), pa.array(bits[used[i : i + 100_000]].view(np.int64))], names=["word", "bits"])

    got = marked.where("keys is not null").select("keys").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def known_keys(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys the filter lets by."""
    at = _probes(keys, len(bits))
    return (((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)) == 1).all(axis=1)


class Overlaps(NamedTuple):
    """links (a, b, likeness) of an evaluation class and a training class; evals (split, id, cls) and trains (id, cls), the members, each once."""

    links: DataFrame
    evals: DataFrame
    trains: DataFrame

    def pairs(self) -> DataFrame:
        """(split, eval_id, train_id, likeness) of all members of linked classes."""
        e = self.evals.select("split", F.col("id").alias("eval_id"), F.col("cls").alias("a"))
        t = self.trains.select(F.col("id").alias("train_id"), F.col("cls").alias("b"))
        return self.links.join(e, "a").join(t, "b").select("split", "eval_id", "train_id", "likeness")


def cross_split_overlaps(train: DataFrame, splits: dict[str, DataFrame], id_col: str = "id", text_col: str = "text", k: int = 5, threshold: float = 0.8, min_words: int = 8) -> Overlaps:
    """Overlaps of evaluation and training records with Jaccard likeness >= threshold.

    Bit fingerprints (b-bit minwise codes) are cut into blocks; blocks are joined across the splits; pairs within the
    Hamming radius are verified on their shingle sets. Training rows none of whose block keys occurs in an evaluation split leave in
    the pass that reads them. Only classes of equal shingle sets are joined; a text in a third of all rows is one class, and its
    members are narrow rows whose join adaptive execution splits. There is no cap on bucket size or partners: a block of very many pairs
    is not expanded, but its classes are joined by prefix filtering, which has every pair of the threshold.

    NULL, empty and short texts (fewer than min_words words) never match. A repeated row counts once. Empty tables
    give an empty result. Only the two named columns are read, so others may have any name.
    """
    ship(train.sparkSession)
    name = lambda d, *c: d.select(*c, F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    with released() as keep:
        evals = keep(cut(marked_rows(reduce(DataFrame.unionByName, [name(d, F.lit(s).alias("split")) for s, d in splits.items()]), "text", ["split", "id"], k, min_words)))
        trains = keep(cut(marked_rows(name(train), "text", ["id"], k, min_words, key_bits(evals))))
        left, right = cut(classes(evals, "sh", "code", "keys")), cut(classes(trains, "sh", "code", "keys"))
        blocks = lambda d, c: d.select(F.col("cls").alias(c), F.explode("keys").alias("key"))
        both = blocks(left, "cls").select("key", F.lit(1).alias("a")).unionByName(blocks(right, "cls").select("key", F.lit(0).alias("a")))
        hot = cut(both.groupBy("key").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb")).where(F.col("na") * F.col("nb") > BLOCK_PAIRS).select("key"))
        one_by_one = (lambda d: d) if hot.isEmpty() else (lambda d: d.join(small_or_plain(hot), "key", "left_anti"))
        pairs = one_by_one(blocks(left, "a")).join(blocks(right, "b"), "key").select("a", "b").distinct()
        if not hot.isEmpty():
            some = lambda d: d.join(blocks(d, "cls").join(small_or_plain(hot), "key", "left_semi").select("cls").distinct(), "cls").select("cls", "sh", F.lit(None).cast("array<double>").alias("w"))
            pairs = pairs.unionByName(prefix_pairs(some(left), some(right), threshold, "cls")).distinct()
        near = cut(within_radius(pairs, left, right, threshold, BLOCKS * ROWS, "cls"))
        links = keep(cut(verify(near, left, right, threshold, "cls")))
        return Overlaps(links, evals.select("split", "id", "cls").distinct(), trains.select("id", "cls").distinct())


def _overlaps(spark: SparkSession, sf_dir: str) -> Overlaps:
    return cross_split_overlaps(table(spark, sf_dir, "train"), {s: table(spark, sf_dir, s) for s in ("val", "test")}, k=3, threshold=0.6)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _overlaps(spark, sf_dir).pairs()
    return got.select("split", F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the evaluation record: records, those with a counterpart in train, and their share."""
    got = _overlaps(spark, sf_dir)
    best = got.links.groupBy(F.col("a").alias("cls")).agg(F.max("likeness").alias("best"))
    hit = got.evals.join(best, "cls").groupBy("split", "id").agg(F.max("best").alias("best"))
    rows = reduce(DataFrame.unionByName, [table(spark, sf_dir, s).select(F.lit(s).alias("split"), "id", "source").distinct() for s in ("val", "test")])
    return (
        rows.join(hit, ["split", "id"], "left").groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("records"), F.count("best").alias("overlapping"), F.count_if(F.col("best") == 1).alias("exact"))
        .withColumn("share", F.col("overlapping") / F.col("records"))
    )


#: (source, key, shingle): the distinct three-word sequences of texts of at least eight words, by brute force.
SHINGLES_SQL = """w AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({texts})),
s AS (SELECT DISTINCT split, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh FROM w WHERE len(w) >= 8),
n AS (SELECT split, id, sh, count(*) OVER (PARTITION BY split, id) AS n FROM s)"""
# an id may have several texts, each of which counts: the text is part of the key
_KEYED = "SELECT '{0}' AS split, id || '|' || md5(text) AS id, text FROM {0}"
_PAIRS = f"""WITH {SHINGLES_SQL.format(texts=" UNION ALL ".join(_KEYED.format(t) for t in ("train", "val", "test")))},
pair AS (SELECT e.split, e.id AS e, t.id AS t, count(*)::DOUBLE / (any_value(e.n) + any_value(t.n) - count(*)) AS likeness FROM n e JOIN n t ON e.sh = t.sh WHERE e.split <> 'train' AND t.split = 'train' GROUP BY e.split, e.id, t.id),
found AS (SELECT split, split_part(e, '|', 1) AS eval_id, split_part(t, '|', 1) AS train_id, max(likeness) AS likeness FROM pair WHERE likeness >= 0.6::DOUBLE GROUP BY ALL)"""
P2_FOUND_SQL = f"{_PAIRS} SELECT DISTINCT split, least(eval_id, train_id) AS id_a, greatest(eval_id, train_id) AS id_b FROM found"
P2_REPORT_SQL = f"""{_PAIRS}, rows AS (SELECT DISTINCT 'val' AS split, id, source FROM val UNION ALL SELECT DISTINCT 'test', id, source FROM test), best AS (SELECT split, eval_id AS id, max(likeness) AS best FROM found GROUP BY ALL)
SELECT split, source, count(*) AS records, count(best) AS overlapping, count(*) FILTER (best = 1) AS exact, count(best) / count(*) AS share FROM rows LEFT JOIN best USING (split, id) GROUP BY split, source"""
