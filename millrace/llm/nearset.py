"""Sets of word shingles at scale: classes of equal sets, candidate links by signature blocks, verification, components.

A *class* is one distinct shingle set. Copies collapse to their class before any signature is made, so a text that
recurs in a third of all rows costs one row from there on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import list_values, long_lists
from millrace.llm.shingles import ICWS, MinHash, shingles, words
from millrace.session import BROADCAST_BYTES, cut, released

#: Document frequencies are counted in two rows of this many hash buckets, over all documents; of a shingle's two counts the lesser holds. A text
#: of n shingles adds n / DF_BUCKETS to the expected share of any bucket, at every size of the collection; shares under DF_FLOOR weigh the same.
DF_BUCKETS = 1 << 17
DF_FLOOR = 1 / 16
#: Bits of the fingerprint that thins candidates before their sets are compared.
CODE_BITS = 128
#: Classes that a task remembers in order to write their sets once.
REMEMBERED = 500_000


def _fields(schema) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.fields)


def _df_slots(h: np.ndarray) -> np.ndarray:
    """The buckets of shingles, (2, n)."""
    m = np.uint64(DF_BUCKETS)
    return np.stack([h % m, (h >> np.uint64(32)) % m]).astype(np.int64)


def shingle_sets(df: DataFrame, text: str, keys: list[str], k: int, min_words: int, tf: bool = False, frequencies: bool = False) -> DataFrame:
    """keys + cls (16 bytes, equal for equal shingle sets), sh (sorted distinct shingle hashes), tf (occurrences).

    Rows whose text is NULL, empty or has fewer than max(min_words, k) words are left out: they have no shingle or are never cases. Of
    each class that a task meets again sh and tf are NULL. With ``tf`` a class is a set with its occurrences. With ``frequencies`` rows
    without cls are added: in sh the buckets of document frequencies (those of the second row from DF_BUCKETS on), in tf their counts.
    """
    least = max(min_words, k)
    src = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        counts, types = np.zeros((2, DF_BUCKETS), np.int64), None
        for b in batches:
            keep, cls, sh, occ = [], [], [], []
            types = [b.column(j).type for j in range(1, b.num_columns)]
            for i, t in enumerate(b.column(0).to_pylist()):
                ws = words(t)
                if len(ws) >= least:
                    h, n = shingles(ws, k)
                    c = xxhash.xxh3_128_digest(h.tobytes() + (n.tobytes() if tf else b""))
                    new = c not in seen
                    if new:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(c)
                    keep.append(i)
                    cls.append(c)
                    sh.append(h if new else None)
                    occ.append(n if new and tf else None)
                    if frequencies:
                        for row, slots in zip(counts, _df_slots(h)):
                            np.add.at(row, slots, 1)
            rest = [b.column(j).take(pa.array(keep, pa.int64())) for j in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cls, pa.binary()), long_lists(sh), long_lists(occ)], names=[*keys, "cls", "sh", "tf"])
        if frequencies and types is not None:
            at = np.flatnonzero(counts)
            one = lambda x: long_lists([x])
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], pa.nulls(1, pa.binary()), one(at), one(counts.ravel()[at])], names=[*keys, "cls", "sh", "tf"])

    return src.mapInArrow(run, _fields(src.select(*keys).schema) + "cls binary, sh array<bigint>, tf array<bigint>")


def classes(sets: DataFrame, *columns: str) -> DataFrame:
    """One row per class: cls and the given columns, which some row of the class has."""
    whole = F.first(F.when(F.col(columns[0]).isNotNull(), F.struct(*columns)), ignorenulls=True)
    return sets.where("cls is not null").groupBy("cls").agg(whole.alias("_s")).select("cls", "_s.*")


def document_shares(sets: DataFrame, documents: int) -> np.ndarray:
    """(2, DF_BUCKETS) shares of the documents, from the counts that ``shingle_sets`` added: at most 2 * DF_BUCKETS rows reach the driver."""
    pair = F.explode(F.arrays_zip("sh", "tf")).alias("p")
    got = sets.where("cls is null").select(pair).groupBy("p.sh").agg(F.sum("p.tf").alias("n")).toArrow()
    out = np.zeros(2 * DF_BUCKETS, np.float32)
    out[got.column("sh").to_numpy()] = got.column("n").to_numpy()
    return (out / max(1, documents)).reshape(2, -1)


def idf(h: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """ln(1 + 1 / share) of shingles. Damped by DF_FLOOR, so that the weighted similarity of texts with common passages stays near the plain one."""
    a, b = _df_slots(h)
    return np.log1p(1 / np.maximum(np.minimum(shares[0][a], shares[1][b]), DF_FLOOR).astype(np.float64))


def signed_classes(one: DataFrame, shares: np.ndarray, blocks: int, rows: int, weighted: bool) -> DataFrame:
    """cls, sh, rid + keys: block keys from consistent weighted samples of TF-IDF weights; code: a fingerprint of CODE_BITS minwise bits; w: the weights.

    A weight is idf * (1 + ln tf) if ``weighted``, else occurrences do not count (as they do not in the plain likeness) and w is NULL.
    """
    shared = one.sparkSession.sparkContext.broadcast(shares)  # a fixed size: 2 * DF_BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, bits = ICWS(blocks, rows), MinHash(CODE_BITS, 1)
        for b in batches:
            keys, codes, ws = [], [], []
            for h, n in zip(list_values(b.column(1)), list_values(b.column(2))):
                w = idf(h, shared.value)
                if weighted:
                    w = w * (1 + np.log(n.astype(np.float64)))
                keys.append(fp(h, w))
                codes.append(bits(h)[1])
                ws.append(w if weighted else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), long_lists(codes), long_lists(keys), pa.array(ws, pa.list_(pa.float64()))], names=["cls", "sh", "rid", "code", "keys", "w"])

    src = one.select("cls", "sh", "tf", F.monotonically_increasing_id().alias("rid"))
    return src.mapInArrow(run, "cls binary, sh array<bigint>, rid bigint, code array<bigint>, keys array<bigint>, w array<double>")


def hamming_radius(threshold: float, bits: int) -> int:
    """Bits in which two fingerprints may differ: the mean (1 - J) / 2 * bits at the threshold and five deviations."""
    p = (1 - threshold) / 2
    return int(p * bits + 5 * (bits * p * (1 - p)) ** 0.5 + 1)


def within_radius(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, bits: int, key: str = "rid") -> DataFrame:
    """The pairs (a, b) whose fingerprints lie within the Hamming radius of a likeness; left and right: (key, code).

    Only the short codes are joined, so that the sets of chance candidates never move.
    """
    x = pairs.join(left.select(F.col(key).alias("a"), F.col("code").alias("ca")), "a").join(right.select(F.col(key).alias("b"), F.col("code").alias("cb")), "b")
    distance = reduce(lambda p, q: p + q, [F.bit_count(F.col("ca")[i].bitwiseXOR(F.col("cb")[i])) for i in range(bits // 64)])
    return x.where(distance <= hamming_radius(threshold, bits)).select("a", "b")


def prefix_pairs(left: DataFrame, right: DataFrame, threshold: float, key: str) -> DataFrame:
    """(a, b): candidates among which every pair of the threshold is, without comparing all; left and right: (key, sh, w), w NULL for weights of one.

    Prefix filtering: the shingles of each set stand from rare to common, counted over both sides. A set's prefix ends where what follows
    weighs less than the threshold's share of it. Alike sets share a shingle of both prefixes, so common passages, which stand last,
    bring no candidates together.
    """
    each = lambda d, side: d.select(F.lit(side).alias("side"), F.col(key).alias("k"), F.explode(F.arrays_zip(F.col("sh").alias("h"), F.coalesce("w", F.transform("sh", lambda _: F.lit(1.0))).alias("w"))).alias("e")).select("side", "k", "e.h", "e.w")
    one = each(left, "a").unionByName(each(right, "b"))
    rows = one.join(one.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h")
    own = Window.partitionBy("side", "k")
    rows = rows.withColumn("total", F.sum("w").over(own)).withColumn("from", F.sum("w").over(own.orderBy(F.desc("n"), F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)))
    # a hair's breadth under the threshold, so that rounding loses nothing
    first = rows.where(F.col("from") >= F.lit(threshold * (1 - 1e-9)) * F.col("total")).where("n > 1")
    a, b = (first.where(F.col("side") == s).select(F.col("k").alias(s), "h") for s in "ab")
    return a.join(b, "h").select("a", "b").distinct()


def needed(sets: DataFrame, pairs: DataFrame, side: str, key: str) -> DataFrame:
    """The classes that stand on one side of the pairs (a written table); where the pairs are many, all classes, of which the join then takes its own."""
    if pairs.count() * 40 > BROADCAST_BYTES:
        return sets
    return sets.join(F.broadcast(pairs.select(F.col(side).alias(key)).distinct()), key, "left_semi")


def verify(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, key: str = "rid") -> DataFrame:
    """(a, b, likeness) of the pairs of classes (a written table) whose Jaccard similarity reaches the threshold; left and right: (key, sh)."""
    left, right = needed(left, pairs, "a", key), needed(right, pairs, "b", key)
    side = lambda d, k: d.select(F.col(key).alias(k), F.col("sh").alias(f"s{k}"), F.size("sh").alias(f"n{k}"))
    x = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b")
    # a cheap bound first: likeness cannot exceed the ratio of the sizes
    x = x.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("double")
    return x.withColumn("likeness", both / (F.col("na") + F.col("nb") - both)).where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def verify_weighted(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """As verify, by the weighted Jaccard similarity: the sum of the lesser weights of each shingle over that of the greater."""

    @F.arrow_udf("double")
    def alike(sa: pa.Array, wa: pa.Array, sb: pa.Array, wb: pa.Array) -> pa.Array:
        weights = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in c]
        out = []
        for a, u, b, v in zip(list_values(sa), weights(wa), list_values(sb), weights(wb)):
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            low = np.minimum(u[i], v[j]).sum()
            out.append(low / (u.sum() + v.sum() - low))
        return pa.array(out, pa.float64())

    side = lambda k: signed.select(F.col("rid").alias(k), F.col("sh").alias(f"s{k}"), F.col("w").alias(f"w{k}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    return x.withColumn("likeness", alike("sa", "wa", "sb", "wb")).where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for each node of an undirected edge table (a, b); comp is the least node of its component.

    Alternating large-star and small-star rounds over the edges (Kiveris et al. 2014): every node's neighbours are
    linked to the least of them until nothing changes, in O(log^2 n) rounds. Each round is a written table; a hub's
    neighbours are never gathered into one row (least and links are joins on the node). The result is a written table.
    """
    with released() as keep:
        e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        seen = None
        for _ in range(max_rounds):
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where(F.col("u") != F.col("v")).distinct()
            m2 = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(m2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
            e = cut(small.where(F.col("u") != F.col("v")).distinct())
            state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == seen:
                break
            seen = state
        else:
            raise RuntimeError("components did not settle")
        return keep(cut(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()))
