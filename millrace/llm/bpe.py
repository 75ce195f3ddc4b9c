"""Problem 7: byte-level BPE over a whole corpus by an index of pair occurrences."""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import table
from millrace.ship import ship

#: Where the public vocabularies lie; the driver reads the file and broadcasts the ranks (about 50 000 entries).
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the public pre-tokenisation pattern that belongs to the byte_bpe vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens that a Python worker remembers, and the longest that it remembers.
CACHE_WORDS, CACHE_CHARS = 200_000, 64


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairIndexBpe:
    """Encodes many pre-tokens at once.

    All symbols of the new pre-tokens of a batch stand in one array. An index maps the rank of each mergeable pair to
    all positions where it occurs; a heap holds the active ranks. The least active rank is applied at all of its
    positions, left to right, and the lists of the pairs that arise or vanish on both sides are updated. Pre-tokens are
    independent, so this equals the usual one-at-a-time rule as long as a merge makes no pair of a lower rank than its
    own; a pre-token where it does is encoded by that rule instead.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def rank(self, a: int, b: int) -> int:
        """The id of the token that a and b merge to, or -1."""
        if a < 0 or b < 0:
            return -1
        r = self.pair.get((a, b))
        if r is None:
            r = self.pair[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def one_by_one(self, raw: bytes) -> list[int]:
        """The usual rule for one pre-token: the leftmost pair of the least rank is merged until none is left; by a heap, so that a long one costs n log n."""
        sym = [self.byte[c] for c in raw]
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        ahead = lambda i: self.rank(sym[i], sym[nxt[i]]) if i >= 0 and nxt[i] < n else -1
        heap = [(r, i) for i in range(n) if (r := ahead(i)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if sym[i] < 0 or ahead(i) != r:
                continue  # an earlier merge took one of the two
            j = nxt[i]
            sym[i], sym[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if (q := ahead(k)) >= 0:
                    heapq.heappush(heap, (q, k))
        return [x for x in sym if x >= 0]

    def encode_words(self, ws: list[str]) -> list[list[int]]:
        raws = [w.encode("utf-8", "surrogatepass") for w in ws]
        sym: list[int] = [-1]
        start = []
        for raw in raws:
            start.append(len(sym))
            sym.extend(self.byte[c] for c in raw)
            sym.append(-1)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        index: dict[int, list[int]] = {}
        for i in range(len(sym) - 1):
            r = self.rank(sym[i], sym[i + 1])
            if r >= 0:
                index.setdefault(r, []).append(i)
        active = list(index)
        heapq.heapify(active)
        odd: set[int] = set()
        while active:
            r = heapq.heappop(active)
            for i in sorted(set(index.pop(r, ()))):
                j = nxt[i]
                if sym[i] < 0 or j >= len(sym) or self.rank(sym[i], sym[j]) != r:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = r, -2
                nxt[i] = k = nxt[j]
                prv[k] = i
                for left, right in ((prv[i], i), (i, k)):
                    q = self.rank(sym[left], sym[right])
                    if q >= 0:
                        if q < r:
                            odd.add(i)
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(left)
        out = []
        bad = sorted(odd)
        for n, raw in enumerate(raws):
            i, ids = start[n], []
            k = bisect_left(bad, i)
            if k < len(bad) and bad[k] < i + len(raw):
                out.append(self.one_by_one(raw))
                continue
            while sym[i] != -1:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for None and empty text. Text that looks like a special token is ordinary text."""
        parts = [self.split(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for p in parts for w in p if w not in self.known))
        made = dict(zip(new, self.encode_words(new)))
        known = self.known
        out = []
        for p in parts:
            ids: list[int] = []
            for w in p:
                ids += known.get(w) or made[w]
            out.append(ids)
        if len(known) + len(made) > CACHE_WORDS:
            known.clear()
        for w, ids in made.items():
            if len(known) >= CACHE_WORDS:
                break
            if len(w) <= CACHE_CHARS:
                known[w] = ids
        return out


_encoders: dict[str, PairIndexBpe] = {}


def _encoder(name: str, ranks: Broadcast) -> PairIndexBpe:
    """One encoder for each Python worker and vocabulary; it keeps the pre-tokens it has met."""
    if name not in _encoders:
        _encoders[name] = PairIndexBpe(ranks.value)
    return _encoders[name]


def _batches(column: pa.Array, rows: int = 2000) -> Iterator[list[str | None]]:
    for i in range(0, len(column), rows):
        yield column.slice(i, rows).to_pylist()


def with_token_ids(df: DataFrame, text_col: str, keys: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keys + ids (array<int>) of every row. NULL and empty text give an empty list; rows are neither joined nor shuffled.

    Repeated rows are encoded each; other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(name, ranks)
        for b in batches:
            ids = [x for part in _batches(b.column(0)) for x in enc.encode_batch(part)]
            off = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=off[1:])
            flat = pa.array(np.fromiter((i for x in ids for i in x), np.int32, off[-1]))
            yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(1, b.num_columns)], pa.ListArray.from_arrays(pa.array(off), flat)], names=[*keys, "ids"])

    src = df.select(F.col(text_col).alias("_text"), *keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{fields}, ids array<int>")


def with_token_counts(df: DataFrame, text_col: str, keys: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keys + n_tokens (long) of every row; 0 for NULL and empty text."""
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(name, ranks)
        for b in batches:
            n = [len(x) for part in _batches(b.column(0)) for x in enc.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(1, b.num_columns)], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    src = df.select(F.col(text_col).alias("_text"), *keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{fields}, n_tokens bigint")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_ids(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, records and records without any token by source."""
    n = with_token_counts(table(spark, sf_dir, "documents"), "text", ["source"])
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"), F.count_if(F.col("n_tokens") == 0).alias("without_tokens"))
