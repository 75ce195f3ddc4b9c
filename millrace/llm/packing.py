"""Problem 5: best-fit decreasing over all items at once.

Lengths are whole numbers up to the capacity, so the packing of any number of items follows from the histogram of their
lengths. For each setting one task runs best-fit decreasing on that histogram (at most ``capacity`` entries): a segment tree over
remaining capacities gives the tightest open bin in logarithmic time, and all items of one length that go to bins of
one remaining capacity are placed as one *placement*. The items are then matched to placements by their rank
within their length. The result is that of item-by-item best-fit decreasing over the whole table, ties between items
of one length being broken by their hash, then their id.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import with_token_counts
from millrace.session import cut, small_or_plain, table
from millrace.ship import ship

#: Items of one length that one task ranks, about.
RANK_SHARD = 200_000
_PLACEMENT = "setting string, size bigint, rank_from bigint, items bigint, per_bin bigint, bin_from bigint, offset_from bigint"


class OpenBins:
    """Open bins by remaining capacity: a segment tree of flags, and at each leaf the ranges of bin numbers."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.any = [False] * (2 * self.size)
        self.at: dict[int, deque[tuple[int, int]]] = {}

    def _set(self, r: int, on: bool) -> None:
        i = r + self.size
        self.any[i] = on
        while i > 1:
            i //= 2
            on = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == on:
                break
            self.any[i] = on

    def add(self, r: int, first: int, count: int) -> None:
        if r > 0 and count > 0:
            q = self.at.setdefault(r, deque())
            q.append((first, count))
            if len(q) == 1:
                self._set(r, True)

    def tightest(self, need: int) -> int:
        """The least remaining capacity >= need that an open bin has, or -1."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1

    def take(self, r: int) -> tuple[int, int]:
        q = self.at[r]
        got = q.popleft()
        if not q:
            self._set(r, False)
        return got

    def put_back(self, r: int, first: int, count: int) -> None:
        q = self.at.setdefault(r, deque())
        q.appendleft((first, count))
        if len(q) == 1:
            self._set(r, True)


def best_fit_decreasing(capacity: int, histogram: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, rank_from, items, per_bin, bin_from, offset) and the number of bins.

    Items rank_from .. rank_from + items - 1 of that length go, per_bin to a bin, to bins bin_from onwards, the first at
    ``offset`` in its bin.
    """
    bins, made, out = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = bins.tightest(length)
            if r < 0:  # a new bin is filled with this length before the next is opened
                r = capacity
                first, count = made, -(-left // (capacity // length))
                made += count
            else:
                first, count = bins.take(r)
            per = r // length
            full = min(count, left // per)
            if full:
                out.append((length, rank, full * per, per, first, capacity - r))
                bins.add(r - per * length, first, full)
                left, rank, first, count = left - full * per, rank + full * per, first + full, count - full
            if count and 0 < left < per:
                out.append((length, rank, left, left, first, capacity - r))
                bins.add(r - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                bins.put_back(r, first, count)
    return out, made


def pack(items: DataFrame, id_col: str, size_col: str, settings: DataFrame) -> DataFrame:
    """(setting, id, piece, from, size, bin, offset): every item placed in bins of each setting's capacity.

    settings: (setting, capacity), one row each, of any number; rows without a setting or a positive capacity are left out, and of
    repeated settings the largest capacity holds. An item larger than the capacity, and no other, is split: into pieces of the full
    capacity and a last piece. Items of size 0 or NULL need no room: they come with piece 0 and a NULL bin. Repeated ids are items of
    their own. No settings or no items give an empty result.
    """
    ship(items.sparkSession)
    base = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("total"))
    one = settings.where("setting is not null and capacity > 0").groupBy("setting").agg(F.max(F.col("capacity").cast("long")).alias("cap"))
    every = one.agg(F.collect_list(F.struct("setting", "cap")).alias("s"))  # one row: each item meets each setting in the result anyway
    each = base.crossJoin(F.broadcast(every)).select("id", "total", F.explode("s").alias("s")).select("s.setting", "s.cap", "id", "total")
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / F.col("cap")).cast("int") - 1, F.lit(0)))))
    pieces = pieces.withColumn("from", F.col("piece") * F.col("cap")).withColumn("size", F.least(F.col("cap"), F.col("total") - F.col("from"))).drop("total")
    hist = cut(pieces.where("size > 0").groupBy("setting", "cap", "size").agg(F.count(F.lit(1)).alias("n")))

    def best_fit(h: pd.DataFrame) -> pd.DataFrame:
        made = best_fit_decreasing(int(h["cap"].iloc[0]), dict(zip(h["size"].tolist(), h["n"].tolist())))[0]
        return pd.DataFrame([(h["setting"].iloc[0], *p) for p in made], columns=[f.split()[0] for f in _PLACEMENT.split(", ")])

    plan = cut(hist.groupBy("setting").applyInPandas(best_fit, _PLACEMENT))  # a group has at most ``capacity`` rows
    most = hist.agg(F.max("n")).first()[0] or 1
    # a shard is a range of hashes, so the order within a length is that of (hash, id, piece) however many shards there are
    bits = max(1, (most // RANK_SHARD).bit_length())
    key = ["setting", "size", "shard"]
    sized = pieces.withColumn("h", F.xxhash64("id", "piece")).withColumn("shard", F.shiftright("h", 64 - bits))
    before = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = cut(before.select(*key, F.coalesce(F.sum("n").over(Window.partitionBy("setting", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    ranked = sized.withColumn("in_shard", F.row_number().over(Window.partitionBy(*key).orderBy("h", "id", "piece")) - 1)
    ranked = ranked.join(small_or_plain(before, 60), key).withColumn("rank", F.col("in_shard") + F.col("before"))
    p = small_or_plain(plan, 80)
    at = ranked.alias("i").join(p.alias("p"), (F.col("i.setting") == F.col("p.setting")) & (F.col("i.size") == F.col("p.size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("items")), "left")
    k = F.col("rank") - F.col("rank_from")
    return at.select(
        "i.setting", "id", "piece", "from", "i.size",
        (F.col("bin_from") + F.floor(k / F.col("per_bin"))).alias("bin"),
        (F.col("offset_from") + F.pmod(k, F.col("per_bin")) * F.col("i.size")).alias("offset"),
    )


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """train packed for every setting; a re-sent row (same id) is packed once, as it was added last."""
    settings = table(spark, sf_dir, "pack_settings").select("setting", F.col("max_seq_length").alias("capacity"))
    train = table(spark, sf_dir, "train").groupBy("id").agg(F.max_by("text", F.struct("added_at", "text")).alias("text"))
    return pack(cut(with_token_counts(train, "text", ["id"])), "id", "n_tokens", settings), settings


def p5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p5_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per setting: sequences, tokens, the share of room used, and the least number of sequences that could hold the tokens."""
    got, settings = _packed(spark, sf_dir)
    used = got.where("bin is not null").groupBy("setting").agg((F.max("bin") + 1).alias("sequences"), F.sum("size").alias("tokens"))
    used = used.join(settings.groupBy("setting").agg(F.max(F.col("capacity").cast("long")).alias("cap")), "setting")
    return used.select("setting", F.col("cap").alias("max_seq_length"), "sequences", "tokens", F.ceil(F.col("tokens") / F.col("cap")).alias("least_sequences"), (F.col("tokens") / (F.col("sequences") * F.col("cap"))).alias("fill"))
