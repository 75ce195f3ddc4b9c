"""Problem 8: drawing records so that each source supplies its target share of all tokens.

Sainte-Lague apportionment, twice: blocks of equal token numbers go to sources by the highest quotients share / (2k + 1),
and a source's blocks to its shards likewise. That gives a whole number of blocks per shard. Within a shard the records stand in
a seeded random order, and a seeded run of its blocks (cyclic, so that the drawn tokens miss the quota by one record at
most on either end) is used once more than the others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import with_token_counts
from millrace.session import cut, small_or_plain, table
from millrace.ship import ship

BLOCK_TOKENS = 256
#: Tokens of a shard, which is what one task orders; a source has as many shards as that takes.
SHARD_TOKENS = 4_000_000
_PLAN = "source string, shard int, n_blocks bigint, shard_size bigint, base int, extra bigint, inc bigint"


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats for each weight by the highest quotients w / (2k + 1), none above its cap; ties go to the earlier weight.

    The divisor is bisected until few seats are left, which are then given one by one, so the number of seats may be
    large. If the caps hold fewer seats, all caps are filled.
    """
    w = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0)
    cap = np.asarray(caps if caps is not None else [seats] * len(w), float)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    if not len(w) or w.sum() <= 0 or seats <= 0:
        return [0] * len(w)
    if cap.sum() <= seats:
        return [int(c) for c in cap]
    at = lambda d: np.minimum(cap, np.floor(w / d + 0.5))
    lo, hi = w.max() / (2 * seats + 4), 4 * w.sum() + 1  # too many seats, too few
    while at(lo).sum() < seats:
        lo /= 2
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if at(mid).sum() > seats else (lo, mid)
    q = [int(x) for x in at(hi * (1 + 1e-12))]
    left = seats - sum(q)
    heap = [(-w[i] / (2 * q[i] + 1), i) for i in range(len(w)) if q[i] < cap[i]]
    heapq.heapify(heap)
    while left and heap:
        _, i = heapq.heappop(heap)
        q[i] += 1
        left -= 1
        if q[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * q[i] + 1), i))
    return q


def mix(records: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, seed: int = 1, total: int | None = None, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares). drawn: id, source, size, copies (1 .. max_repeats), for the records that are used. shares: one row per source of either table.

    Without ``total`` the mixture is the largest that meets every target share of the sources that have records; their
    shares are taken relative to each other; a source with few tokens for its share thus limits the whole. With a larger ``total``, sources at their limit stay there and others fill
    up. Records without size or source, or of an unlisted source, are not drawn. Target rows without a source, a
    positive share or repeats draw nothing; of repeated target rows the shares add up and the least limit holds.
    """
    spark = records.sparkSession
    ship(spark)
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("reps")).collect()  # the listed sources
    base = records.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"))
    listed = cut(spark.createDataFrame([(r["source"],) for r in want], "source string"))
    have = base.join(small_or_plain(listed, 60), "source").groupBy("source").agg(F.sum("size").alias("n")).collect()
    tokens = {r["source"]: r["n"] for r in have if r["n"]}
    use = sorted((r["source"], float(r["share"] or 0), int(r["reps"] or 0)) for r in want if r["source"] in tokens and (r["share"] or 0) > 0 and (r["reps"] or 0) > 0)
    quota: list[int] = []
    if use:
        whole = sum(share for _, share, _ in use)
        feasible = min(tokens[s] * r * whole / share for s, share, r in use)
        goal = feasible if total is None else total
        quota = sainte_lague([share for _, share, _ in use], max(1, int(goal / block)), None if total is None else [tokens[s] * r // block for s, _, r in use])
    sources = cut(spark.createDataFrame([(s, -(-tokens[s] // SHARD_TOKENS), r, q, tokens[s]) for (s, _, r), q in zip(use, quota)], "source string, shards bigint, reps int, quota bigint, tokens bigint"))
    sized = base.where("size > 0").join(small_or_plain(sources.select("source", "shards"), 60), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("shards")).cast("int")).drop("shards")
    shards = sized.groupBy("source", "shard").agg(F.sum("size").alias("n")).join(small_or_plain(sources, 90), "source").withColumn("inc", F.shiftright(F.xxhash64(F.lit(seed + 2), "source", "shard"), 1))

    def apportion(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("shard")
        n = g["n"].to_numpy(np.int64)
        blocks = np.maximum(1, np.rint(n / block)).astype(np.int64)
        reps, room = int(g["reps"].iloc[0]), int(blocks.sum())
        seats = min(room * reps, round(int(g["quota"].iloc[0]) * block * room / int(g["tokens"].iloc[0])))
        got = np.array(sainte_lague(n, seats, blocks * reps), np.int64)
        return pd.DataFrame({"source": g["source"], "shard": g["shard"], "n_blocks": blocks, "shard_size": n, "base": (got // blocks).astype(np.int32), "extra": got % blocks, "inc": g["inc"].to_numpy(np.int64) % blocks})

    plan = cut(shards.groupBy("source").applyInPandas(apportion, _PLAN))  # a group has one row per shard
    p = small_or_plain(plan, 80)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(p, ["source", "shard"])
    # exact in 128 bits: before * n_blocks can pass 2^63 in large shards
    placed = placed.withColumn("blk", F.floor(F.col("before").cast("decimal(20,0)") * F.col("n_blocks").cast("decimal(18,0)") / F.col("shard_size").cast("decimal(20,0)")).cast("long"))
    turn = F.pmod(F.col("blk") + F.col("inc"), F.col("n_blocks"))
    drawn = cut(placed.withColumn("copies", F.col("base") + F.when(turn < F.col("extra"), 1).otherwise(0)).where("copies > 0").select("id", "source", "size", "copies"))
    got = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    all_ = base.groupBy("source").agg(F.sum("size").alias("available"))
    asked = spark.createDataFrame([(r["source"], float(r["share"] or 0), int(r["reps"] or 0)) for r in want], "source string, target_share double, max_repeats int")
    drawn_tokens = drawn.agg(F.sum(F.col("size") * F.col("copies")).alias("drawn_tokens"))
    out = all_.join(asked, all_.source.eqNullSafe(asked.source), "full").select(F.coalesce(all_.source, asked.source).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("available", F.lit(0)).alias("available"))
    out = out.join(got, "source", "left").crossJoin(F.broadcast(drawn_tokens))  # one row on the right
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return drawn, out.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("drawn_tokens").cast("double")), F.lit(0.0)).alias("reached_share"), "max_repeats", zero("most_copies"), zero("records"), zero("tokens"), "available")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(with_token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]))
    return mix(sizes, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]
