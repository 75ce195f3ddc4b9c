"""Ranks and exact quantiles that do not gather a group in one task.

Equal values are counted first. The counted values are ordered by range partitioning on (group, value), so a group that holds most of the
rows lies in as many slices as its values fill, and a value that recurs is one row. Ranks are running counts within (group, slice)
plus the counts of the group's slices before. There are as many slices as shuffle partitions, which a cluster sets by its data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: Slices of a rank table; None leaves it to the session's shuffle partitions.
SLICES: int | None = None


def same(a: str, b: str, groups: Sequence[str]) -> Column:
    """Null-safe equality of the group keys of two aliased frames."""
    return reduce(lambda p, q: p & q, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups], F.lit(True))


def rank_table(df: DataFrame, groups: Sequence[str], value: str, slices: int | None = None) -> DataFrame:
    """groups, value, c (rows with it), upto (rows up to and with it), n (rows of the group). NULL and NaN values are left out."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = v.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("c"))
    n = slices or SLICES
    # written, so that both readers below see the same slices
    ranged = cut(counts.repartitionByRange(*([n] if n else []), *groups, value).withColumn("slice", F.spark_partition_id()))
    placed = ranged.withColumn("upto", F.sum("c").over(Window.partitionBy(*groups, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    per = ranged.groupBy(*groups, "slice").agg(F.sum("c").alias("c"))
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    per = per.select(*groups, "slice", F.coalesce(F.sum("c").over(over.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(over).alias("n"))
    j = placed.alias("a").join(per.alias("b"), same("a", "b", groups) & (F.col("a.slice") == F.col("b.slice")))
    return j.select(*[F.col(f"a.{g}") for g in groups], F.col(f"a.{value}"), "a.c", (F.col("a.upto") + F.col("b.before")).alias("upto"), "b.n")


def average_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """groups, value, rank: the mean of the ranks that the ties of a value share."""
    r = rank_table(df, groups, value)
    return r.select(*groups, value, (F.col("upto").cast("double") - (F.col("c") - 1).cast("double") / 2.0).alias("rank"))


def quantile_aggregate(value: str, p: float, cond: Column | None = None) -> Column:
    """An aggregate over a group of a rank table: its quantile, with linear interpolation between neighbouring order statistics."""
    h = (F.col("n") - 1).cast("double") * p
    k, here = F.floor(h), F.lit(True) if cond is None else cond
    at = lambda rank: F.max(F.when(here & (rank <= F.col("upto")) & (rank > F.col("upto") - F.col("c")), F.col(value).cast("double")))
    rest = F.max(F.when(here, h - k))
    return F.when(rest > 0, at(k + 1) * (F.lit(1.0) - rest) + at(k + 2) * rest).otherwise(at(k + 1))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """groups, prob, quantile, one row for each."""
    q = rank_table(df, groups, value).groupBy(*groups).agg(*[quantile_aggregate(value, p).alias(f"_q{i}") for i, p in enumerate(probs)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col(f"_q{i}").alias("quantile")) for i, p in enumerate(probs)]))
    return q.select(*groups, rows.alias("_r")).select(*groups, "_r.prob", "_r.quantile").where("quantile is not null")


def quantile_columns(df: DataFrame, groups: Sequence[str], value: str, named: Mapping[str, float]) -> DataFrame:
    """groups and one column for each named quantile."""
    return rank_table(df, groups, value).groupBy(*groups).agg(*[quantile_aggregate(value, p).alias(k) for k, p in named.items()])


def quantiles_of(df: DataFrame, groups: Sequence[str], wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """groups and one column for each wanted (expression, prob): all in one rank table. Groups without any value are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_m"), c.cast("double").alias("_v")) for i, (c, _) in enumerate(wanted.values())]))
    long = df.select(*groups, each.alias("_e")).select(*groups, "_e._m", "_e._v")
    r = rank_table(long, [*groups, "_m"], "_v")
    return r.groupBy(*groups).agg(*[quantile_aggregate("_v", p, F.col("_m") == i).alias(k) for i, (k, (_, p)) in enumerate(wanted.items())])


def with_ranks(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the average rank of its value; rows with equal values share it, rows without one get NULL."""
    r = average_ranks(df, groups, value)
    j = df.alias("d").join(r.alias("r"), same("d", "r", groups) & (F.col(f"d.{value}") == F.col(f"r.{value}")), "left")
    return j.select("d.*", F.col("r.rank").alias(out))
