"""Sampling as a pure function of a seed and a key: prefixes, reservations, coins, choices, cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import hash01, hash_key


def seeded_position(df: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int, out: str = "position") -> DataFrame:
    """df with its place (from 1) in the seeded permutation of each group; prefixes of it are nested samples."""
    w = Window.partitionBy(*groups).orderBy(hash_key(seed, *groups, *key), *key) if groups else Window.orderBy(hash_key(seed, *key), *key)
    return df.withColumn(out, F.row_number().over(w))


def nested_sample(df: DataFrame, groups: Sequence[str], key: Sequence[str], n: Column | int, seed: int) -> DataFrame:
    """n rows of each group; a smaller n gives a subset."""
    return seeded_position(df, groups, key, seed, "_pos").where(F.col("_pos") <= n).drop("_pos")


def reserve(df: DataFrame, groups: Sequence[str], unit: Sequence[str], fraction: float, seed: int, out: str = "reserved") -> DataFrame:
    """A flag for floor(fraction * units) of each group's units; all rows of a unit share it, whatever else they differ in."""
    units = seeded_position(df.select(*groups, *unit).distinct(), groups, unit, seed, "_pos")
    units = units.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*groups))).withColumn(out, F.col("_pos") <= F.floor(F.col("_n") * fraction)).drop("_pos", "_n")
    return df.join(units, [*groups, *unit], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def sample_fraction(df: DataFrame, groups: Sequence[str], unit: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Units with a flag for round-half-even(fraction * units) of them."""
    units = seeded_position(df.select(*groups, *unit).distinct(), groups, unit, seed, "_pos")
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    return units.withColumn("_n", n).select(*groups, *unit, (F.col("_pos") <= F.rint(F.col("_n") * fraction)).alias("holdout"))


def coin(p: Column | float, seed: int, *key: Column | str) -> Column:
    """True with probability p, by the key's hash."""
    return hash01(seed, *key) < p


def head_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def head_or_tail(df: DataFrame, groups: Sequence[str], first: Column, other: Column, order: str, n: int) -> DataFrame:
    """The first n rows of one kind by group; where a group has none, the last n of another kind."""
    x = df.where(first | other).withColumn("_f", first)
    x = x.withColumn("_any", F.max(F.col("_f").cast("int")).over(Window.partitionBy(*groups)) == 1)
    sort = F.when(F.col("_any"), F.col(order)).otherwise(-F.col(order))
    x = x.where(F.col("_f") == F.col("_any"))
    return x.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(sort))).where(F.col("_k") <= n).drop("_k", "_f", "_any")


def round_robin(df: DataFrame, groups: Sequence[str], key: str, slots: int, seed: int) -> DataFrame:
    """groups, slot, key: slots 0 .. slots-1 take the keys in turn, each lap in a new seeded order, so all keys come equally often."""
    x = df.select(*groups, key).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*groups)))
    laps = x.withColumn("lap", F.explode(F.sequence(F.lit(0), F.floor((F.lit(slots - 1)) / F.col("n")).cast("int"))))
    w = Window.partitionBy(*groups, "lap").orderBy(hash_key(seed, *groups, "lap", key), key)
    return laps.withColumn("slot", (F.col("lap") * F.col("n") + F.row_number().over(w) - 1).cast("int")).where(F.col("slot") < slots).select(*groups, "slot", key)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first by an order."""
    return head_per_group(df, key, order, 1)
