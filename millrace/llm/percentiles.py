"""Problem 1: percentiles of very large numeric columns by radix selection.

A double is mapped to a 64-bit integer of the same order. Four passes histogram successive 16-bit digits per group; each
pass follows, for each target rank, only the digit that contains it. A pass moves at most 65 536 counts per group and
followed prefix, whatever the number of values, and a group with most of the rows is summed before the shuffle. The
counts of separate partitions or days are added, so their summaries can be made apart and combined.

Stopping after ``bits`` bits bounds the error: the result then lies in the same interval of 2**(64 - bits) neighbouring
doubles as the exact value, a relative error of at most 2**-(bits - 12) for normal numbers. All 64 bits give it exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import cut, small_or_plain, table
from millrace.ship import ship

DIGIT = 16
PERMILLES = (10, 50, 250, 500, 750, 950, 990)
MEASURES = ("predicted_value", "true_value")


def _order_keys(v: pa.Array) -> pa.Array:
    """Order-preserving integers (signed, as a bigint); NULL for NULL and NaN; -0.0 counts as 0.0."""
    x = v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    u = x.view(np.int64)
    key = np.where(u < 0, u ^ np.int64(0x7FFFFFFFFFFFFFFF), u)
    return pa.array(key, mask=np.isnan(x) | np.asarray(pc.is_null(v)))


def _key_values(k: pa.Array) -> pa.Array:
    """The doubles of order keys."""
    u = k.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(np.where(u < 0, u ^ np.int64(0x7FFFFFFFFFFFFFFF), u).view(np.float64))


def order_key(c: Column | str) -> Column:
    @F.arrow_udf("bigint")
    def keys(v: pa.Array) -> pa.Array:
        return _order_keys(v)

    return keys(F.col(c) if isinstance(c, str) else c)


def key_value(c: Column | str) -> Column:
    @F.arrow_udf("double")
    def values(k: pa.Array) -> pa.Array:
        return _key_values(k)

    return values(F.col(c) if isinstance(c, str) else c)


def _keys_long(df: DataFrame, groups: list[str], measures: Sequence[str], extra: list[str] | None = None) -> DataFrame:
    """groups + measure number m + key, one row per usable value."""
    base = df.select(*groups, *(extra or []), *[order_key(F.col(m).cast("double")).alias(f"_k{i}") for i, m in enumerate(measures)])
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"_k{i}").alias("key")) for i in range(len(measures))]))
    return base.select(*groups, *(extra or []), values.alias("v")).select(*groups, *(extra or []), "v.m", "v.key").where("key is not null")


#: The order keys of the infinities; no other value but NaN, which is left out, lies beyond them.
_INFINITY, _MINUS_INFINITY = 0x7FF0000000000000, 0x7FF0000000000000 ^ -1


def _follow(counts: DataFrame, groups: list[str], want: DataFrame | None, permilles: Sequence[int]) -> DataFrame:
    """From counts (groups, m, prefix, digit, n) the digit that holds each target rank, and the rank left within it."""
    part = Window.partitionBy(*groups, "m", "prefix")
    c = counts.withColumn("upto", F.sum("n").over(part.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
    if want is None:
        c = c.withColumn("total", F.sum("n").over(part))
        ranks = F.array(*[F.struct(F.lit(p).alias("permille"), F.greatest(F.lit(1), F.floor((F.col("total") * p + 999) / 1000)).cast("long").alias("rank")) for p in permilles])
        c = c.withColumn("t", F.explode(ranks)).select("*", "t.permille", "t.rank").drop("t")
    else:
        same = [F.col(f"c.{g}").eqNullSafe(F.col(f"w.{g}")) for g in groups] + [F.col("c.m") == F.col("w.m"), F.col("c.prefix") == F.col("w.prefix")]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        c = c.alias("c").join(want.alias("w"), cond).select("c.*", "w.permille", "w.rank", "w.total")
    return c.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(
        *groups, "m", "permille", "total", (F.col("prefix") * (1 << DIGIT) + F.col("digit")).alias("prefix"), (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")
    )


def radix_percentiles(df: DataFrame, groups: list[str], measures: Sequence[str], permilles: Sequence[int] = PERMILLES, bits: int = 64, by: str | None = None) -> DataFrame:
    """groups, measure, permille, n, value, max_relative_error: the value at rank ceil(permille * n / 1000), at least 1.

    ``by`` names a column (such as the day) by which the histograms are made apart before they are added; the result does
    not depend on it. NULL and NaN are not values; infinities are, at the ends. NULL group keys form a group. Groups
    without a value, and empty tables, give no row. Ties and repeated rows count each.
    """
    if bits not in (16, 32, 48, 64):
        raise ValueError("bits: 16, 32, 48 or 64")
    ship(df.sparkSession)
    keys = _keys_long(df, groups, measures, [by] if by else [])
    want = None
    for level in range(bits // DIGIT):
        down = 64 - DIGIT * (level + 1)
        digit = F.shiftright("key", down).bitwiseAND(F.lit((1 << DIGIT) - 1)) if level else F.shiftright("key", down)
        if level == 0:
            # the first digit is signed, so that negative keys come first
            here = keys.withColumn("prefix", F.lit(0).cast("long")).withColumn("digit", digit)
        else:
            followed = want.select(*groups, "m", "prefix").distinct()
            cond = (F.col("k.m") == F.col("f.m")) & (F.shiftright("key", down + DIGIT) == F.col("f.prefix"))
            for g in groups:
                cond = cond & F.col(f"k.{g}").eqNullSafe(F.col(f"f.{g}"))
            here = keys.alias("k").join(small_or_plain(cut(followed), 64).alias("f"), cond).select("k.*", "f.prefix").withColumn("digit", digit)
        counts = here.groupBy(*groups, *([by] if by else []), "m", "prefix", "digit").agg(F.count(F.lit(1)).alias("n"))
        if by:
            counts = counts.groupBy(*groups, "m", "prefix", "digit").agg(F.sum("n").alias("n"))
        want = cut(_follow(counts, groups, want, permilles))
    return _finish(want, groups, measures, bits)


def _finish(want: DataFrame, groups: list[str], measures: Sequence[str], bits: int) -> DataFrame:
    """The middle of each bucket; a bucket that reaches past an infinity holds nothing but it, and the bucket of zero gives zero."""
    low = F.shiftleft("prefix", 64 - bits) if bits < 64 else F.col("prefix")
    mid = F.when(low == 0, low).otherwise(low + F.lit((1 << (63 - bits)) if bits < 64 else 0))
    mid = F.greatest(F.least(mid, F.lit(_INFINITY)), F.lit(_MINUS_INFINITY))
    names = F.array(*[F.lit(m) for m in measures])
    return want.select(*groups, F.element_at(names, F.col("m") + 1).alias("measure"), "permille", F.col("total").alias("n"), key_value(mid).alias("value"), F.lit(0.0 if bits == 64 else 2.0 ** -(bits - 12)).alias("max_relative_error"))


def digit_summary(df: DataFrame, groups: list[str], measures: Sequence[str], bits: int = 32) -> DataFrame:
    """A summary to keep per day or partition: groups, m, bucket (the first ``bits`` bits of the order key), n.

    Summaries of the same ``bits`` are combined by ``merge_summaries`` in any order and grouping.
    """
    ship(df.sparkSession)
    return _keys_long(df, groups, measures).groupBy(*groups, "m", F.shiftright("key", 64 - bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_summaries(summaries: DataFrame, groups: list[str]) -> DataFrame:
    """The summary of all rows together."""
    return summaries.groupBy(*groups, "m", "bucket").agg(F.sum("n").alias("n"))


def summary_percentiles(summary: DataFrame, groups: list[str], measures: Sequence[str], permilles: Sequence[int] = PERMILLES, bits: int = 32) -> DataFrame:
    """The same columns as radix_percentiles, from a summary, by following its digits of 16 bits from the first on."""
    want = None
    for level in range(bits // DIGIT):
        down = bits - DIGIT * (level + 1)
        prefix = F.shiftright("bucket", down + DIGIT) if level else F.lit(0).cast("long")
        digit = F.shiftright("bucket", down).bitwiseAND(F.lit((1 << DIGIT) - 1)) if level else F.shiftright("bucket", down)
        counts = summary.groupBy(*groups, "m", prefix.alias("prefix"), digit.alias("digit")).agg(F.sum("n").alias("n"))
        if want is not None:
            cond = (F.col("k.m") == F.col("f.m")) & (F.col("k.prefix") == F.col("f.prefix"))
            for g in groups:
                cond = cond & F.col(f"k.{g}").eqNullSafe(F.col(f"f.{g}"))
            counts = counts.alias("k").join(want.select(*groups, "m", "prefix").distinct().alias("f"), cond, "left_semi")
        want = cut(_follow(counts, groups, want, permilles))
    return _finish(want, groups, measures, bits)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of both values for each family and arm."""
    p = table(spark, sf_dir, "predictions").select("family", "arm", *MEASURES)
    return radix_percentiles(p, ["family", "arm"], MEASURES).drop("max_relative_error")


def p1_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every day of evaluation (scope day) and for all days put together (scope all, day NULL), within a relative error of 2**-20.

    Both come from the same daily summaries of 32 bits; the records are read once.
    """
    p = table(spark, sf_dir, "predictions").select("family", "arm", F.substring("evaluated_at", 1, 10).alias("day"), *MEASURES)
    days = cut(digit_summary(p, ["day", "family", "arm"], MEASURES))
    each = summary_percentiles(days, ["day", "family", "arm"], MEASURES).withColumn("scope", F.lit("day"))
    whole = summary_percentiles(merge_summaries(days, ["family", "arm"]), ["family", "arm"], MEASURES).withColumn("scope", F.lit("all")).withColumn("day", F.lit(None).cast("string"))
    return each.unionByName(whole).select("scope", "day", "family", "arm", "measure", "permille", "n", "value")


P1_SQL = """
WITH v AS (
  SELECT family, arm, 'predicted_value' AS measure, predicted_value + 0.0 AS x FROM predictions WHERE predicted_value IS NOT NULL AND NOT isnan(predicted_value)
  UNION ALL
  SELECT family, arm, 'true_value', true_value + 0.0 FROM predictions WHERE true_value IS NOT NULL AND NOT isnan(true_value)),
r AS (SELECT *, row_number() OVER (PARTITION BY family, arm, measure ORDER BY x) AS rn, count(*) OVER (PARTITION BY family, arm, measure) AS n FROM v),
q AS (SELECT unnest([10, 50, 250, 500, 750, 950, 990]) AS permille)
SELECT family, arm, measure, CAST(permille AS INTEGER) AS permille, n, x AS value FROM r JOIN q ON rn = greatest(1, (n * permille + 999) // 1000)
"""

#: The exact order statistics, then the middle of their bucket: 20 bits after the leading one, found from the exponent e.
P1_BY_DAY_SQL = """
WITH v AS (
  SELECT substr(evaluated_at, 1, 10) AS day, family, arm, 'predicted_value' AS measure, predicted_value + 0.0 AS x FROM predictions WHERE predicted_value IS NOT NULL AND NOT isnan(predicted_value)
  UNION ALL
  SELECT substr(evaluated_at, 1, 10), family, arm, 'true_value', true_value + 0.0 FROM predictions WHERE true_value IS NOT NULL AND NOT isnan(true_value)),
s AS (SELECT 'day' AS scope, day, family, arm, measure, x FROM v UNION ALL SELECT 'all', NULL, family, arm, measure, x FROM v),
r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY scope, day, family, arm, measure) AS n FROM s WINDOW w AS (PARTITION BY scope, day, family, arm, measure ORDER BY x)),
q AS (SELECT unnest([10, 50, 250, 500, 750, 950, 990]) AS permille),
g AS (SELECT scope, day, family, arm, measure, CAST(permille AS INTEGER) AS permille, n, x, CASE WHEN x <> 0 AND isfinite(x) THEN floor(log2(abs(x))) END AS e0 FROM r JOIN q ON rn = greatest(1, (n * permille + 999) // 1000)),
e AS (SELECT *, CASE WHEN pow(2.0::DOUBLE, e0) > abs(x) THEN e0 - 1 WHEN pow(2.0::DOUBLE, e0 + 1) <= abs(x) THEN e0 + 1 ELSE e0 END AS e FROM g)
SELECT scope, day, family, arm, measure, permille, n, CASE WHEN e IS NULL THEN x WHEN x > 0 THEN (floor(abs(x) / pow(2.0::DOUBLE, e - 20)) + 0.5::DOUBLE) * pow(2.0::DOUBLE, e - 20)
 ELSE -((floor(abs(x) / pow(2.0::DOUBLE, e - 20)) + 0.5::DOUBLE) * pow(2.0::DOUBLE, e - 20) - pow(2.0::DOUBLE, e - 52)) END AS value FROM e
"""
