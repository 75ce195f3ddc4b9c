"""Descriptive aggregates, error metrics, correlation, AUROC, effect sizes, bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from millrace.functions.exprs import abs_err, finite, rel_err
from millrace.operators.ranks import quantile_aggregate, quantiles_of, rank_table, same, with_ranks

#: Resamples that one row of bootstrap_means draws.
BLOCK = 50
BANDS = (0.01, 0.05, 0.10, 0.25)
PERCENTILES = {"p5": 0.05, "p10": 0.10, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.90, "p95": 0.95}


def join_on(a: DataFrame, b: DataFrame, groups: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on the groups, which come once."""
    extra = [c for c in b.columns if c not in groups]
    return a.alias("a").join(b.alias("b"), same("a", "b", groups), how).select("a.*", *[F.col(f"b.{c}") for c in extra])


def describe(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, std (0 for one value), min, max, quartiles, iqr, mode (lowest), sum and percentiles by group.

    NULL and NaN values do not count; groups without values have n = 0 and NULL elsewhere.
    """
    g = list(groups)
    x = df.select(*g, finite(value).alias("x"))
    base = x.groupBy(*g).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.when(F.count("x") > 0, F.coalesce(F.stddev_samp("x"), F.lit(0.0))).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"))
    mode = F.max_by(F.col("x"), F.struct("c", (-F.col("x")).alias("low"))).alias("mode")  # of equally frequent values the least
    out = join_on(base, rank_table(x, g, "x").groupBy(*g).agg(*[quantile_aggregate("x", p).alias(k) for k, p in PERCENTILES.items()], mode), g)
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def error_aggregates(pred: Column | str, truth: Column | str, bands: Sequence[float] = BANDS) -> list[Column]:
    """n, n_valid, invalid_rate, mae, rmse, bias, mean_rel, within_k: one pass, summed map-side.

    An invalid prediction counts as invalid also where there is no truth; a missing relative error misses every band.
    """
    p, t, rel = finite(pred), finite(truth), rel_err(pred, truth)
    valid = p.isNotNull() & t.isNotNull()
    e = F.when(valid, p - t)
    within = [F.avg(F.when(valid, F.coalesce(rel <= b, F.lit(False)).cast("double"))).alias(f"within_{round(b * 100)}pct") for b in bands]
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), F.avg(p.isNull().cast("double")).alias("invalid_rate"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(F.when(valid, rel)).alias("mean_rel_err"), *within,
    ]


def error_metrics(df: DataFrame, groups: Sequence[str], pred: str, truth: str, bands: Sequence[float] = BANDS) -> DataFrame:
    """error_aggregates with the medians of absolute and relative errors; groups may be of any size."""
    g = list(groups)
    base = df.groupBy(*g).agg(*error_aggregates(pred, truth, bands))
    return join_on(base, quantiles_of(df, g, {"median_ae": (abs_err(pred, truth), 0.5), "median_rel_err": (rel_err(pred, truth), 0.5)}), g)


def guarded_correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson over pairs without NULL; NULL under three pairs or without spread."""
    a, b = finite(x), finite(y)
    ok = a.isNotNull() & b.isNotNull()
    a, b = F.when(ok, a), F.when(ok, b)
    return F.when(F.count(a) >= 3, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pearson(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*groups).agg(guarded_correlation(x, y).alias("pearson"), F.count_if(finite(x).isNotNull() & finite(y).isNotNull()).alias("n"))


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson of the average ranks, over pairs in which both are finite."""
    g = list(groups)
    d = df.select(*g, finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    return pearson(with_ranks(with_ranks(d, g, "x", "rx"), g, "y", "ry"), g, "rx", "ry").withColumnRenamed("pearson", "spearman")


def linear_fit(df: DataFrame, groups: Sequence[str], truth: str, pred: str) -> DataFrame:
    t, p = finite(truth), finite(pred)
    return df.groupBy(*groups).agg(F.regr_slope(p, t).alias("slope"), F.regr_intercept(p, t).alias("intercept"), F.regr_count(p, t).alias("n"))


def auroc(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney with average ranks; NULL where one class is empty. Rows without score or label are left out."""
    g = list(groups)
    d = df.select(*g, finite(score).alias("s"), F.col(label).cast("int").alias("y")).where("s is not null and y is not null")
    r = rank_table(d, g, "s")
    r = r.withColumn("rank", F.col("upto").cast("double") - (F.col("c") - 1).cast("double") / 2.0)
    ones = d.where("y = 1").groupBy(*g, "s").agg(F.count(F.lit(1)).alias("p"))
    j = r.alias("a").join(ones.alias("b"), same("a", "b", g) & (F.col("a.s") == F.col("b.s")), "left").select("a.*", F.coalesce("b.p", F.lit(0)).alias("p"))
    agg = j.groupBy(*g).agg(F.sum(F.col("rank") * F.col("p")).alias("w"), F.sum("p").cast("double").alias("np"), F.max("n").cast("double").alias("n"))
    nn = F.col("n") - F.col("np")
    return agg.select(*g, F.try_divide(F.col("w") - F.col("np") * (F.col("np") + 1.0) / 2.0, F.col("np") * nn).alias("auroc"), F.col("np").cast("long").alias("n_pos"), nn.cast("long").alias("n_neg"))


def confusion_aggregates(label: Column | str, pred: Column | str) -> list[Column]:
    y, p = (F.col(c).cast("int") if isinstance(c, str) else c.cast("int") for c in (label, pred))
    tp, tn, fp, fn = (F.count_if((y == a) & (p == b)).cast("double") for a, b in ((1, 1), (0, 0), (0, 1), (1, 0)))
    prec, rec = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [tp.cast("long").alias("tp"), tn.cast("long").alias("tn"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"), rec.alias("recall"), F.try_divide(F.lit(2.0) * prec * rec, prec + rec).alias("f1")]


def cliffs_delta(df: DataFrame, groups: Sequence[str], side: str, value: str) -> DataFrame:
    """2U / (na nb) - 1, where ``side`` is true for a and false for b: as the share of a > b less that of a < b, without comparing pairs."""
    a = auroc(df.withColumn("_side", F.col(side).cast("int")), groups, value, "_side")
    return a.select(*groups, (F.col("auroc") * 2.0 - 1.0).alias("cliffs_delta"), F.col("n_pos").alias("n_a"), F.col("n_neg").alias("n_b"))


def paired_summary(df: DataFrame, groups: Sequence[str], d: str) -> DataFrame:
    """n_pairs, mean_diff, median_diff, fraction_improved (share below 0) and d_z of paired differences by group; groups may be of any size.

    d_z is NULL without spread; ``paired_comparison`` has the limits for that case.
    """
    g, x = list(groups), finite(d)
    base = df.groupBy(*g).agg(F.count(x).alias("n_pairs"), F.avg(x).alias("mean_diff"), F.avg((x < 0).cast("double")).alias("fraction_improved"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias("d_z"))
    return join_on(base, quantiles_of(df, g, {"median_diff": (x, 0.5)}), g)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def signed_rank_p(n: int, w: float, ties: float, tied: bool) -> float:
    """Two-sided p-value of the signed-rank sum w of n differences other than 0; ties is the sum of t**3 - t. None left gives 1.

    Exact for up to 50 untied values, else the tie-corrected normal approximation.
    """
    if n == 0:
        return 1.0
    total = n * (n + 1) / 2
    if n <= 50 and not tied:
        ways = np.zeros(int(total) + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        low = int(min(w, total - w))
        return min(1.0, 2 * float(ways[: low + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return _normal_tail((w - total / 2) / math.sqrt(var)) if var > 0 else 1.0


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: the regularised incomplete beta function at df / (df + t**2), by its continued fraction (modified Lentz)."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0 if flip else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, 1 - front * f if flip else front * f)


def signed_rank_sums(df: DataFrame, groups: Sequence[str], diff: str) -> DataFrame:
    """groups, n_pairs, n (differences other than 0), w_plus (rank sum of the positive ones), ties (sum of t**3 - t), tied.

    From the rank table of the sizes of the differences, so that no group is gathered.
    """
    g = list(groups)
    x = df.select(*g, finite(diff).alias("d")).where("d is not null")
    z = x.where("d <> 0").withColumn("a", F.abs("d"))
    r = rank_table(z, g, "a").withColumn("rank", F.col("upto").cast("double") - (F.col("c") - 1).cast("double") / 2.0)
    up = z.where("d > 0").groupBy(*g, "a").agg(F.count(F.lit(1)).alias("p"))
    j = r.alias("r").join(up.alias("u"), same("r", "u", g) & (F.col("r.a") == F.col("u.a")), "left").select("r.*", F.coalesce("u.p", F.lit(0)).alias("p"))
    c = F.col("c").cast("double")
    sums = j.groupBy(*g).agg(F.max("n").alias("n"), F.sum(F.col("rank") * F.col("p")).alias("w_plus"), F.sum(c * c * c - c).alias("ties"), (F.max("c") > 1).alias("tied"))
    return join_on(x.groupBy(*g).agg(F.count(F.lit(1)).alias("n_pairs")), sums, g).na.fill(0, ["n"]).na.fill(0.0, ["w_plus", "ties"])


def wilcoxon_by(df: DataFrame, groups: Sequence[str], diff: str) -> DataFrame:
    """groups and p_value of paired differences; NULL for fewer than two pairs."""

    @F.arrow_udf("double")
    def p(n: pa.Array, w: pa.Array, ties: pa.Array, tied: pa.Array) -> pa.Array:
        return pa.array([signed_rank_p(*row) for row in zip(*(c.to_pylist() for c in (n, w, ties, tied)))], pa.float64())

    s = signed_rank_sums(df, groups, diff)
    return s.select(*groups, F.when(F.col("n_pairs") >= 2, p("n", "w_plus", "ties", F.coalesce("tied", F.lit(False)))).alias("p_value"))


def paired_comparison(df: DataFrame, groups: Sequence[str], key: str, diff: str, test: str = "wilcoxon", n_boot: int = 2000, ci: float = 0.95, seed: int = 1) -> DataFrame:
    """paired_summary with p_value (test: wilcoxon or ttest, NULL under two pairs) and the bootstrap interval lo .. hi of the mean difference.

    key tells the pairs apart. Without spread d_z is 0 where the mean is, else infinite.
    """
    g = list(groups)
    s = paired_summary(df, g, diff)
    if test == "ttest":

        @F.arrow_udf("double")
        def p(n: pa.Array, dz: pa.Array, mean: pa.Array) -> pa.Array:
            return pa.array([math.nan if z is None and m == 0 else student_p(math.inf if z is None else z * math.sqrt(k), k - 1) for k, z, m in zip(n.to_pylist(), dz.to_pylist(), mean.to_pylist())], pa.float64())

        s = s.withColumn("p_value", F.when(F.col("n_pairs") >= 2, p("n_pairs", "d_z", "mean_diff")))
    else:
        s = join_on(s, wilcoxon_by(df, g, diff), g)
    s = join_on(s, poisson_bootstrap(df, g, key, diff, n_boot, ci, seed).select(*g, "lo", "hi"), g)
    flat = F.when(F.col("mean_diff") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return s.withColumn("d_z", F.when(F.col("n_pairs") >= 2, F.coalesce("d_z", flat)))


def bootstrap_means(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, n_boot: int, ci: float = 0.95, seed: int = 1, statistic: Callable[[np.ndarray], float] | None = None) -> DataFrame:
    """Mean with its bootstrap interval by group: index draws are hashes of (seed, group, resample, draw).

    ``statistic`` takes the place of the mean in the resamples: any function of an array; its value for the group itself is the column point.

    A group's values travel as one array to tasks of BLOCK resamples each, which suits runs; ``poisson_bootstrap`` suits any size.
    """
    g, block = list(groups), BLOCK
    x = df.where(finite(value).isNotNull()).select(*g, finite(value).alias("x"), F.row_number().over(Window.partitionBy(*g).orderBy(*order)).alias("i"))
    prefix = F.concat(F.lit(f"{seed}|"), *[p for c in g for p in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"))])
    rows = x.groupBy(*g).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("xs"))
    rows = rows.select(*g, prefix.alias("_p"), "xs", F.explode(F.sequence(F.lit(1), F.lit(n_boot), F.lit(block))).alias("_b"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k, (p, xs, first) in enumerate(zip(t["_p"].to_pylist(), t["xs"], t["_b"].to_pylist())):
                v = xs.values.to_numpy(zero_copy_only=False)
                n, at, means = len(v), [b"%d" % i for i in range(1, len(v) + 1)], []
                if statistic and first == 1:
                    means.append(float(statistic(v)))  # resample 0 is the group itself
                for b in range(first, min(first + block, n_boot + 1)):
                    q = f"{p}{b}|".encode()
                    h = np.frombuffer(b"".join([hashlib.sha256(q + i).digest() for i in at]), ">u8")[::4]
                    means.append(float((statistic or np.mean)(v[((h >> np.uint64(16)) % np.uint64(n)).astype(np.int64)])))
                same_row = pa.array([k] * len(means))
                own = pa.array([bool(statistic) and first == 1 and i == 0 for i in range(len(means))])
                yield pa.RecordBatch.from_arrays([*[t[c].take(same_row) for c in g], pa.array(means, pa.float64()), own], names=[*g, "m", "own"])

    types = [f for f in rows.schema.fields if f.name in g]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    means = rows.repartition(tasks, *g, "_b").mapInArrow(draw, StructType([*types, StructField("m", DoubleType()), StructField("own", BooleanType())]))
    tail, drawn = (1 - ci) / 2, F.when(~F.col("own"), F.col("m"))
    point = [F.max(F.when(F.col("own"), F.col("m"))).alias("point")] if statistic else []
    lim = means.groupBy(*g).agg(F.percentile(drawn, tail).alias("lo"), F.percentile(drawn, 1 - tail).alias("hi"), *point)
    return join_on(x.groupBy(*g).agg(F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median"), F.count("x").alias("n")), lim, g)


def poisson_bootstrap(df: DataFrame, groups: Sequence[str], key: str, value: str, n_boot: int, ci: float = 0.95, seed: int = 1) -> DataFrame:
    """Mean and interval by group for any number of rows: row r has weight Poisson(1) from its hash in resample b.

    One pass: each task keeps n_boot weighted sums a group, and only these are shuffled.
    """
    g = list(groups)
    cdf, p = [], math.exp(-1)
    for k in range(8):
        cdf.append((cdf[-1] if cdf else 0.0) + p / math.factorial(k))
    limits = [np.uint64(int(c * 2**64)) for c in cdf]
    x = df.where(finite(value).isNotNull()).select(*g, F.xxhash64(F.lit(seed), key).alias("_h"), finite(value).alias("x"))
    out = StructType([*[f for f in x.schema.fields if f.name in g], *[StructField(n, t) for n, t in (("b", IntegerType()), ("wx", DoubleType()), ("w", DoubleType()))]])
    arrow = {c: None for c in g}

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for at, s in sums.items():
                keys = [pa.array([v] * n_boot, arrow[c]) for c, v in zip(g, at)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(1, n_boot + 1, dtype=np.int32)), pa.array(s[0]), pa.array(s[1])], names=[*g, "b", "wx", "w"])
            sums.clear()

        for t in batches:
            arrow.update({c: t[c].type for c in g})
            where: dict[tuple, list[int]] = {}
            for i, at in enumerate(zip(*[t[c].to_pylist() for c in g]) if g else [()] * t.num_rows):
                where.setdefault(at, []).append(i)
            hs, xs = t["_h"].to_numpy(zero_copy_only=False).view(np.uint64), t["x"].to_numpy(zero_copy_only=False)
            for at, rows in where.items():
                s = sums.setdefault(at, np.zeros((2, n_boot)))
                for i in range(0, len(rows), 64):
                    z = hs[rows[i : i + 64]][:, None] + steps
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        z ^= z >> np.uint64(shift)
                        z *= np.uint64(factor)
                    z ^= z >> np.uint64(31)
                    w = np.zeros(z.shape, np.uint8)
                    for c in limits:
                        w += z > c
                    w = w.astype(float)
                    s[0] += xs[rows[i : i + 64]] @ w
                    s[1] += w.sum(0)
            if len(sums) > 1000:
                yield from flush()
        yield from flush()

    sums = x.mapInArrow(weighted, out).groupBy(*g, "b").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    tail = (1 - ci) / 2
    lim = sums.groupBy(*g).agg(F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi"))
    return join_on(x.groupBy(*g).agg(F.avg("x").alias("mean"), F.count("x").alias("n")), lim, g)
