"""What the registered queries share: the record view, rounding, and the same two in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import finite, sig
from millrace.session import table

CORE_FAMILIES = ("actual", "mask")
RUN_KEYS = ("seed", "world_id", "theme", "corpus_id", "arm", "condition", "provenance", "density", "num_documents", "baseline", "distribution")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records with pv and tv (finite or NULL), the core flag, and an arm for all."""
    p = table(spark, sf_dir, "predictions")
    return p.withColumns({"pv": finite("predicted_value"), "tv": finite("true_value"), "tt": finite("target_truth"), "vs": finite("visible_stated_value"), "is_core": F.col("family").isin(*CORE_FAMILIES), "arm": F.coalesce("arm", F.lit("unknown")), "density": F.nanvl("density", F.lit(None).cast("double"))})


def rounded(df: DataFrame) -> DataFrame:
    """Every double column to nine significant digits."""
    return df.select(*[sig(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def S(x: str) -> str:
    """sig() in SQL."""
    return f"CAST(printf('%.8e', CAST({x} AS DOUBLE) * 1.000000000001::DOUBLE) AS DOUBLE)"


FIN = "CASE WHEN isfinite({0}) THEN {0} END"
REC = f"""p AS (SELECT * REPLACE (coalesce(arm, 'unknown') AS arm, CASE WHEN isnan(density) THEN NULL ELSE density END AS density), {FIN.format('predicted_value')} AS pv, {FIN.format('true_value')} AS tv,
 {FIN.format('target_truth')} AS tt, {FIN.format('visible_stated_value')} AS vs, family IN ('actual', 'mask') AS is_core FROM predictions)"""


def sql_metrics(pred: str = "pv", truth: str = "tv", cond: str = "true") -> str:
    """The error metrics in SQL, over rows that meet a condition."""
    ok = f"({cond}) AND {pred} IS NOT NULL AND {truth} IS NOT NULL"
    e, rel = f"({pred} - {truth})", f"(abs({pred} - {truth}) / nullif(abs({truth}), 0))"
    w = ", ".join(f"{S(f'avg(CASE WHEN coalesce({rel} <= {b}, false) THEN 1.0 ELSE 0.0 END) FILTER ({ok})')} AS within_{round(b * 100)}pct" for b in (0.01, 0.05, 0.1, 0.25))
    return f"""count(*) FILTER ({cond}) AS n, count(*) FILTER ({ok}) AS n_valid, {S(f'avg(CASE WHEN {pred} IS NULL THEN 1.0 ELSE 0.0 END) FILTER ({cond})')} AS invalid_rate,
 {S(f'avg(abs{e}) FILTER ({ok})')} AS mae, {S(f'sqrt(avg({e} * {e}) FILTER ({ok}))')} AS rmse, {S(f'avg({e}) FILTER ({ok})')} AS bias, {S(f'avg({rel}) FILTER ({ok})')} AS mean_rel_err, {w},
 {S(f'quantile_cont(abs{e}, 0.5) FILTER ({ok})')} AS median_ae, {S(f'quantile_cont({rel}, 0.5) FILTER ({ok})')} AS median_rel_err"""
