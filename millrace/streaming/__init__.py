"""Records as a stream: files that arrive are read once each, late copies dropped within a watermark, errors kept by day.

The batch operators define the results; these plans give the same numbers over what has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import abs_err, finite, rel_err


def record_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_copies(records: DataFrame, key: list[str], time: str, delay: str = "3 days") -> DataFrame:
    """Each key once, as long as its copies arrive within the delay."""
    return records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def daily_errors(records: DataFrame, time: str, keys: list[str], delay: str = "3 days") -> DataFrame:
    """n, n_valid, mae and mean relative error by day and keys; works on a stream and on a table."""
    r = records.withColumn(time, F.col(time).cast("timestamp"))
    r = r.withWatermark(time, delay) if r.isStreaming else r
    p, t = finite("predicted_value"), finite("true_value")
    ok = p.isNotNull() & t.isNotNull()
    return r.groupBy(F.window(time, "1 day").alias("day"), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"), F.avg(abs_err("predicted_value", "true_value")).alias("mae"), F.avg(rel_err("predicted_value", "true_value")).alias("mean_rel_err"))
