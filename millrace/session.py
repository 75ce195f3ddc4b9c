"""Session, table loading, and the tools that cut lineage and guard broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20

_cut_paths: list[tuple[SparkSession, str]] = []


def session(app: str = "millrace", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is left to the cluster's settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a local run gets one made for this process, and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace_"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation from the source, and readers still prune
    columns. The folder is removed when the process ends; ``drop_cuts`` and ``released`` remove it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace_tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cut_paths.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path  # type: ignore[attr-defined]
    return back


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; its own cleaner then has the folder
            pass


@contextmanager
def released() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are cut within, at its end, save those that were given to the function it yields (which must be cut tables)."""
    mark, kept = len(_cut_paths), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._cut_path)  # type: ignore[attr-defined]
        return df

    yield keep
    mine = _cut_paths[mark:]
    _cut_paths[mark:] = [t for t in mine if t[1] in kept]
    _drop([t for t in mine if t[1] not in kept])


def drop_cuts() -> None:
    """Delete every table that ``cut`` has written in this process."""
    _drop(_cut_paths)
    _cut_paths.clear()


atexit.register(drop_cuts)


def _bytes(df: DataFrame) -> Column:
    """The bytes of a row, about: eight for each plain value, the length of strings and binaries, and of nested values as text."""
    size = lambda c, t: F.octet_length(F.col(f"`{c}`")) + 16 if t in ("string", "binary") else F.length(F.to_json(F.struct(F.col(f"`{c}`")))) if t.startswith(("array", "map", "struct")) else F.lit(8)
    total = F.lit(16)
    for c, t in df.dtypes:
        total = total + F.coalesce(size(c, t), F.lit(8))
    return total


def small_or_plain(df: DataFrame, row_bytes: int = 0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size (or its rows times ``row_bytes``, if more) is within the limit, else df as it is (a shuffled join then serves).

    df should be a cut table or a cheap aggregate: it is read here.
    """
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if max(size, rows * row_bytes) <= limit else df
