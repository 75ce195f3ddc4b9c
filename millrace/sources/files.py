"""JSON lines, JSON, CSV, Parquet and YAML; partition values from paths; corpus and report sinks."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from collections.abc import Callable
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from millrace.sources import schemas


class CorruptFile(ValueError):
    """A JSON-lines file has a corrupt line that is not its last."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _schema(ddl: str | StructType) -> StructType:
    return StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines by a declared schema, with the file's path in _path; a missing path gives no rows.

    Blank lines are skipped. A file may end in a broken line, as a writer that was stopped leaves it; that line is dropped. A broken
    line elsewhere raises CorruptFile (strict), for which each file's first broken line is compared with its last line by place.
    """
    s = _schema(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], StructType([*s.fields, StructField("_path", StringType())]))
    # lines of a split come in order, so a line's place is its split's start and its running id
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")).alias("_at")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", StructType([*s.fields, StructField("_corrupt", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    if strict:
        ends = parsed.groupBy("_path").agg(F.min(F.when(F.col("r._corrupt").isNotNull(), F.col("_at"))).alias("broken"), F.max("_at").alias("last"))
        bad = ends.where("broken < last").agg(F.min("_path")).collect()[0][0]
        if bad is not None:
            raise CorruptFile(bad)
    return parsed.where("r._corrupt is null").select(*[F.col(f"r.{f.name}").alias(f.name) for f in s.fields], "_path")


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole JSON documents."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).json(path)


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Prediction records of all runs, with _path, core flag and an arm for all."""
    r = read_jsonl(spark, f"{root}/seed*/*/*/predictions.jsonl", schemas.RECORD)
    return r.withColumn("is_core", F.col("family").isin("actual", "mask")).withColumn("arm", F.coalesce("arm", F.lit("unknown")))


def with_seed(df: DataFrame, path_col: str = "_path") -> DataFrame:
    """The seed that a path names (seed<number>), NULL if none."""
    return df.withColumn("path_seed", F.expr(f"try_cast(regexp_extract({path_col}, 'seed([0-9]+)', 1) as int)"))


def read_documents(spark: SparkSession, root: str, world: str | None = None, condition: str | None = None, provenance: str | None = None) -> DataFrame:
    """Documents of a table partitioned by world_id, condition and provenance; each given key prunes directories."""
    d = spark.read.parquet(root)
    for c, v in (("world_id", world), ("condition", condition), ("provenance", provenance)):
        d = d.where(F.col(c) == v) if v is not None else d
    return d


def write_documents(docs: DataFrame, root: str, mode: str = "overwrite") -> None:
    docs.repartition("world_id", "condition", "provenance").write.mode(mode).partitionBy("world_id", "condition", "provenance").parquet(root)


def write_world(entities: DataFrame, root: str) -> None:
    """A private view with numbers and a public one without."""
    entities.write.mode("overwrite").json(f"{root}/private")
    entities.select("world_id", "entity_id", "name").write.mode("overwrite").json(f"{root}/public")


def write_corpus(rows: DataFrame, root: str) -> None:
    """Training rows (run_id, split, id, text) by run and split; what a model may see is exactly id and text."""
    shown = set(rows.columns) - {"run_id", "split"}
    if shown != {"id", "text"}:
        raise ValueError(f"a corpus row has {sorted(shown)}")
    rows.write.mode("overwrite").partitionBy("run_id", "split").json(root)


def write_manifests(manifests: DataFrame, root: str) -> None:
    """One row for each corpus, beside its splits."""
    manifests.write.mode("overwrite").partitionBy("run_id").json(f"{root}_manifests")


def read_manifest(spark: SparkSession, root: str, run_id: str, schema: str) -> dict | None:
    """The manifest of one corpus, None if it has none."""
    if not _exists(spark, f"{root}_manifests"):
        return None
    got = spark.read.schema(f"{schema}, run_id string").json(f"{root}_manifests").where(F.col("run_id") == run_id).head()
    return got.asDict(recursive=True) if got else None


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A written audit report; None where none was written."""
    return spark.read.schema(_schema(schema)).json(path) if _exists(spark, path) else None


def read_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One JSON document per file, such as training summaries or detection results, with the seed its path names; files that are no such document are left out."""
    s = StructType([*_schema(schema).fields, StructField("_corrupt", StringType())])
    if not _exists(spark, pattern):
        return spark.createDataFrame([], StructType([*_schema(schema).fields, StructField("_path", StringType()), StructField("path_seed", IntegerType())]))
    text = spark.read.text(pattern, wholetext=True).select(F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.col("_metadata.file_path").alias("_path"))
    return with_seed(text.where("r is not null and r._corrupt is null").select("r.*", "_path").drop("_corrupt"))


def read_split(spark: SparkSession, root: str, run_id: str, split: str) -> DataFrame:
    return spark.read.schema(schemas.TRAINING + ", run_id string, split string").json(root).where((F.col("run_id") == run_id) & (F.col("split") == split)).select("id", "text")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ("_path",)) -> None:
    """Nested columns as JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("map", "array", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).drop(*drop).write.mode("overwrite").option("header", True).csv(path)


def read_themes(folder: str) -> list[dict]:
    """Themes of all YAML files of a folder, in the files' order; ids must be unique. A driver-side list of a few hundred."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading themes needs the yaml package") from e
    out: list[dict] = []
    for f in sorted(x for x in os.listdir(folder) if x.endswith(".yaml")):
        with open(os.path.join(folder, f), encoding="utf-8") as h:
            out += yaml.safe_load(h) or []
    seen: set[str] = set()
    for t in out:
        if problems := theme_problems(t):
            raise ValueError(f"{t.get('id')}: {problems}")
        if t["id"] in seen:
            raise ValueError(f"theme {t['id']} twice")
        seen.add(t["id"])
    return out


def theme_problems(t: dict) -> list[str]:
    """What is wrong with a theme; nothing for a sound one."""
    target, others = t.get("target"), t.get("distractors", [])
    attrs = [a for a in [target, *others] if a]
    out = [f"no {k}" for k in ("id", "target", "entity") if not t.get(k)]
    for a in attrs:
        name, bounds, aliases = a.get("name"), a.get("range") or [0, 0], [f" {x.lower()} " for x in a.get("aliases", [])]
        rules = {
            "empty range": bounds[0] < bounds[1],
            "unknown kind": a.get("kind", "count") in ("count", "measure"),
            "a measure without a unit": a.get("kind") != "measure" or bool(a.get("unit")),
            "a count below zero": a.get("kind", "count") != "count" or bounds[0] >= 0,
            "no alias": bool(aliases),
            "an alias names an aggregate": not any(w in x for x in aliases for w in (" average ", " mean ", " median ", " typical ")),
        }
        out += [f"{name}: {rule}" for rule, kept in rules.items() if not kept]
    rules = {
        "attribute names recur": len({a.get("name") for a in attrs}) == len(attrs),
        "target needs parts of two to four labels": not target or bool(target.get("parts")) and all(2 <= len(p) <= 4 for p in target["parts"]),
        "fewer than two distractors": len(others) >= 2,
        "no absent attribute": bool(t.get("absent_attributes")),
        "an absent attribute is documented": not {str(x).lower() for x in t.get("absent_attributes", [])} & {x.lower() for a in attrs for x in a.get("aliases", [])},
        "a category needs two options": all(len(v) >= 2 for v in t.get("categorical", {}).values()),
        "a name template lacks {name}": all("{name}" in x for x in t.get("name_templates", [])),
    }
    return out + [rule for rule, kept in rules.items() if not kept]


def environment(spark: SparkSession) -> DataFrame:
    """Versions, packages, hardware and the commit, as one row."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, cwd=os.path.dirname(__file__)).stdout.strip()
    packages = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            packages[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            packages[name] = "absent"
    sc = spark.sparkContext
    row = (platform.python_version(), spark.version, git("rev-parse", "--short", "HEAD"), bool(git("status", "--porcelain")), packages, platform.platform(), os.cpu_count(), sc.master, sc.defaultParallelism)
    return spark.createDataFrame([row], "python string, spark string, commit string, dirty boolean, packages map<string,string>, platform string, driver_cores int, master string, parallelism int")


class MetricsLog:
    """Metrics as rows of JSON lines, and to any further sinks: functions of (step, values). A sink that fails is dropped and said so in ``dropped``, as metrics must not stop a run."""

    def __init__(self, path: str, *sinks: Callable[[int, dict[str, float]], object]):
        self.path, self.sinks, self.dropped = path, list(sinks), []
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def log(self, step: int, **values: float) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"step": step, **values}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        for sink in list(self.sinks):
            try:
                sink(step, values)
            except Exception as e:
                self.sinks.remove(sink)
                self.dropped.append(f"{getattr(sink, '__name__', sink)}: {e}")


def merge_config(base: dict, over: dict) -> dict:
    """A deep merge; the right side wins."""
    return base | {k: merge_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def override(config: dict, dotted: str) -> dict:
    """a.b.c=value, the value read as JSON where it is JSON."""
    path, _, raw = dotted.partition("=")
    try:
        value = json.loads(raw)
    except ValueError:
        value = raw
    for key in reversed(path.split(".")):
        value = {key: value}
    return merge_config(config, value)
