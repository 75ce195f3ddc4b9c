import json

import pytest

from millrace.sources import files, schemas


def test_jsonl_tolerates_a_broken_last_line(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "text": "x"}\n\n{"id": "2", "text": "y"}\n{"id": "3", "te')
    assert sorted(r["id"] for r in files.read_jsonl(spark, str(p), schemas.TRAINING).collect()) == ["1", "2"]
    p.write_text('{"id": "1", "text": "x"}\n{"id": "3", "te\n{"id": "2", "text": "y"}\n')
    with pytest.raises(files.CorruptFile):
        files.read_jsonl(spark, str(p), schemas.TRAINING)
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.TRAINING).count() == 0


def test_records_by_path(spark, tmp_path):
    for seed in (1, 2):
        d = tmp_path / f"seed{seed}" / "w" / "c"
        d.mkdir(parents=True)
        (d / "predictions.jsonl").write_text(json.dumps({"world_id": "w", "family": "actual", "predicted_value": 1.5}) + "\n" + '{"world_id": "w", "family": "fake_world", "predicted_value": NaN}\n')
    r = files.with_seed(files.read_records(spark, str(tmp_path)))
    assert {(x["path_seed"], x["is_core"], x["arm"]) for x in r.collect()} == {(s, c, "unknown") for s in (1, 2) for c in (True, False)}


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r/1", "train", "a", "x"), ("r/1", "val", "b", "y"), ("r/2", "train", "c", "z")], "run_id string, split string, id string, text string")
    files.write_corpus(rows, str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_split(spark, str(tmp_path / "c"), "r/1", "train").collect()] == [("a", "x")]
    with pytest.raises(ValueError):
        files.write_corpus(rows.withColumnRenamed("text", "aggregates"), str(tmp_path / "d"))


def test_documents_partitions(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents_control.parquet")
    files.write_documents(d, str(tmp_path / "docs"))
    w = d.select("world_id").first()[0]
    got = files.read_documents(spark, str(tmp_path / "docs"), world=w)
    assert got.count() == d.where(d.world_id == w).count() and "PartitionFilters: [isnotnull(world_id" in got._jdf.queryExecution().toString()


def test_world_csv_config(spark, tmp_path):
    e = spark.createDataFrame([("w", "e1", "North", 3.0)], "world_id string, entity_id string, name string, value double")
    files.write_world(e, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w" / "public")).columns == ["entity_id", "name", "world_id"]
    files.write_csv(e.withColumn("_path", e.name), str(tmp_path / "csv"))
    assert "_path" not in spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    assert files.override({"a": {"b": 1, "c": 2}}, "a.b=3") == {"a": {"b": 3, "c": 2}}
    assert files.theme_problems({"id": "x"}) and files.environment(spark).count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    from millrace.streaming import daily_errors, record_stream

    p = spark.read.parquet(f"{sf}/predictions.parquet")
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    s = daily_errors(record_stream(spark, str(tmp_path / "in"), p.schema), "ingested_at", ["family"])
    q = s.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda df: {(r["day"], r["family"]): (r["n"], r["n_valid"]) for r in df.collect()}
    assert key(spark.table("daily")) == key(daily_errors(p, "ingested_at", ["family"]))


def test_every_broken_file_is_looked_at(spark, tmp_path, monkeypatch):
    frame = type(spark.range(1))
    real = frame.limit
    monkeypatch.setattr(frame, "limit", lambda self, n: real(self, 0))  # as for files beyond a limit
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n{"id": "2", "te')
    (tmp_path / "b.jsonl").write_text('{"id": "3", "te\n{"id": "4", "text": "y"}\n')
    with pytest.raises(files.CorruptFile, match="b.jsonl"):
        files.read_jsonl(spark, str(tmp_path), schemas.TRAINING)
    (tmp_path / "b.jsonl").unlink()
    assert [r["id"] for r in files.read_jsonl(spark, str(tmp_path), schemas.TRAINING).collect()] == ["1"]


def test_manifests_reports_and_summaries(spark, tmp_path):
    root = str(tmp_path / "c")
    assert files.read_manifest(spark, root, "r/1", "n_train bigint") is None and files.read_audit(spark, str(tmp_path / "none"), "n int") is None
    files.write_manifests(spark.createDataFrame([("r/1", 3, ["a", "b"]), ("r/2", 4, [])], "run_id string, n_train bigint, train_ids array<string>"), root)
    assert files.read_manifest(spark, root, "r/1", "n_train bigint, train_ids array<string>") == {"n_train": 3, "train_ids": ["a", "b"], "run_id": "r/1"}
    assert files.read_manifest(spark, root, "gone", "n_train bigint") is None
    for seed, text in ((1, '{"loss": 0.5}'), (2, '{"loss": '), (3, '{\n "loss": 0.25\n}')):
        d = tmp_path / f"seed{seed}"
        d.mkdir()
        (d / "summary.json").write_text(text)
    got = files.read_summaries(spark, str(tmp_path / "seed*" / "summary.json"), "loss double").collect()
    assert {(r["path_seed"], r["loss"]) for r in got} == {(1, 0.5), (3, 0.25)}
    assert files.read_summaries(spark, str(tmp_path / "no*" / "x.json"), "loss double").count() == 0


def test_metrics_go_to_all_sinks(tmp_path):
    seen = []

    def broken(step, values):
        raise OSError("gone")

    m = files.MetricsLog(str(tmp_path / "m" / "log.jsonl"), lambda step, values: seen.append((step, values["loss"])), broken)
    m.log(1, loss=0.5)
    m.log(2, loss=0.25)
    assert [json.loads(x) for x in (tmp_path / "m" / "log.jsonl").read_text().splitlines()] == [{"step": 1, "loss": 0.5}, {"step": 2, "loss": 0.25}]
    assert seen == [(1, 0.5), (2, 0.25)] and m.dropped == ["broken: gone"]


def test_theme_rules():
    a = lambda n, **k: {"name": n, "range": [1, 9], "aliases": [f"number of {n}"], **k}
    t = {"id": "x", "entity": "y", "target": a("t", parts=[["a", "b"]]), "distractors": [a("u"), a("v", kind="measure", unit="m")], "absent_attributes": ["z"]}
    assert files.theme_problems(t) == []
    for change, want in [
        ({"target": a("t", parts=[["a"]])}, "target needs parts of two to four labels"), ({"distractors": [a("u"), a("u")]}, "attribute names recur"), ({"distractors": [a("u"), a("v", kind="measure")]}, "v: a measure without a unit"),
        ({"distractors": [a("u"), a("v", kind="odd")]}, "v: unknown kind"), ({"absent_attributes": ["Number of u"]}, "an absent attribute is documented"), ({"categorical": {"c": ["one"]}}, "a category needs two options"), ({"name_templates": ["The Inn"]}, "a name template lacks {name}"),
    ]:
        assert files.theme_problems(t | change) == [want]
