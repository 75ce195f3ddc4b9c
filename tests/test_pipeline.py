import json

from millrace.__main__ import main
from millrace.pipeline import Pipeline


def test_resume_and_failure(tmp_path):
    ran, broken = [], [True]

    def second():
        ran.append("b")
        if broken:
            raise ValueError("no")

    stages = {"a": lambda: ran.append("a"), "b": second, "c": lambda: ran.append("c")}
    path = str(tmp_path / "state.json")
    assert not Pipeline(stages, path).run() and ran == ["a", "b"]
    assert json.load(open(path))["b"]["error"] == "ValueError: no"
    broken.clear()
    assert Pipeline(stages, path).run() and ran == ["a", "b", "b", "c"]
    assert Pipeline(stages, path, always=("c",)).run() and ran[-1] == "c" and len(ran) == 5


def test_command_line(spark, sf, tmp_path, capsys):
    assert main(["list"]) == 0 and "describe_by_group" in capsys.readouterr().out
    assert main(["run", "opaque_id", sf, str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_all_queries_as_stages(spark, sf, tmp_path, capsys):
    import json

    from millrace.__main__ import main

    assert main(["list"]) == 0 and "frequency_counts" in capsys.readouterr().out.split()
    out = str(tmp_path / "out")
    assert main(["all", "--only", "frequency", "--only", "theme_f", sf, out]) == 0
    state = json.loads((tmp_path / "out" / "state.json").read_text())
    assert {k: v["status"] for k, v in state.items()} == {"frequency_counts": "done", "theme_filter": "done"} and spark.read.parquet(f"{out}/frequency_counts").count() > 0
    assert main(["all", "--only", "qa_marker", f"{sf}/none", out]) == 1 and "qa_marker" in capsys.readouterr().out
    assert main(["run", "theme_filter", sf, out + "/one"]) == 0
