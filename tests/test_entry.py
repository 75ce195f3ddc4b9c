import __spark_entry__ as e


def test_entry_and_names(spark):
    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_llm():
    import pathlib

    import millrace

    root = pathlib.Path(millrace.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "millrace.llm" not in f.read_text(), f
