"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "fraud_count", "fraud_score", "approved"] and df.count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_text_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "skein"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "skein.llm" not in p.read_text()
