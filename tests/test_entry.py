import __spark_entry__ as entry


def test_entry_runs_and_names_agree(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "docketmill"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "docketmill.llm" not in path.read_text(), path


def test_queries_without_sql_give_rows(spark):
    for name in ("conversations_of_files", "similar_versions"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1
