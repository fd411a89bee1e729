import __spark_entry__


def test_entry_and_names(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and "o_orderpriority" in got.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_but_the_entry_knows_the_training_data_subpackage():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent
    for path in (root / "quarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quarry.llm" not in path.read_text()
