import __spark_entry__ as entry


def test_entry_runs_and_names_match(spark):
    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
