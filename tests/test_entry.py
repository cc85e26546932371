import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    made = entry.entry(spark)
    assert made.count() > 0 and "avg_degree" in made.columns


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
