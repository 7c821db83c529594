import __spark_entry__ as e


def test_queries_and_sql_match(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 40
