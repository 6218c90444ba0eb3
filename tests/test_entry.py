import __spark_entry__


def test_oracle_only_for_registered_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
