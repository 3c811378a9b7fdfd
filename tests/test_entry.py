import __spark_entry__


def test_registry_is_whole():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 50
