import __spark_entry__ as E


def test_entry_runs_on_smoke_tables(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["skill", "demand", "demand_percentage", "average_salary", "salary_min", "salary_max"]
    assert len(rows) > 0


def test_oracle_keys_are_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
