import __spark_entry__ as E


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"hod", "spread", "mean", "std", "neg_share", "n"} <= set(df.columns)
