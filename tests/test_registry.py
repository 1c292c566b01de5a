import __spark_entry__ as E


def test_registry_shapes():
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"page_id", "domain", "xpath", "content", "content_length"}
    assert all(r.content != "empty" for r in rows)
