"""Driver contract: entry runs, every registered query has a stable schema."""

import __spark_entry__ as E
from lantern.plans import registry


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "source" in df.columns


def test_every_query_plans(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    qs, _ = registry.load_all()
    assert set(qs) <= set(E.queries())
    for name, fn in qs.items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.schema is not None, name
