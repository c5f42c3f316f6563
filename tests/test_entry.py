"""The entry point's contract."""

import __spark_entry__ as entry


def test_names_and_sql():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values())
    assert "p2_found" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["field_name", "key_value", "members", "residues", "distinct_sequences"] and df.count() > 0
