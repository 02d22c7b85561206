"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).columns == ["image_id", "t", "fg_count", "fg_sum"]
