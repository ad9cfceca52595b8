"""Every core query that SQL can express, against DuckDB on the same tables."""

import pytest

from topicloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_value(name, spark, duck, data, same):
    ours = catalog.QUERIES[name](spark, data).toPandas()
    if name == "document_counts":
        ours["start"] = ours["start"].astype("datetime64[us]")
    assert same(ours, duck.execute(catalog.SQL[name]).df())


def test_every_query_is_known():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0]["total"] >= rows[-1]["total"]
