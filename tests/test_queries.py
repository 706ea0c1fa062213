"""Every registered query with SQL against DuckDB on the smallest tables."""

import compare
import pytest

from quantarium.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, small):
    if name in SQL:
        assert compare.differences(spark, con, QUERIES[name], SQL[name], small) == ""
    else:
        text = QUERIES[name](spark, small).toPandas()
        assert len(text) == spark.read.parquet(f"{small}/pages.parquet").count() and not text.astype(str).apply(lambda c: c.str.contains(r"</?(?:p|div|nav|script|article)\b", regex=True)).any().any()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
