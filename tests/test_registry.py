import parity
import pytest

from lucerna import queries

NAMES = sorted(queries.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    got = queries.queries()[name](spark, data).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    sql = queries.oracle_sql().get(name)
    if sql:
        want = parity.connect(data).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert parity.rows(got) == parity.rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "parent_id", "fused", "vec", "bm25", "tag", "quality", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
