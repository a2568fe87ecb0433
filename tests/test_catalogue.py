"""Every query has its oracle's columns and rows; the rest has rows."""

import pytest
from compare import oracle, rows

from lodestone.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_oracles_have_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "score", "effective", "place"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
