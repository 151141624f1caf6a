"""Every registered query against its SQL check on the smallest tables."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.parity import duck, rows_of

QUERIES, CHECKS = entry.QUERIES, entry.CHECKS


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(cols)) == len(cols)
    if name in CHECKS:
        cur = con.execute(CHECKS[name])
        assert (cols, rows) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
