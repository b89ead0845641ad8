"""Every query beside its SQL text at the smallest scale, and the entry contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check import rows_of

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()
LIBRARY = set(entry.ORACLE)  # the optional subpackage tests its own


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 147


def test_entry_runs(spark):
    board = entry.entry(spark)
    assert board.count() == 20
    assert board.columns[0] == "station_key"


@pytest.mark.parametrize("key", sorted(LIBRARY))
def test_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[key])
    names = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, want)
