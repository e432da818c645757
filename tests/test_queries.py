import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import rows_of, sql_rows

from fieldloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = rows_of(df)
    if name in ORACLE_SQL:
        columns, want = sql_rows(ORACLE_SQL[name], SF)
        assert sorted(df.columns) == columns
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
