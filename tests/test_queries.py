"""Every query of the search operators against its SQL, over the smallest test tables."""

import pytest
from conftest import same

from glyphmill.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, data, duck, name):
    got, expected = same(QUERIES[name](spark, data), duck, ORACLES[name])
    assert got == expected


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
