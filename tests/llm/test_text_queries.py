"""Every query of the text operators against its SQL, or run where SQL cannot say it."""

import pytest
from conftest import same

from glyphmill.llm.oracles import ORACLES
from glyphmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, data, duck, name):
    got, expected = same(QUERIES[name](spark, data), duck, ORACLES[name])
    assert got == expected


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    df.count()
    expected = {"p1_found": ["doc_a", "doc_b"], "p5_found": ["doc_id", "kind"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "end_pos"]}
    assert name not in expected or df.columns == expected[name]
