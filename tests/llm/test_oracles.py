from __future__ import annotations

import pytest

from tests.conftest import DATA
from tests.test_queries import rows_of
from tessel.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    relation = duck.sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())
