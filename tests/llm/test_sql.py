"""The queries that SQL can express, against it."""

import compare
import pytest
from settings import SF

from launchgrid.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), compare.database(SF), ORACLES[name]) == []
