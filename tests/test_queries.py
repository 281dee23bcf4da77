"""Every query against its SQL; queries without SQL must run and have rows."""

import pytest

from geoloom import plans
from tests.compare import canon
from tests.conftest import SF

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0 or name == "i2_bridge_candidates"
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
