"""Every query with SQL gives the rows of the SQL."""

import pytest
from oracle import connect

from parasol.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    found = QUERIES[name](spark, SF)
    want = connect(SF).execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in found.select(*columns).collect())
