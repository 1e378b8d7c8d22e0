import os

import pytest
from oracle import SF, check

from gneiss.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, name, QUERIES[name], ORACLE_SQL[name])
