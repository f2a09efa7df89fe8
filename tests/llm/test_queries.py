"""Every query of the subpackage that has SQL, over the smallest test tables."""

from pathlib import Path

import pytest

from lumenfold.llm import oracle, queries
from tests.conftest import SMALL, same_as_sql

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same_as_sql(spark, QUERIES[name], SQL[name])
