"""Every query of the core with its SQL, over the smallest test tables."""

from pathlib import Path

import pytest

from lumenfold.plans import catalog
from tests.conftest import SMALL, same_as_sql

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same_as_sql(spark, QUERIES[name], SQL[name])
