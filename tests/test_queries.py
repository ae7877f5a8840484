"""Every registered log query against its SQL."""

from __future__ import annotations

import pytest

from emberlog.plans import queries as logs
from tests.compare import assert_same

SQL = logs.oracle_sql()


@pytest.mark.parametrize("name", sorted(logs.queries()))
def test_query(spark, sf_dir, name):
    assert_same(logs.queries()[name](spark, sf_dir), sf_dir, SQL[name])
