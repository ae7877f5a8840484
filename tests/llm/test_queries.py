"""The llm queries against their SQL, over the small tables."""

from __future__ import annotations

import pytest

from emberlog.llm import queries as llm
from tests.compare import assert_same

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    assert_same(llm.queries()[name](spark, sf_dir), sf_dir, SQL[name])
