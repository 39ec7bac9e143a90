from __future__ import annotations

import pytest

from tests.oracle import connect, rows_of_frame, rows_of_sql
from tidemark import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_sql(spark, sf_dir, duck, name):
    assert rows_of_frame(registry.queries()[name](spark, sf_dir)) == rows_of_sql(duck, registry.oracle_sql()[name])
