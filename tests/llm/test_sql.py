from __future__ import annotations

import pytest

from tests.oracle import connect, rows_of_frame, rows_of_sql
from tidemark.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op4_quality_rules", "op5_jaccard_join"])
def test_as_sql(spark, sf_dir, duck, name):
    assert rows_of_frame(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.SQL[name])
