"""Corpus queries against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from duck import same_rows  # noqa: E402

from groundshift.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), sf, queries.ORACLE_SQL[name])
