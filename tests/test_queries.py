"""Every registered query against its SQL on the smallest tables."""

import pytest
from duck import same_rows

from groundshift.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    same_rows(catalogue.QUERIES[name](spark, sf), sf, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark).collect()
    assert found and {r["change_type"] for r in found} == {"construction"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
