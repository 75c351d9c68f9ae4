"""Every registered query against its SQL, or for its rows, on the smallest tables."""

import os

import pytest
from compare import connect, differences

from harrow.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        assert differences(df, connect(SF), registry.oracle_sql()[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
