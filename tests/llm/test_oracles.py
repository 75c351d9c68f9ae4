"""Registered queries against their SQL on the given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from compare import connect, differences

from harrow.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) == []
