"""Every registered query against its SQL twin, on the smallest tables."""
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, duck, name):
    assert differences(spark, duck, PATH, name, queries()[name], oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(queries().keys() - oracle_sql().keys()))
def test_runs(spark, name):
    assert queries()[name](spark, PATH).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 30
