import pytest

import __spark_entry__ as entry
from oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert differences(spark, con, name, entry.queries()[name], ORACLES[name], FOLDER) == ""
