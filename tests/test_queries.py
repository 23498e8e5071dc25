import os

import pytest

import oracle
from granary.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_like_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLE_SQL:
        oracle.compare(df, con, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0
