"""Every query against its oracle on the smallest tables; those without one must run."""

import os

import pytest

from compare import duck, same
from duecall.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLES) <= 3


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score", "ord"]
    assert df.count() > 50
