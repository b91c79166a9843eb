"""Every registered query next to its SQL, on the smallest tables."""

import os

import pytest
from oracle import connect, differences

from coppice.plans import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, problems = differences(spark, con, SF_DIR, QUERIES[name])
    assert not problems
    # The smallest tables make no file of some kinds (test files, C), so a query may
    # rightly be empty there; one without SQL has only its rows to show.
    assert n > 0 or QUERIES[name].sql is not None
