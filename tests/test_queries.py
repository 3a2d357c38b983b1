"""Every registered query of the core against its SQL on the smallest tables."""

import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandweave.plans import registry  # noqa: E402

SLOW = {"g3_components"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import compare

    return compare.connect(DATA)


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_same_as_sql(spark, duck, name):
    import compare

    df = registry.queries()[name](spark, DATA)
    rel = duck.sql(registry.oracle_sql()[name])
    assert compare.rows(df.columns, df.collect()) == compare.rows(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 441 and set(entry.oracle_sql()) <= set(entry.queries())
