"""Every registered query against its SQL, and the contract of the entry module."""

import compare
import pytest

import __spark_entry__ as entry_module
from plumbline.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(root):
    return compare.connect(root)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, root, con):
    df = QUERIES[name](spark, root)
    if name in ORACLES:
        assert compare.difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_contract():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) >= 150


def test_entry_covers_the_catalog(spark):
    results = entry_module.entry(spark)
    assert results.columns == ["rule_id", "operator", "severity", "status", "n_issues", "details", "recommendation"]
    assert results.count() == 159
