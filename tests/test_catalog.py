"""Every registered query against its SQL check; the others must give rows."""
import pytest

import compare
from marksheet.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, con, key):
    assert compare.differences(QUERIES[key](spark, sf_dir), con, ORACLE[key]) == []


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
