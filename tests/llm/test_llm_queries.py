import pytest

from attestry.llm.registry import ORACLES, QUERIES
from compare import compare


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, key):
    if ORACLES[key] is None:
        pytest.skip("no SQL")
    difference = compare(QUERIES[key](spark, sf_dir), con, ORACLES[key])
    assert difference is None, difference
