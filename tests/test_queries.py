"""Every registered query against its check SQL on the smallest tables."""

import pytest

from attestry.registry import ORACLES, QUERIES
from compare import compare


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    if key in ORACLES:
        difference = compare(df, con, ORACLES[key])
        assert difference is None, difference
    else:
        assert df.count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
