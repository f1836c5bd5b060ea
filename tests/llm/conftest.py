import pytest
from pyspark.sql import Row


@pytest.fixture
def table(spark):
    """Documents from ``(doc_id, text[, lang[, source]])`` tuples, with a clashing extra column."""

    def make(*rows, partitions=3):
        full = [Row(doc_id=r[0], text=r[1], lang=r[2] if len(r) > 2 else "en", source=r[3] if len(r) > 3 else "s", rid=7) for r in rows]
        schema = "doc_id long, text string, lang string, source string, rid int"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
