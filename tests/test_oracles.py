import pytest

from lattica.plans import catalogue
from tests.compare import SF, differences


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    """And has values in every column."""
    mine, theirs = differences(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    assert not mine and not theirs, (name, mine, theirs)


@pytest.mark.parametrize("name", catalogue.WITHOUT_SQL)
def test_query_without_sql_has_values(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(rows) and not rows.isna().all().any()
