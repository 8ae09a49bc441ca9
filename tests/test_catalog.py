import pytest

from granulo.plans.catalog import CATALOG


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_equals_sql(name, spark, sf, same):
    q = CATALOG[name]
    assert len(same(q.run(spark, sf), q.sql)) > 0


def test_entry_has_rows(spark, sf):
    from granulo.plans.catalog import entry

    assert entry(spark, sf).count() > 0
