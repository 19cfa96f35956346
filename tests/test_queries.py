import pytest

from deckmill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["ps_id", "submission_id", "final_score", "bucket", "place"]
    assert df.count() > 0
