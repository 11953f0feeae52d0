import oracle_compare as oc
import pytest

from strandweave.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oc.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, spark, sf_dir, duck):
    oc.assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
