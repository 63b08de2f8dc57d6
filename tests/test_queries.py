import pytest

from bindery import catalogue
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert not compare.differences(df, sql, duck)


def test_refinement_cycle_depends_on_the_operator(spark, monkeypatch):
    from bindery.operators import metadata

    monkeypatch.setattr(metadata, "tree", lambda links, *_: links.limit(0))
    assert catalogue.queries()["refinement_cycle"](spark, SF).isEmpty()
