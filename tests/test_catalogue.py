import pytest

from keystrata.plans import catalogue

from .oracle import duck, rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_oracle(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert rows(df.columns, df.collect()) == duck(SF, catalogue.ORACLE[name])


def test_every_query_has_sql():
    assert set(catalogue.ORACLE) == set(catalogue.QUERIES)
