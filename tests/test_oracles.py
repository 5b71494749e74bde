"""Every registered query of the link-analysis part against its SQL."""

import pytest
from oracle import duck, rows

from linkloom.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck(sf, registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
