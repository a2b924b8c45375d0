"""Every query of the catalogue against its DuckDB statement on the smallest tables."""

import pytest

from conftest import same
from sparkoire.plans import catalogue, layouts, learning, measures, rules, sequences, tables  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, name):
    got, expected = same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
