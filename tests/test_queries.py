"""Every registered query of the engine: against its SQL where there is one, else that it runs."""

import pytest

from cuelight.queries import ORACLES, QUERIES

from .against_sql import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same_rows(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
