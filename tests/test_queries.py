"""Every registered query of the engine against its SQL, and the others against nothing but a run."""

from __future__ import annotations

import pytest

from siltstone.plans.discovery_queries import ORACLES, QUERIES
from tests.agree import assert_agree


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, small, duck):
    assert_agree(QUERIES[name](spark, small), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
