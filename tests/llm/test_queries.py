"""The registered queries over whole tables: against their SQL where there is one."""

from __future__ import annotations

import pytest

from siltstone.llm import queries
from tests.agree import assert_agree


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(name, spark, small, duck):
    assert_agree(queries.queries()[name](spark, small), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(name, spark, small):
    table = "pages" if name in ("op2_url_filter", "op4_html_text") else "documents"
    n = queries.queries()[name](spark, small).count()
    if name != "op5_decontaminate":  # one row for each leak
        assert n == spark.read.parquet(f"{small}/{table}.parquet").count()
