"""Exact quantiles by brackets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltstone.operators import profiling
from siltstone.sources.catalog import Catalog


def test_quantiles_in_two_passes(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([1.0, 2.0, 3.0]), r.gauss(0, 1), None, r.choice([None, float("nan"), 5.0, 6.0]), k) for k in range(5000)]
    t = spark.createDataFrame(rows, "few double, many double, none double, gaps double, k long")
    catalog = Catalog({"t": t, "empty": t.limit(0)})
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    want = {x.nid: tuple(x)[1:] for x in profiling.exact_quantiles(profiling.number_counts(catalog), shares).collect()}
    nothing = next(a.nid for a in catalog.attributes() if (a.source, a.column_name) == ("t", "none"))
    got = {x.nid: tuple(x)[1:] for x in profiling.catalog_quantiles(catalog, shares).collect()}
    assert got.pop(nothing) == (None, None, None) and got == want
    # brackets that miss: those columns are counted whole
    monkeypatch.setattr(profiling.F, "percentile_approx", lambda *_: F.array(*[F.lit(2.0)] * 6))
    again = {x.nid: tuple(x)[1:] for x in profiling.catalog_quantiles(catalog, shares).collect()}
    assert again.pop(nothing) == (None, None, None) and again == want
