"""Work on columns whose values don't fit a task: what the plans gather, and that results stay the same."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators import ontology, values
from siltstone.operators.prefix import running_sums
from siltstone.sources.catalog import Catalog

NUMBERS = [0.0, -0.0, 0.1, 0.1 + 0.2, 0.3, 1e-7, -1e-7, 5e-7, 1.5e-6, 2.5e-6, -0.5, 999999999.999999, 1e9 + 0.1, 123456789012.1234567, 8.9e12, 9e12, 1e20, 1e31, 1e40, float("nan"), float("inf"), None]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["double", "float", "long", "string", "boolean", "timestamp", "timestamp_ntz", "date"])
def test_coded_cells_stand_for_their_text(spark, kind):
    r = random.Random(2)
    rows = {
        "double": NUMBERS + [r.uniform(-1e6, 1e6) for _ in range(300)] + [(k + 0.5) / 1e6 for k in range(300)],
        "float": [x for x in NUMBERS if x is None or x != x or abs(x) < 1e38], "long": [-5, 0, 2**62, None], "string": [" A ", "a", "NaN", "", None], "boolean": [True, None],
        "timestamp": [dt.datetime(1969, 12, 31, 23, 59, 59, 5), dt.datetime(2024, 2, 29, 1, 2, 3), None], "timestamp_ntz": [dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), None], "date": [dt.date(2024, 2, 29), None],
    }[kind]
    df = spark.createDataFrame([(x,) for x in rows], f"c {kind}")
    t = df.schema[0].dataType
    i, s = cells.coded(*cells.raw(F.col("c"), t))
    got = df.select(cells.normal(cells.cell_text(F.col("c"), t)).alias("text"), i.alias("i"), s.alias("s")).withColumn("back", cells.decoded(F.col("i"), F.col("s"), F.lit(cells.code_kind(t)))).collect()
    assert all(x.text == x.back for x in got)
    for x in got:
        assert (x.text is None) == (x.i is None and x.s is None)
    assert len({x.text for x in got}) == len({(x.i, x.s) for x in got})


def test_no_task_gathers_the_values_of_a_column(spark):
    t = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("string").alias("s"))
    plan = plan_of(values.column_values(Catalog({"t": t, "u": t})))
    assert not re.search(r"hashpartitioning\(nid#\d+L?, \d+\)", plan)


def test_overlaps_are_counted_without_lists_and_sorts(spark):
    t = spark.range(300).select("id", (F.col("id") % 7).alias("x"))
    wide = spark.range(300).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(70)])  # more columns than bits of a number
    own = values.column_values(Catalog({"t": t, "wide": wide}))
    index = own.select("nid", "value")
    nids = sorted(r.nid for r in index.select("nid").distinct().collect())
    got = values.shared_values(own, nids, index.count())
    plan = plan_of(got)
    assert "collect_list" not in plan and "SortAggregate" not in plan
    want = values.co_occurrence(index, ["value"], "nid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "SortAggregate" not in plan_of(values.similarities(own))


def test_running_sums_gather_no_group(spark):
    rows = spark.createDataFrame([(k % 2, float(k), 1) for k in range(100)], "g int, x double, n long")
    got = running_sums(rows, ["g"], "x", ["n"], ranges=8)
    assert "SortMergeJoin" not in plan_of(got)
    assert all(r.cum_n == r.x // 2 + 1 for r in got.collect())


def test_pieces_of_values_are_not_shuffled(spark):
    own = spark.createDataFrame([("t", "c", "asja"), ("t", "c", "europe"), ("t", "d", "nothing")], "source string, column_name string, value string")
    classes = spark.createDataFrame([(1, "region", None), (2, "asia", 1), (3, "europe", 1)], "class_id int, name string, parent_id int")
    got = ontology.match_content_fuzzy(own, classes, 0.1, 0.6)
    assert not re.search(r"hashpartitioning\([^)]*piece#", plan_of(got))
    assert [tuple(r) for r in got.collect()] == [("t", "c", 1, 1.0)]
