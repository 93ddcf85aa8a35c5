from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators import profiling
from siltstone.operators import values as vx
from siltstone.operators.prefix import running_sums
from siltstone.sources.catalog import Catalog, column_id
from siltstone.streaming import incremental

GEO = ["POINT(41.919365236 -87.769726946)", "(41.90643°, -87.703717°)", "68712 W. Belden Ave. Chicago, IL (41.921134, -87.798468)"]
STREET = ["23RD ST", "1958 North Milwaukee Avenue", "68712 W. Belden Ave. Chicago, IL"]
CASES = {"geo": (GEO, "SPATIAL", "geoCoordinate"), "street": (STREET, "SPATIAL", "street"), "zip": (["60007", "68712 IL"], "SPATIAL", "zipCode"), "state": (["IL"], "SPATIAL", "state"), "day": (["2020-01-02 00:00:00", "2021-01-02T00:00:00Z", "Monday"], "TEMPORAL", "day"), "mixed": (["2020-01-02 00:00:00", "Monday"], "NONE", None), "second": (["2020-01-02T03:04:05"], "TEMPORAL", "second"), "none": (["hello", "x y"], "NONE", None), "blank": (["", " ", None], "NONE", None)}


def test_semantic_types(spark):
    lake = Catalog({k: spark.createDataFrame([(v,) for v in vs], "x string") for k, (vs, _, _) in CASES.items()})
    got = {r.source: (r.semantic_type, r.granularity) for r in profiling.semantic_types(lake).collect()}
    assert got == {k: (t, g) for k, (_, t, g) in CASES.items()}


def test_integers_and_numbers(spark):
    ints = ["0", "9", "23", "9772", "-324", "54", "-23432456", "13457143587"]
    lake = Catalog({"a": spark.createDataFrame([(v, v + ".5", "1,234.5", "x1") for v in ints] + [(None, "nan", "", None)], "i string, f string, c string, s string")})
    assert {r.column_name: r.inferred for r in profiling.infer_types(lake).collect()} == {"i": "INT", "f": "FLOAT", "c": "FLOAT", "s": "STRING"}
    got = {r.column_name: (r.n_numbers, r.sum_numbers) for r in profiling.cast_cells(lake).collect()}
    assert got["c"] == (8, pytest.approx(8 * 1234.5)) and got["s"] == (0, 0.0)


def test_clean_cells(spark):
    rows = [("ann", 1.5), (" bob", None), ("cat  e", 2.0), ("NaN", float("nan")), ("", 1.0), (None, 2.0), ("x y", 3.0), ("\t", 4.0)]
    lake = Catalog({"t": spark.createDataFrame(rows, "s string, d double"), "none": spark.createDataFrame([], "s string")})
    got = {(r.source, r.column_name): (r.total, r.missing, r.untidy, r.clean) for r in profiling.cleanliness(lake).collect()}
    assert got == {("t", "s"): (8, 3, 3, 0.25), ("t", "d"): (8, 2, 0, 0.75)}


def test_profile_of_awkward_columns(spark):
    rows = [(1, float("nan"), "a", [1]), (0, -2.5, " ", None), (None, None, None, [2]), (-7, float("inf"), "A", [])]
    p = {r.column_name: r for r in profiling.profile(Catalog({"t": spark.createDataFrame(rows, "n int, d double, s string, arr array<int>")})).collect()}
    assert set(p) == {"n", "d", "s"}
    assert (p["n"].total, p["n"].non_null, p["n"].non_empty, p["n"].min_value, p["n"].max_value) == (4, 3, 2, -7, 1)
    assert p["d"].max_value == 0 and p["d"].avg_value == 0  # NaN and infinity are scrubbed
    assert (p["s"].non_null, p["s"].non_empty, p["s"].min_value, p["s"].data_type) == (3, 2, None, "T")
    assert p["n"].nid == column_id("lake", "t", "n")


def test_empty_table(spark):
    lake = Catalog({"t": spark.createDataFrame([], "n int, s string")})
    assert vx.column_values(lake).count() == 0
    assert profiling.profile(lake).count() == 0  # no cells


def test_exact_quantiles_and_running_sums(spark):
    import random

    r = random.Random(1)
    x = [r.choice((r.random() * 100, 7.0, -3.0)) for _ in range(2000)]
    counts = spark.createDataFrame([(1, v) for v in x], "nid long, x double").groupBy("nid", "x").agg(F.count("*").alias("cnt"))
    got = profiling.exact_quantiles(counts, {"a": 0.25, "b": 0.5, "c": 0.99}).first()
    s = sorted(x)
    assert (got.a, got.b, got.c) == (s[499], s[999], s[1979])
    cum = running_sums(counts, ["nid"], "x", ["cnt"], ranges=8).collect()
    assert all(row.cum_cnt == sum(v <= row.x for v in x) for row in cum)


def test_distinct_estimate_is_close(spark):
    n = 20_000
    lake = Catalog({"t": spark.range(n).select(F.col("id").cast("string").alias("s"))})
    got = profiling.profile(lake, profiling.ProfileConfig(semantic=False)).first().unique_values
    assert abs(got - n) < 0.05 * n


def test_normalisation(spark):
    df = spark.createDataFrame([(v,) for v in (" A ", "NaN", "null", "", "x")], "s string")
    assert [r[0] for r in df.select(cells.normal(F.col("s"))).collect()] == ["a", None, None, None, "x"]
    d = spark.createDataFrame([(0.0, 1e-9), (1234.5, -0.1)], "a double, b double")
    assert [tuple(r) for r in d.select(cells.cell_text(F.col("a"), d.schema["a"].dataType), cells.cell_text(F.col("b"), d.schema["b"].dataType)).collect()] == [("0.000000", "0.000000"), ("1234.500000", "-0.100000")]


def test_stream_profiles_merge(spark, tmp_path):
    data = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"))
    for k in range(3):
        data.filter(F.col("id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        q = incremental.profile_stream(spark.readStream.schema(data.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "lake", "t", f"{tmp_path}/state", f"{tmp_path}/check")
        q.awaitTermination()
    got = {r.column_name: r for r in incremental.current(spark, f"{tmp_path}/state").collect()}
    assert (got["id"].total, got["id"].min_value, got["id"].max_value) == (1000, 0, 999)
    assert got["id"].avg_value == pytest.approx(499.5) and got["s"].unique_values == 7 and abs(got["id"].unique_values - 1000) < 50
    incremental.compact(spark, f"{tmp_path}/state", f"{tmp_path}/one")
    assert incremental.current(spark, f"{tmp_path}/one").filter("column_name = 'id'").first().total == 1000
