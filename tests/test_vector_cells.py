"""Vectors in cells and in blocks."""

from __future__ import annotations

import numpy as np
import pytest

from siltstone.operators import vectors


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["random", "clusters", "one"])
def test_recall_in_cells(spark, kind):
    """Buckets of few rows miss most neighbours of random vectors; cells find them, however the vectors lie."""
    r = np.random.default_rng(4)
    x = {"random": r.standard_normal((4000, 64)), "clusters": np.repeat(r.standard_normal((20, 64)), 100, axis=0) + r.standard_normal((2000, 64)) * 0.05, "one": np.ones((300, 8)) + r.standard_normal((300, 8)) * 1e-3}[kind]
    df = frame(spark, x)
    asked = df.filter("vec_id % 20 = 0")
    exact = vectors.nearest(df, asked, "vec_id", "embedding")
    got = vectors.recall(exact, vectors.nearest_by_cells(df, asked, "vec_id", "embedding", block=256)).first()
    assert got.n_true == 10 * len(range(0, len(x), 20)) and got.recall >= 0.9


def test_blocks_meet_a_few_at_a_time(spark):
    """Whatever blocks meet in one task, results are those of all at once; Arrow batches of blocks are bounded by bytes."""
    r = np.random.default_rng(5)
    x = np.round(r.standard_normal((500, 3)), 1)  # many ties
    df = frame(spark, x)
    asked = df.filter("vec_id % 20 = 0")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    try:
        whole = sorted(map(tuple, vectors.nearest(df, asked, "vec_id", "embedding", 7, "euclidean").collect()))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 32 << 20
        assert whole == sorted(map(tuple, vectors.nearest(df, asked, "vec_id", "embedding", 7, "euclidean", block=40).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<float>")
    assert vectors.nearest_by_cells(empty, empty, "vec_id", "embedding").count() == 0
