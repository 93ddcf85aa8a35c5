"""Nearest neighbours of vectors: exact in blocks, and by hashed buckets.

Exact: query vectors and data vectors are packed in blocks; every block of queries meets
every block of data in one matrix product, which returns the best `k` of the block only,
and a query's blocks are merged by a second top-k. The queries are a stated set, so this is
work for queries x rows, but what is shuffled is a block once per block of queries.

Cells: centers fitted on a bounded sample divide the rows; a query meets, in blocks as
above, the rows of as many nearest cells as the sample asks for to find 95 % of neighbours.
Where directions are random that is half of the cells or more, in any number of dimensions
that makes neighbours far.

Buckets: random hyperplanes give each vector a key in each of several tables; a query also
looks into the buckets that differ in one bit. Rows are indexed all. Only keys are shuffled
into buckets; distinct candidates then fetch the vectors, and distances are exact. A hot
bucket is dealt over `salts` parts. Their recall falls as random vectors get more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.shared import arrow_bounds, materialize

METRICS = ("cosine", "euclidean", "manhattan")


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        qn, xn = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (q, x))
        return 1 - qn @ xn.T
    if metric == "euclidean":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))
    if metric == "manhattan":
        return np.stack([np.abs(x - row).sum(axis=1) for row in q]) if len(q) else np.zeros((0, len(x)))
    raise ValueError(f"{metric}: one of {METRICS}")


def _blocks(own: DataFrame) -> DataFrame:
    """own: cell, block, key, v -> cell, block, keys binary (int64), data binary (float64)."""

    def pack(table: pa.Table) -> pa.Table:
        keys, v = table.column("key").combine_chunks().to_numpy(), table.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({"cell": table.column("cell")[:1], "block": table.column("block")[:1], "keys": pa.array([keys.astype(np.int64).tobytes()], pa.binary()), "data": pa.array([v.astype(float).tobytes()], pa.binary())})

    return own.groupBy("cell", "block").applyInArrow(pack, "cell int, block int, keys binary, data binary")


def _dealt(own: DataFrame, block: int) -> tuple[DataFrame, dict[int, int]]:
    """own: cell, key, v -> the same with a block of about `block` rows, and how many blocks each cell has."""
    n = {r.cell: max(1, math.ceil(r.n / block)) for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    known = own.sparkSession.createDataFrame(list(n.items()), "cell int, blocks int")
    return own.join(F.broadcast(known), "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), n


def _meet(rows: DataFrame, queries: DataFrame, k: int, metric: str, block: int, digits: int, together: int = 8) -> DataFrame:
    """rows, queries: cell, key, v -> query, neighbor, distance: the k best of each pair of blocks of one cell. One join key
    has a block of queries and at most about `together` blocks of rows, however many rows a cell has."""
    spark = rows.sparkSession
    arrow_bounds(spark)  # a batch of blocks must fit a Python worker
    data, n = _dealt(rows, block)
    asked, m = _dealt(queries, block)
    plan = spark.createDataFrame([(c, q, math.ceil(n[c] / together)) for c in n if c in m for q in range(m[c])], "cell int, q int, salts int")  # metadata
    many = F.broadcast(plan.groupBy("cell").agg(F.collect_list("q").alias("qs"), F.max("salts").alias("salts")))
    left = _blocks(data).join(many, "cell").select("cell", F.explode("qs").alias("q"), (F.col("block") % F.col("salts")).alias("salt"), "keys", "data")
    right = _blocks(asked).join(F.broadcast(plan.withColumnRenamed("q", "block")), ["cell", "block"]).select("cell", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("keys").alias("qk"), F.col("data").alias("qd"))
    met = left.join(right, ["cell", "q", "salt"]).select("keys", "data", "qk", "qd")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, raw, qids, qraw = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(b.columns, (np.int64, float, np.int64, float)))
                x, q = raw.reshape(len(ids), -1), qraw.reshape(len(qids), -1)
                found = [_best(q[s : s + 256], qids[s : s + 256], x, ids, k, metric, digits) for s in range(0, len(q), 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query", "neighbor", "distance"])

    return met.mapInArrow(search, "query long, neighbor long, distance double")


def _best(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, neighbor, distance of the k nearest rows of each query by rounded distance and then key, itself left out."""
    d = distances(q, x, metric)
    d[qids[:, None] == ids[None, :]] = np.inf
    # what rounding can bring level with the k-th stays
    bound = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(q), np.inf)
    at, of = np.nonzero((d <= bound[:, None] + 2 * 10.0**-digits) & np.isfinite(d))
    near = np.round(d[at, of], digits) + 0.0
    order = np.lexsort((ids[of], near, at))
    at, of, near = at[order], of[order], near[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < k
    return qids[at[keep]], ids[of[keep]], near[keep]


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine", block: int = 4096, digits: int = 6) -> DataFrame:
    """query, neighbor, distance, rank: the exact k nearest rows of each query, itself left out; ties go to the smaller key."""
    one = lambda df: _filled(df, key, vector).withColumn("cell", F.lit(0))
    return _top(_meet(one(rows), one(queries), k, metric, block, digits), k)


def fit_cells(rows: DataFrame, vector: str, k: int, metric: str, target: float = 0.95, cells: int = 128, sample: int = 20_000, seed: int = 3, digits: int = 6) -> tuple[np.ndarray, int]:
    """Centers of cells, and how many cells a query must look into. Both come from a sample of about `sample` rows (by hash):
    centers by k-means, the number as the least that finds `target` of the k nearest rows of sampled queries among the sample.
    With all rows neighbours are nearer, so that more are found."""
    n = max(1, rows.count())
    own = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(vector).cast("array<double>").alias("v"))
    x = np.array([r.v for r in own.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < math.ceil(min(1.0, sample / n) * (1 << 20))).collect()], float)
    if len(x) < 2:
        return (x if len(x) else np.zeros((1, 1))), 1
    x = x[np.lexsort(x.T)]  # the same in every run
    rng = np.random.default_rng(seed)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centers = x[rng.choice(len(x), min(cells, max(1, len(x) // 16)), replace=False)]
    for _ in range(8):
        own_cell = np.concatenate([distances(x[s : s + 1024], centers, metric).argmin(axis=1) for s in range(0, len(x), 1024)])
        centers = np.stack([x[own_cell == j].mean(axis=0) if (own_cell == j).any() else c for j, c in enumerate(centers)])
    own_cell = np.concatenate([distances(x[s : s + 1024], centers, metric).argmin(axis=1) for s in range(0, len(x), 1024)])
    some = rng.choice(len(x), min(500, len(x)), replace=False)
    d = distances(x[some], x, metric)
    d[np.arange(len(some)), some] = np.inf
    d, kth = np.round(d, digits), min(k, len(x) - 1) - 1
    at, of = np.nonzero(d <= np.partition(d, kth, axis=1)[:, kth : kth + 1])  # with all that are level with the k-th
    rank = np.argsort(np.argsort(distances(x[some], centers, metric), axis=1), axis=1)
    needed = np.sort(rank[at, own_cell[of]])
    return centers, int(needed[max(0, math.ceil(target * len(needed)) - 1)]) + 1


def in_cells(rows: DataFrame, key: str, vector: str, centers: np.ndarray, metric: str, probes: int = 1) -> DataFrame:
    """cell, key, v: each row in its `probes` nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            near = np.argsort(distances(x, centers, metric), axis=1, kind="stable")[:, :probes]
            for s in range(near.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(near[:, s].astype(np.int32)), b.column(0), b.column(1)], names=["cell", "key", "v"])

    return _filled(rows, key, vector).mapInArrow(run, "cell int, key long, v array<double>")


def nearest_by_cells(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine", target: float = 0.95, block: int = 4096, digits: int = 6) -> DataFrame:
    """query, neighbor, distance, rank among the rows of the query's nearest cells (approximate). Every row is in its cell."""
    centers, probes = fit_cells(rows, vector, k, metric, target, digits=digits)
    own = materialize(in_cells(rows, key, vector, centers, metric), "vector-cells")
    asked = materialize(in_cells(queries, key, vector, centers, metric, probes), "vector-queries")
    return _top(_meet(own, asked, k, metric, block, digits), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def hyperplanes(dims: int, bits: int, tables: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def binary_keys(rows: DataFrame, key: str, vector: str, planes: np.ndarray, probe: bool) -> DataFrame:
    """key, table, bucket: signs of projections; with probe also the buckets one bit away. Vectors stay where they are."""
    tables, bits, _ = planes.shape
    shared = planes  # bits x dims numbers for each table
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).to_pylist()
            if not v:
                continue
            sign = np.einsum("tbd,nd->ntb", shared, np.array(v, float)) > 0
            own = sign @ weights
            for t in range(tables):
                buckets = own[:, t : t + 1] ^ np.concatenate([[0], weights])[None, :] if probe else own[:, t : t + 1]
                at = np.repeat(np.arange(len(v)), buckets.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), t, np.int32)), pa.array(buckets.reshape(-1))], names=["key", "table", "bucket"])

    return _filled(rows, key, vector).mapInArrow(run, "key long, table int, bucket long")


def _filled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v, without null and empty vectors."""
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))


def discretized_keys(rows: DataFrame, key: str, vector: str, planes: np.ndarray, width: float) -> DataFrame:
    """key, table, bucket (text): floors of projections over the bin width."""
    tables = planes.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).to_pylist()
            if not v:
                continue
            bins = np.floor(np.einsum("tbd,nd->ntb", planes, np.array(v, float)) / width).astype(int)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(v), t, np.int32)), pa.array(["_".join(map(str, x)) for x in bins[:, t]], pa.string())], names=["key", "table", "bucket"])

    own = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "key long, table int, bucket string")


def principal_planes(rows: DataFrame, vector: str, bits: int, sample: int = 10_000) -> np.ndarray:
    """Hyperplanes along the principal components of a bounded sample (by hash; every row is indexed)."""
    n = max(1, rows.count())
    own = rows.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    part = own.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)))
    x = np.array([r.v for r in part.collect()], float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return axes[None, :bits]


def nearest_by_buckets(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine", tables: int = 16, per_bucket: int = 256, seed: int = 3, salts: int = 8, digits: int = 6) -> DataFrame:
    """query, neighbor, distance, rank among the rows that share a bucket with the query (approximate)."""
    first = rows.select(F.size(vector).alias("n")).filter("n > 0").first()
    planes = hyperplanes(first.n if first else 1, max(2, round(math.log2(max(4, rows.count() / per_bucket)))), tables, seed)
    x = binary_keys(rows, key, vector, planes, False).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    q = binary_keys(queries, key, vector, planes, True).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    met = q.withColumnRenamed("key", "query").join(x, ["table", "bucket", "salt"]).filter("query <> key").select("query", "key").distinct()
    both = met.join(_filled(rows, key, vector), "key").join(_filled(queries, key, vector).select(F.col("key").alias("query"), F.col("v").alias("w")), "query").select("query", "key", "v", "w")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, w = (np.asarray(c.flatten()).reshape(b.num_rows, -1) for c in (b.column(2), b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(paired(w, v, metric), digits) + 0.0)], names=["query", "neighbor", "distance"])

    return _top(both.mapInArrow(measure, "query long, neighbor long, distance double"), k)


def paired(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of q from the same row of x."""
    if metric == "cosine":
        return 1 - (q * x).sum(axis=1) / np.maximum(np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1), 1e-300)
    if metric == "euclidean":
        return np.linalg.norm(q - x, axis=1)
    if metric == "manhattan":
        return np.abs(q - x).sum(axis=1)
    raise ValueError(f"{metric}: one of {METRICS}")


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """n_true, n_found, recall over all queries."""
    hit = exact.select("query", "neighbor").join(approximate.select("query", "neighbor"), ["query", "neighbor"], "left_semi")
    n = exact.agg(F.count("*").alias("n_true"))
    m = hit.agg(F.count("*").alias("n_found"))
    return n.crossJoin(F.broadcast(m)).withColumn("recall", F.when(F.col("n_true") > 0, F.col("n_found") / F.col("n_true")).otherwise(1.0))  # one row each


def within(found: DataFrame, threshold: float) -> DataFrame:
    """Neighbours nearer than the threshold."""
    return found.filter(F.col("distance") < threshold)
