"""SimHash near-duplicate detection with vantage-point trees.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 values of a
text's word shingles (repeats included). Texts link if their fingerprints differ in at
most `radius` bits; components of links are groups.

1. Fingerprints are computed where the texts are scanned and written to the shared folder.
2. Distinct fingerprints (a group of copies is one from here on) are dealt to shards by
   vantage-point trees. At a node with vantage point v and radius m a fingerprint x goes
   inside if d(x, v) <= m, else outside; by the triangle inequality an outside fingerprint
   can link to an inside one only if d(x, v) <= m + radius, so only those are copied inside
   as well. Every linked pair then meets in a shard. A tree is fitted on a bounded sample
   (`sample` fingerprints and an eighth of all at most, in expectation, chosen by hash);
   every fingerprint is routed. A node is split while the sample says that it holds over
   1.6 times `shard_size`, so a tree has no level that its shards do not need: each level
   copies about a fifth of the rows. Shards that still exceed twice `shard_size`, for which
   the sample was too small, get a tree of their own, until none is left but those that no
   vantage point splits.
3. Each shard builds its own tree to small leaves and compares pairs there. It returns one
   row per linked fingerprint with the least fingerprint of its class, never pairs. A large
   shard that nothing splits is a ball of few bits; its fingerprints are dealt over tasks
   that each look up the flips of their own part in the whole ball.
4. Classes that share a fingerprint are joined by connected components in Spark.

Exact: no cap on partners or candidates. Defined results: null, empty and blank texts have
fingerprint zero; a null id is not a candidate for the smallest id (component_id is null
only if all ids of the component are); repeated rows keep their rows; an empty table gives
an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.components import connected_components
from siltstone.plans.shared import arrow_bounds, materialize


def fingerprint(raw: bytes, width: int = 3) -> bytes:
    """Eight bytes, most significant first. bytes.lower and bytes.split know ASCII only, as wanted."""
    words = raw.lower().split()
    if not words:
        return bytes(8)
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*[words[i : n + i] for i in range(width)])) if len(words) >= width else iter([b" ".join(words)])
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    while part := [digest(x, 42) for x in itertools.islice(shingles, 16384)]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def _prints(width: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            raw = b.column(0).cast(pa.binary()).to_pylist()
            prints = np.frombuffer(b"".join([fingerprint(x or b"", width) for x in raw]), ">i8").astype(np.int64)
            uids = np.arange(uid, uid + len(raw), dtype=np.int64)
            uid += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(prints), *b.columns[1:]], names=schema.names)

    return run


def fingerprints(docs: DataFrame, text_col: str, carry: DataFrame | list, width: int = 3) -> DataFrame:
    """uid, fp and the carried columns (aliased by the caller), written to the shared folder."""
    arrow_bounds(docs.sparkSession)
    own = docs.select(F.col(text_col).alias("text"), *carry)
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("fp", T.LongType()), *own.schema.fields[1:]])
    return materialize(own.mapInArrow(_prints(width, schema), schema), "simhash-prints")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Node:
    """A vantage point, its radius and two subtrees; a leaf has a shard number."""

    __slots__ = ("vp", "mu", "inside", "outside", "shard")

    def __init__(self, shard: int = -1) -> None:
        self.shard = shard


def fit_tree(sample: np.ndarray, most: float, radius: int, seed: int = 7) -> tuple[Node, int]:
    """A tree whose leaves hold `most` points of the sample at most, where vantage points split it, and their number."""
    rng, shards = np.random.default_rng(seed), itertools.count()

    def build(x: np.ndarray) -> Node:
        if len(x) <= most:
            return Node(next(shards))
        best = None
        for vp in rng.choice(x, min(8, len(x)), replace=False):
            d = distance(x, vp)
            for mu in {int(np.median(d)), int(np.median(d)) - 1}:
                inside, copied = int((d <= mu).sum()), int(((d > mu) & (d <= mu + radius)).sum())
                cost = max(inside + copied, len(x) - inside) + copied
                if best is None or cost < best[0]:
                    best = cost, vp, mu, d
        _, vp, mu, d = best
        inside, outside = x[d <= mu + radius], x[d > mu]
        if max(len(inside), len(outside)) > 0.9 * len(x):  # a ball
            return Node(next(shards))
        node = Node()
        node.vp, node.mu = vp, mu
        node.inside, node.outside = build(inside), build(outside)
        return node

    root = build(sample)
    return root, next(shards)


def route(node: Node, x: np.ndarray, radius: int, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in x) for each shard that is reached."""
    at = np.arange(len(x)) if at is None else at
    if not len(at):
        return
    if node.shard >= 0:
        yield node.shard, at
        return
    d = distance(x[at], node.vp)
    yield from route(node.inside, x, radius, at[d <= node.mu + radius])
    yield from route(node.outside, x, radius, at[d > node.mu])


class Labels:
    """Union-find over positions, merged in bulk; a label is the least position of its class."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        of = self.of
        while True:
            a, b = of[i], of[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = of[of]
                if np.array_equal(up, of):
                    break
                of[:] = up


def classes(x: np.ndarray, radius: int, leaf: int = 512, seed: int = 11) -> np.ndarray:
    """x: sorted distinct fingerprints (uint64); the least position of each one's class."""
    labels, rng, stack = Labels(len(x)), np.random.default_rng(seed), [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) <= leaf:
            i, j = np.nonzero(np.triu(distance(x[at][:, None], x[at][None, :]) <= radius, 1))
            labels.merge(at[i], at[j])
            continue
        for vp in x[rng.choice(at, 4)]:
            d = distance(x[at], vp)
            mu = int(np.median(d))
            for m in (mu, mu - 1):
                near, far = int((d <= m + radius).sum()), int((d > m).sum())
                if max(near, far) <= 0.85 * len(at):
                    break
            else:
                continue
            stack += [at[d <= m + radius], at[d > m]]
            break
        else:
            _dense(x[at], at, radius, labels)
    return labels.of


def _flips(y: np.ndarray, own: np.ndarray, at: np.ndarray, radius: int, labels: Labels) -> None:
    """Links of the fingerprints at positions `own` of the sorted set y, by flipping bits."""
    for k in range(1, radius + 1):
        for bits in itertools.combinations(range(64), k):
            probe = y[own] ^ np.uint64(sum(1 << b for b in bits))
            pos = np.searchsorted(y, probe)
            pos[pos == len(y)] = 0
            hit = np.nonzero(y[pos] == probe)[0]
            labels.merge(at[own[hit]], at[pos[hit]])


def _dense(y: np.ndarray, at: np.ndarray, radius: int, labels: Labels) -> None:
    """All pairs of a set that no vantage point splits: in blocks, or by flipping bits if that is less work."""
    flips = sum(math.comb(64, k) for k in range(1, radius + 1))
    if len(y) > 100 * flips:
        return _flips(y, np.arange(len(y)), at, radius, labels)
    for s in range(0, len(y), 256):
        i, j = np.nonzero(distance(y[s : s + 256, None], y[None, s:]) <= radius)
        labels.merge(at[s + i], at[s + j])


def _trees(crowd: DataFrame, sizes: dict[int, int], radius: int, shard_size: int, sample: int) -> dict[int, tuple[Node, int]]:
    """crowd: shard, fp -> a tree and its number of leaves for each shard; each is fitted in a task on a sample of its shard."""
    rows = []
    for shard, n in sizes.items():
        rate = min(1 / 8, sample / n)
        rows.append((shard, rate, max(32.0, 1.6 * shard_size * rate)))  # below 32 points a sample says too little
    rates = crowd.sparkSession.createDataFrame(rows, "shard long, rate double, most double")
    chosen = crowd.join(F.broadcast(rates), "shard").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.col("rate") * F.lit(1 << 20))  # shards of over 2 * shard_size

    def fit(table: pa.Table) -> pa.Table:
        points = np.sort(table.column("fp").to_numpy().view(np.uint64))
        tree = fit_tree(points, table.column("most")[0].as_py(), radius)
        return pa.table({"shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    made = chosen.groupBy("shard").applyInArrow(fit, "shard long, tree binary").collect()  # a node for each 32 sampled fingerprints
    return {r.shard: pickle.loads(r.tree) for r in made}


def _deal(distinct: DataFrame, n: int, radius: int, shard_size: int, sample: int) -> tuple[DataFrame, DataFrame | None]:
    """fp -> (shard, fp) of shards of bounded size, and (shard, fp, part, own) of larger ones that nothing splits, by parts."""
    limit = 2 * shard_size
    crowd = distinct.select(F.lit(0).cast("long").alias("shard"), "fp")
    sizes, done, balls, first = {0: n} if n > limit else {}, None if n > limit else crowd, None, 1
    while sizes:
        trees, offset = _trees(crowd, sizes, radius, shard_size, sample), {}
        for shard, (_, leaves) in sorted(trees.items()):
            offset[shard] = first
            first += leaves

        def route_all(batches: Iterator[pa.RecordBatch], trees=trees, offset=offset) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shards, x = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
                for shard in np.unique(shards).tolist():
                    mine = x[shards == shard]
                    tree, _ = trees.get(shard, (None, 0))
                    for leaf, at in route(tree, mine, radius) if tree else [(None, np.arange(len(mine)))]:
                        to = shard if leaf is None else offset[shard] + leaf
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), to)), pa.array(mine[at].view(np.int64)), pa.array(np.full(len(at), shard))], names=["shard", "fp", "parent"])

        routed = materialize(crowd.mapInArrow(route_all, "shard long, fp long, parent long"), "simhash-shards")
        large = routed.groupBy("shard", "parent").count().filter(F.col("count") > limit).collect()  # one in `limit` fingerprints at most
        # a part that hardly shrank is a ball
        stuck = {r["shard"]: r["count"] for r in large if r["count"] > 0.9 * sizes[r["parent"]]}
        sizes = {r["shard"]: r["count"] for r in large if r["shard"] not in stuck}
        kinds = distinct.sparkSession.createDataFrame([(s, s in stuck) for s in [*stuck, *sizes]], "shard long, ball boolean")
        fits = routed.join(F.broadcast(kinds), "shard", "left_anti").select("shard", "fp")
        done = fits if done is None else done.union(fits)
        if stuck:
            parts = distinct.sparkSession.createDataFrame([(s, -(-c // limit)) for s, c in stuck.items()], "shard long, parts int")
            ball = routed.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            ball = ball.select("shard", "fp", "part", (F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part")).alias("own"))
            balls = ball if balls is None else balls.union(ball)
        crowd = routed.join(F.broadcast(kinds.filter("not ball")), "shard").select("shard", "fp")
    return done, balls


def components(prints: DataFrame, radius: int = 2, shard_size: int = 4096, sample: int = 32768) -> DataFrame:
    """prints: fp, id -> fp, root (one fingerprint of the component), component_id (its smallest id), one row per fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("lo")), "simhash-distinct")

    def classed(x: np.ndarray, of: np.ndarray) -> pa.Table:
        linked = np.bincount(of, minlength=len(x))[of] > 1
        return pa.table({"fp": x[linked].view(np.int64), "cls": x[of[linked]].view(np.int64)})

    def link(table: pa.Table) -> pa.Table:
        x = np.unique(table.column("fp").to_numpy().view(np.uint64))
        return classed(x, classes(x, radius))

    def link_part(table: pa.Table) -> pa.Table:
        x, at = np.unique(table.column("fp").to_numpy().view(np.uint64), return_index=True)
        labels = Labels(len(x))
        _flips(x, np.nonzero(table.column("own").to_numpy(zero_copy_only=False)[at])[0], np.arange(len(x)), radius, labels)
        return classed(x, labels.of)

    dealt, balls = _deal(distinct.select("fp"), distinct.count(), radius, shard_size, sample)
    found = dealt.groupBy("shard").applyInArrow(link, "fp long, cls long")
    if balls is not None:
        found = found.union(balls.groupBy("shard", "part").applyInArrow(link_part, "fp long, cls long"))
    member = materialize(found.distinct(), "simhash-classes")
    own = member.groupBy("fp").agg(F.min("cls").alias("own"), F.max("cls").alias("other"))
    # a fingerprint of several classes joins them, each to its least one
    many = own.filter("own < other").select("fp", "own")
    edges = materialize(member.join(many, "fp").filter("cls <> own").select(F.col("own").alias("a"), F.col("cls").alias("b")).distinct(), "simhash-edges")
    roots = own.select("fp", "own")
    if not edges.isEmpty():
        joined = connected_components(edges, "a", "b").withColumnRenamed("node", "own")
        roots = roots.join(joined, "own", "left").select("fp", F.coalesce("component", "own").alias("own"))
    least = distinct.join(roots, "fp").groupBy("own").agg(F.min("lo").alias("least"))
    grouped = roots.join(least, "own").select("fp", "own", "least")
    return distinct.join(grouped, "fp", "left").select("fp", F.coalesce("own", "fp").alias("root"), F.when(F.col("own").isNotNull(), F.col("least")).otherwise(F.col("lo")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id."""
    prints = fingerprints(docs, text_col, [F.col(id_col).alias("id")], width)
    out = prints.select("id", "fp").join(components(prints, radius), "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """Of each component the row with the smallest id (a null id only if there is no other), with the columns of docs."""
    names = docs.columns
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)]).alias("row")
    prints = fingerprints(docs, text_col, [docs[id_col].cast("long").alias("id"), row], width)
    roots = components(prints.select("fp", "id"), radius).select("fp", "root")
    first = F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("first")
    kept = prints.select("uid", "fp", "id").join(roots, "fp").groupBy("root").agg(first).select(F.col("first.uid").alias("uid"))
    out = prints.select("uid", "row").join(kept, "uid", "left_semi")
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)])
