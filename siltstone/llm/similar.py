"""Near copies by SimHash fingerprints and vantage-point trees, for stages.

Two texts link if the Jaccard similarity of their sets of word shingles is `similarity` or
more; of each component of links one row is kept. Words and white space are those of
`simhash.fingerprint`; a text of fewer than `width` words is one shingle.

1. Each text gets a SimHash fingerprint of 512 bits over its distinct shingles (64 hash bits
   are too few: at the radius that a similarity of 0.8 needs, 1 in 20 unrelated pairs of
   64-bit fingerprints would link). Bits of two texts differ with a probability that their
   similarity bounds (`flips`), so a number of differing bits, the radius, follows from
   `similarity`: it is 5.5 deviations above the mean, in all 512 bits, the first 64 and
   the first 128, and a pair that links is missed with a probability of 3e-6 at 0.8 and less above.
2. The first vantage point is the text without words: its distance to a text, by symmetric
   difference, is the text's number of shingles, and by the triangle inequality texts that
   link have numbers whose ratio is `similarity` at least. Its rings are that wide, so a text
   meets its own ring and the next; rings are dealt over tasks in parts (of 4,096
   fingerprints or 1/64 of all, if that is more), and every part meets every part. Each task builds a vantage-point tree over its fingerprints'
   Hamming distances, copying what lies within the radius of a boundary, and compares what
   no vantage point splits pair by pair, within the ratio of sizes. No pairs leave a task:
   it returns the class of each fingerprint that is within the radius of another.
3. Every text of a class is compared with the class's lead (its least text by a hash).
   Pairs within the radius are verified by exact Jaccard on their whole texts. Verified
   links are joined by connected components.
4. What is left are classes whose other texts still lie in several components. These texts
   are compared among themselves in blocks of bounded bytes, one task for each pair of
   blocks, closest first, and pairs that are connected already are skipped.

Exact within the radius: nothing is sampled or capped. Hot classes and hot leads (those with
more than 1/2000 of the rows, so at most 2,000 of them) are joined by broadcast or salted,
the others are small. Fingerprints of unrelated texts differ in about half their bits, so
Hamming distances split only what is clustered, and the comparisons of fingerprints (not of
texts) grow with the square of a ring.

Defined results: null, empty and blank texts are one group; a null id is kept only if its
group has no other; an empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.simhash import Labels
from siltstone.operators.components import connected_components
from siltstone.plans.shared import arrow_bounds, materialize

#: 64-bit words of a fingerprint, and what is stored: the number of shingles, then the words
WORDS = 8
PRINT = np.dtype([("size", "<u8"), ("words", "<u8", (WORDS,))])
DEVIATIONS = 5.5
SALTS = np.random.default_rng(17).integers(0, 2**64, WORDS, np.uint64)
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(32)
#: a class or lead is hot above this share of the rows, or above LEAST_HOT rows if that is more
HOT_SHARE, LEAST_HOT = 1 / 2000, 4096


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; empty if it has no words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        total = (total ^ h[k : k + n]) * MIX
        total ^= total >> SHIFT
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def fingerprint(s: np.ndarray) -> bytes:
    """The PRINT of a set of shingle hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(s), 255):  # counts of 255 rows fit a byte
        x = (s[a : a + 255, None] ^ SALTS) * MIX2
        x ^= x >> SHIFT
        x *= MIX
        x ^= x >> SHIFT
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.uint64(len(s)).tobytes() + np.packbits(2 * counts > len(s)).tobytes()


@functools.cache
def flips(similarity: float, top: int = 64) -> np.ndarray:
    """By the larger set's size (`top` stands for all above): the highest probability that a bit differs in sets that link."""

    def above(n: int, need: float) -> float:
        return sum(math.comb(n, i) for i in range(max(0, math.floor(need) + 1), n + 1)) / 2**n

    out = np.zeros(top + 1)
    for b in range(1, top + 1):
        for a in range(math.ceil(similarity * b - 1e-9), b + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            p = 0.0
            for k in range(both + 1 if both <= a else 0):
                x, y = above(a - both, a / 2 - k), above(b - both, b / 2 - k)
                p += math.comb(both, k) / 2**both * (x * (1 - y) + y * (1 - x))
            out[b] = max(out[b], p)
    out[top] = max(*out[top // 2 :], math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)
    return out


def radii(similarity: float, bits: int) -> np.ndarray:
    """By the larger set's size, as in `flips`: the most differing bits of sets that link."""
    p = flips(similarity)
    return np.floor(bits * p + DEVIATIONS * np.sqrt(bits * p * (1 - p))).astype(np.int64)


def radius_of(sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(sizes, len(table) - 1).astype(np.int64)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def near_classes(x: np.ndarray, side: np.ndarray, similarity: float, leaf: int = 2048, seed: int = 11) -> np.ndarray:
    """x: PRINTs; the least position of each one's class, by links within the radius among side 2 (a part with itself) or between sides 0 and 1."""
    labels, rng = Labels(len(x)), np.random.default_rng(seed)
    size, words = x["size"].astype(np.int64), np.ascontiguousarray(x["words"])
    first, second = (np.ascontiguousarray(x["words"][:, k]) for k in (0, 1))
    table = radii(similarity, 64 * WORDS)
    within = {k: int(radius_of(size, radii(similarity, 64 * k)).max(initial=0)) for k in (1, 2, WORDS)}
    radius = within[WORDS]
    by = np.argsort(size, kind="stable")
    own = bool((side == 2).all())
    stack = [(by[side[by] != 1], by[side[by] != 0])]
    while stack:
        rows, cols = stack.pop()
        if not len(rows) or not len(cols):
            continue
        if len(rows) + len(cols) > leaf:
            best = None
            for vp in rng.choice(cols, min(6, len(cols)), replace=False):
                d, e = distance(words[rows], words[vp]), distance(words[cols], words[vp])
                for m in {int(q) for q in np.quantile(e, (0.02, 0.1, 0.25, 0.5, 0.75))}:
                    work = int((d <= m + radius).sum()) * int((e <= m + radius).sum()) + int((d > m).sum()) * int((e > m).sum())
                    if best is None or work < best[0]:
                        best = work, m, d, e
            work, m, d, e = best
            if work <= 0.85 * len(rows) * len(cols):
                # a pair of which one is inside lies within m + radius, any other is outside
                stack += [(rows[d <= m + radius], cols[e <= m + radius]), (rows[d > m], cols[e > m])]
                continue
        sizes = size[cols]
        for a in range(0, len(rows), 64):
            part = rows[a : a + 64]
            lo = np.searchsorted(sizes, similarity * size[part[0]] - 1e-6)
            hi = np.searchsorted(sizes, size[part[-1]] / similarity + 1e-6, "right")
            for c in range(max(lo, a) if own else lo, hi, 4096):  # rows are the columns, in one order
                other = cols[c : min(hi, c + 4096)]
                hit = np.flatnonzero(np.bitwise_count(first[part][:, None] ^ first[other][None, :]) <= within[1])
                i, j = part[hit // len(other)], other[hit % len(other)]
                close = np.bitwise_count(first[i] ^ first[j]) + np.bitwise_count(second[i] ^ second[j]) <= within[2]
                i, j = i[close], j[close]
                apart = labels.of[i] != labels.of[j]
                i, j = i[apart], j[apart]
                less, more = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                near = (less >= similarity * more - 1e-6) & (distance(words[i], words[j]) <= radius_of(more, table))
                if near.any():
                    labels.merge(i[near], j[near])
    return labels.of


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)  # texts without words are equal
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def links_between(label: np.ndarray, x: np.ndarray, side: np.ndarray, text, similarity: float, width: int) -> list[tuple[int, int]]:
    """Links that join classes of `label` among the texts of side 2 (a block with itself) or between sides 0 and 1.

    x: PRINTs; text(i): the whole text of i."""
    links: list[tuple[int, int]] = []
    sets: dict[int, np.ndarray] = {}
    label = label.copy()

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(text(i), width)
        return sets[i]

    rows = np.nonzero(side != 1)[0]
    cols = np.nonzero(side != 0)[0]
    table = radii(similarity, 64 * WORDS)
    size, words = x["size"].astype(np.int64), np.ascontiguousarray(x["words"])
    for k in range(0, len(rows), 64):
        part = rows[k : k + 64]
        d = sum(np.bitwise_count(words[part, w][:, None] ^ words[cols, w][None, :]).astype(np.int16) for w in range(WORDS))
        a, b = np.nonzero(d <= radius_of(np.maximum(size[part][:, None], size[cols][None, :]), table))
        score, a, b = d[a, b], part[a], cols[b]
        by = np.argsort(score, kind="stable")
        a, b = a[by], b[by]
        while len(a):
            i, j, a, b = int(a[0]), int(b[0]), a[1:], b[1:]
            if label[i] != label[j] and alike(of(i), of(j), similarity):
                links.append((i, j))
                label[label == label[j]] = label[i]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
    return links


def as_prints(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), PRINT)


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """uid, print, id and the whole row, written to the shared folder."""
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    own = docs.select(docs[text_col].alias("text"), docs[id_col].cast("long").alias("id"), row)
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("print", T.BinaryType()), *own.schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            raw = b.column(0).cast(pa.binary()).to_pylist()
            made = [fingerprint(shingles(x or b"", width)) for x in raw]
            uids = np.arange(uid, uid + len(raw), dtype=np.int64)
            uid += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(made, pa.binary()), *b.columns[1:]], names=schema.names)

    return materialize(own.mapInArrow(run, schema), "similar-prints")


def _classes(prints: DataFrame, similarity: float, part_rows: int) -> DataFrame:
    """(key, uid): the texts of a class have one key; one row for each class of a text."""
    base = math.log((1 + 1e-6) / similarity)  # a little wide, so that rounding puts no link two rings apart

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = as_prints(b.column(0))["size"]
            rings = np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / base), -2).astype(np.int64)  # no words: a ring without neighbours
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rings)], names=["print", "uids", "ring"])

    counted = prints.groupBy("print").agg(F.count("*").alias("uids"))
    distinct = materialize(counted.mapInArrow(ring, "print binary, uids long, ring long"), "similar-distinct")
    sizes = {r.ring: r.n for r in distinct.groupBy("ring").agg(F.count("*").alias("n")).collect()}  # by logarithms of sizes: some tens
    most = max(part_rows, sum(sizes.values()) // 64)
    parts = {r: -(-n // most) for r, n in sizes.items()}
    rows = [(r, n, parts.get(r + 1, 0), parts.get(r - 1, 0)) for r, n in parts.items()]
    rings = prints.sparkSession.createDataFrame(rows, "ring long, parts int, above int, below int")
    own = distinct.join(F.broadcast(rings), "ring").withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    other = F.col("other")
    same = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("ring", F.lit(0).alias("up"), F.least("part", other).alias("i"), F.greatest("part", other).alias("j"), F.when(F.col("part") == other, 2).when(F.col("part") < other, 0).otherwise(1).alias("side"), "print")
    lower = own.filter("above > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("above") - 1))).select("ring", F.lit(1).alias("up"), F.col("part").alias("i"), other.alias("j"), F.lit(0).alias("side"), "print")
    upper = own.filter("below > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("below") - 1))).select((F.col("ring") - 1).alias("ring"), F.lit(1).alias("up"), other.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), "print")

    def classed(table: pa.Table) -> pa.Table:
        task = "/".join(str(table.column(c)[0].as_py()) for c in ("ring", "up", "i", "j")).encode()
        mine = table.column("print").to_pylist()
        of = near_classes(np.frombuffer(b"".join(mine), PRINT), table.column("side").to_numpy(), similarity)
        linked = np.nonzero(np.bincount(of, minlength=len(of))[of] > 1)[0]
        keys = np.array([xxhash.xxh64_intdigest(mine[k] + task) for k in of[linked].tolist()], np.uint64)
        return pa.table({"print": pa.array([mine[k] for k in linked.tolist()], pa.binary()), "key": keys.view(np.int64)})

    dealt = same.union(lower).union(upper)
    # few bytes, much work: a number of partitions that isn't lowered for small ones
    tasks = sum(n * (n + 1) // 2 + n * parts.get(r + 1, 0) for r, n in parts.items())
    dealt = dealt.repartition(max(1, min(tasks, 4096)), "ring", "up", "i", "j")
    found = materialize(dealt.groupBy("ring", "up", "i", "j").applyInArrow(classed, "print binary, key long"), "similar-classes")
    copies = distinct.filter("uids > 1")
    table = found.join(distinct.select("print", F.col("uids").alias("n")), "print").union(copies.select("print", F.xxhash64("print").alias("key"), F.col("uids").alias("n")))
    return _by_hot(prints.select("uid", "print"), materialize(table, "similar-keys"), "print", prints.count()).select("key", "uid")


def _by_hot(rows: DataFrame, table: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined with table (unique `on`, rows counted in its column n): hot keys, at most 1/HOT_SHARE, by broadcast."""
    hot = table.filter(F.col("n") > max(LEAST_HOT, int(total * HOT_SHARE)))
    if hot.isEmpty():
        return rows.join(table, on)
    cold = table.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def _beside_lead(edges: DataFrame, what: DataFrame, total: int) -> DataFrame:
    """edges (uid, lead) with what (uid, x) of both as x and y; leads of very many edges are salted."""
    degree = edges.groupBy("lead").agg(F.count("*").alias("n"))
    hot = degree.filter(F.col("n") > max(LEAST_HOT, int(total * HOT_SHARE))).withColumn("parts", F.ceil(F.col("n") / LEAST_HOT).cast("int")).drop("n")
    other = what.select(F.col("uid").alias("lead"), F.col("x").alias("y"))
    beside = edges.join(what, "uid")
    if hot.isEmpty():
        return beside.join(other, "lead")
    salted = beside.join(F.broadcast(hot), "lead", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = other.join(F.broadcast(hot), "lead", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return salted.join(copies, ["lead", "part"]).drop("part")


def _verified(edges: DataFrame, prints: DataFrame, text, similarity: float, width: int) -> DataFrame:
    """The edges (uid, lead) whose texts are alike."""
    total = edges.count()
    limits = radii(similarity, 64 * WORDS)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = as_prints(b.column("x")), as_prints(b.column("y"))
            yield b.select(["uid", "lead"]).filter(pa.array(distance(x["words"], y["words"]) <= radius_of(np.maximum(x["size"], y["size"]), limits)))

    printed = _beside_lead(edges, prints.select("uid", F.col("print").alias("x")), total).select("uid", "lead", "x", "y")
    close = materialize(printed.mapInArrow(near, "uid long, lead long"), "similar-close")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = (b.column(k).cast(pa.binary()) for k in ("x", "y"))
            fine = []
            for k, lead in enumerate(b.column("lead").to_pylist()):
                if lead not in kept:
                    if len(kept) >= 16:
                        kept.clear()
                    kept[lead] = shingles(y[k].as_py() or b"", width)
                fine.append(alike(shingles(x[k].as_py() or b"", width), kept[lead], similarity))
            yield b.select(["uid", "lead"]).filter(pa.array(fine, pa.bool_()))

    texts = _beside_lead(close, prints.select("uid", F.coalesce(text, F.lit("")).alias("x")), total).select("uid", "lead", "x", "y")
    return materialize(texts.mapInArrow(exact, "uid long, lead long"), "similar-links")


def _rest(members: DataFrame, prints: DataFrame, groups: DataFrame, text, similarity: float, width: int, block_bytes: int, total: int) -> DataFrame:
    """Links (uid, lead) within classes whose texts other than the lead lie in several components."""
    own = members.filter("n > 2 and uid <> lead").select("key", "uid")
    own = own.join(groups.withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", F.coalesce("component", "uid").alias("label"))
    size = prints.select("uid", (F.coalesce(F.octet_length(text), F.lit(0)) + 512).alias("bytes"))
    own = materialize(own.join(size, "uid"), "similar-rest")
    keys = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("bytes").alias("all"), F.count("*").alias("n")).filter("lo <> hi")
    keys = materialize(keys.select("key", F.ceil(F.col("all") / block_bytes).cast("int").alias("blocks"), "n"), "similar-open")
    mine = _by_hot(own.select("key", "uid", "label"), keys, "key", total).select("key", "uid", "label", "blocks", F.pmod(F.xxhash64("uid", "key"), F.col("blocks")).cast("int").alias("at"))
    pair = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "uid", "label", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.when(F.col("at") == F.col("other"), 2).when(F.col("at") < F.col("other"), 0).otherwise(1).alias("side"))
    full = pair.join(prints.select("uid", "print", F.coalesce(text, F.lit("")).alias("text")), "uid")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        uid, side = table.column("uid").to_numpy(), table.column("side").to_numpy()
        label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        x = as_prints(table.column("print"))
        texts = table.column("text").cast(pa.binary())
        links = links_between(label, x, side, lambda i: texts[i].as_py(), similarity, width)
        return pa.table({"uid": uid[[i for i, _ in links]].astype(np.int64), "lead": uid[[j for _, j in links]].astype(np.int64)})

    return materialize(full.groupBy("key", "i", "j").applyInArrow(compare, "uid long, lead long"), "similar-links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block_bytes: int = 8 << 20, part_rows: int = 4096) -> DataFrame:
    """Of each component the row with the smallest id (a null id only if there is no other), with the columns of docs."""
    names = docs.columns
    arrow_bounds(docs.sparkSession)
    prints = _prints(docs, id_col, text_col, width)
    text = F.col(f"row.c{names.index(text_col)}")
    classes = materialize(_classes(prints, similarity, part_rows), "similar-rows")
    least = F.min(F.struct(F.xxhash64("uid", "key").alias("h"), "uid"))
    leads = materialize(classes.groupBy("key").agg(least.alias("least"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("least.uid").alias("lead"), "n"), "similar-leads")
    total = (leads.agg(F.sum("n")).first()[0] or 0)
    members = materialize(_by_hot(classes, leads, "key", total).select("key", "uid", "lead", "n"), "similar-members")
    edges = materialize(members.filter("uid <> lead").select("uid", "lead").distinct(), "similar-edges")
    links = _verified(edges, prints, text, similarity, width)
    groups = connected_components(links, "uid", "lead")
    more = _rest(members, prints, groups, text, similarity, width, block_bytes, total)
    if not more.isEmpty():
        groups = connected_components(links.union(more), "uid", "lead")
    first = F.min(F.struct(F.col("id").isNull(), "id", "uid")).alias("first")
    grouped = groups.select(F.col("node").alias("uid"), F.col("component").alias("root")).join(prints.select("uid", "id"), "uid")
    best = grouped.groupBy("root").agg(first).select(F.col("first.uid").alias("uid"))
    gone = materialize(grouped.select("uid").join(best, "uid", "left_anti"), "similar-gone")
    out = prints.select("uid", "row").join(gone, "uid", "left_anti")
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)])
