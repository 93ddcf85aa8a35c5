"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their whole text into buckets; a bucket that is too
large is partitioned again by another hash, until each fits an open-addressing table that
compares complete contents. Plan:

1. `collapse`: each scan task folds its own copies in a table (flushed at `bucket_bytes`),
   so a text that makes up a third of the corpus leaves each task once. The result, one
   row per record and one per local group, is written to the shared folder: those are the
   spill files that later levels read, and they survive a lost executor.
2. `route`: bucket sizes are summed in Spark; buckets above `bucket_bytes` that hold more
   than one hash get another level, by another hash, until none is left (an error is raised
   if `levels` are not enough). Buckets of a single hash are copies of one text and need no
   more room than that text.
3. `settle`: one shuffle of local groups by bucket. A bucket of the first level has a
   partition of its own; the parts of split ones are dealt over all partitions and sorted,
   and each task starts a new table for each bucket, so it holds one bucket at a time.

Defined results: a null text counts as empty; a null id is smaller than any id; of rows
that tie in text and id exactly one stays; an empty input gives an empty result. Only the
two named columns are looked at, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.content_table import ContentTable
from siltstone.plans.shared import arrow_bounds, materialize

LEAST = -(2**63)


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def _schema(row: T.DataType | None) -> T.StructType:
    fields = [("uid", T.LongType()), ("id", T.LongType()), ("rep", T.LongType()), ("h", T.LongType()), ("text", T.StringType()), ("n", T.LongType()), ("top_id", T.LongType()), ("top_uid", T.LongType())]
    return T.StructType([T.StructField(a, b) for a, b in fields] + ([T.StructField("row", row)] if row is not None else []))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _collapse(schema: T.StructType, room: int, rows: bool):
    """rows: one output row per record; else the group's top record is carried whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)
        uid = TaskContext.get().partitionId() << 33
        table, held, offset = ContentTable(), [], 0
        reps, ns, tops, top_at = [], [], [], []

        def flush() -> pa.RecordBatch:
            k = len(table)
            cols = {"rep": reps, "h": [_signed(h) for h in table.hashes], "n": ns, "top_id": [None if t[0] == LEAST else t[0] for t in tops], "top_uid": [t[1] for t in tops], "uid": [None] * k, "id": [None] * k}
            arrays = {a: pa.array(v, pa.int64()) for a, v in cols.items()}
            arrays["text"] = pa.array(table.contents, pa.binary()).cast(pa.string())
            if not rows:
                arrays["row"] = pa.concat_arrays(held).take(pa.array(top_at, pa.int64()))
            return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) for f in out], schema=out)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            if not rows:
                held.append(b.column(2))
            mine = []
            for j, (key, raw) in enumerate(zip(ids, texts)):
                raw = raw or b""
                e, new = table.find_or_add(xxhash.xxh3_64_intdigest(raw), raw)
                top = (LEAST if key is None else key, uid)
                if new:
                    reps.append(uid)
                    ns.append(1)
                    tops.append(top)
                    top_at.append(offset + j)
                else:
                    ns[e] += 1
                    if top > tops[e]:
                        tops[e], top_at[e] = top, offset + j
                mine.append((uid, key, reps[e]))
                uid += 1
            offset += len(ids)
            if rows and mine:
                u, k, r = zip(*mine)
                done = {"uid": u, "id": k, "rep": r}
                yield pa.RecordBatch.from_arrays([pa.array(done[f.name], f.type) if f.name in done else pa.nulls(len(mine), f.type) for f in out], schema=out)
            if table.bytes > room or offset > 200_000:
                yield flush()
                table, held, offset = ContentTable(), [], 0
                reps, ns, tops, top_at = [], [], [], []
        if len(table):
            yield flush()

    return run


def _route(groups: DataFrame, bucket_bytes: int, levels: int) -> DataFrame:
    """The local groups dealt by bucket, with the bucket of the last level that each needs as their first column."""
    size = F.octet_length("text") + F.lit(64)
    total = groups.agg(F.sum(size)).first()[0] or 0
    fan = max(1, math.ceil(2 * total / bucket_bytes))
    names = groups.columns
    routed = groups.withColumns({"place": F.pmod("h", F.lit(fan)).cast("int"), "bucket": F.pmod("h", F.lit(fan))})
    level = 0
    while True:
        sizes = routed.groupBy("bucket").agg(F.sum(size).alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        large = sizes.filter((F.col("b") > bucket_bytes) & (F.col("lo") != F.col("hi"))).select("bucket", F.lit(True).alias("large"))
        if large.isEmpty():
            break
        level += 1
        if level > levels:
            raise RuntimeError(f"buckets above {bucket_bytes} bytes are left after {levels} levels")
        again = F.xxhash64("h", F.lit(level))
        split = F.col("bucket") * 16 + F.when(F.col("large"), F.pmod(again, F.lit(16))).otherwise(F.lit(0))
        place = F.when(F.col("large"), F.pmod(F.xxhash64(split), F.lit(fan)).cast("int")).otherwise(F.col("place"))
        routed = routed.join(large, "bucket", "left").withColumns({"place": place, "bucket": split}).drop("large")
        routed = materialize(routed, "grace-level")
    dealt = routed.repartitionById(fan, "place").select("bucket", *names)
    return dealt.sortWithinPartitions("bucket") if level else dealt


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The batches without their first column, cut where it changes; and whether a new bucket starts."""
    last = None
    for b in batches:
        bucket = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(np.diff(bucket))[0] + 1).tolist(), len(bucket)]
        for x, y in zip(cuts, cuts[1:]):
            if x < y:
                yield last is None or last != bucket[x], pa.RecordBatch.from_arrays(b.slice(x, y - x).columns[1:], names=b.schema.names[1:])
                last = bucket[x]


class _Bucket:
    """One bucket's table, and what is carried for its groups."""

    def __init__(self, schema: pa.Schema, rows: bool) -> None:
        self.schema, self.rows, self.table = schema, rows, ContentTable()
        self.held: list[pa.Array] = []
        self.offset = 0
        self.reps: list[int] = []
        self.groups: list[int] = []
        self.ns: list[int] = []
        self.tops: list[tuple[int, int]] = []
        self.top_at: list[int] = []

    def add(self, b: pa.RecordBatch) -> None:
        cols = [c.to_pylist() for c in b.columns[:5]]
        texts = b.column(5).cast(pa.binary()).to_pylist()
        if not self.rows:
            self.held.append(b.column(6))
        for j, (rep, h, n, key, uid, raw) in enumerate(zip(*cols, texts)):
            e, new = self.table.find_or_add(h & 0xFFFFFFFFFFFFFFFF, raw)
            top = (LEAST if key is None else key, uid)
            if new:
                self.ns.append(n)
                self.tops.append(top)
                self.top_at.append(self.offset + j)
            else:
                self.ns[e] += n
                if top > self.tops[e]:
                    self.tops[e], self.top_at[e] = top, self.offset + j
            self.reps.append(rep)
            self.groups.append(e)
        self.offset += len(texts)
        if not self.rows and self.offset > 50_000 and len(self.table) < self.offset // 2:
            # keep only the carried rows that still lead a group
            self.held, self.offset = [pa.concat_arrays(self.held).take(pa.array(self.top_at, pa.int64()))], len(self.top_at)
            self.top_at = list(range(len(self.top_at)))

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            sha = [hashlib.sha256(c).hexdigest() for c in self.table.contents]
            for at in range(0, len(self.reps), 10_000):
                g = self.groups[at : at + 10_000]
                top = [self.tops[e] for e in g]
                cols = [self.reps[at : at + 10_000], [None if t[0] == LEAST else t[0] for t in top], [t[1] for t in top], [self.ns[e] for e in g]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array([sha[e] for e in g], pa.string())], schema=self.schema)
        elif self.held:
            kept = pa.concat_arrays(self.held)
            for at in range(0, len(self.top_at), 1000):
                part = kept.take(pa.array(self.top_at[at : at + 1000], pa.int64()))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(part.flatten(), self.schema)], schema=self.schema)


def _settle(schema: T.StructType, rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)
        now = _Bucket(out, rows)
        for new, b in _by_bucket(batches):
            if new:
                yield from now.done()
                now = _Bucket(out, rows)
            now.add(b)
        yield from now.done()

    return run


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20, levels: int = 12) -> DataFrame:
    """One row per record: id, keep_id, group_size, kept, text_sha256 (the id column keeps its name)."""
    arrow_bounds(docs.sparkSession)
    schema = _schema(None)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spill = materialize(own.mapInArrow(_collapse(schema, bucket_bytes, True), schema), "grace-spill")
    groups = _route(spill.filter(F.col("n").isNotNull()).select("rep", "h", "n", "top_id", "top_uid", "text"), bucket_bytes, levels)
    out = T.StructType([T.StructField("rep", T.LongType()), T.StructField("keep_id", T.LongType()), T.StructField("keep_uid", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType())])
    settled = groups.mapInArrow(_settle(out, True), out)
    records = spill.filter(F.col("uid").isNotNull()).select("uid", "id", "rep")
    return records.join(settled, "rep").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20, levels: int = 12) -> DataFrame:
    """The rows that stay, with the columns of docs: of equal texts the row with the largest id."""
    arrow_bounds(docs.sparkSession)
    names = docs.columns
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(names) if c != text_col])
    schema = _schema(row_type := docs.select(row.alias("row")).schema["row"].dataType)
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), row.alias("row"), docs[text_col].isNull().alias("void"))
    own = own.select("id", "text", F.struct("row", "void").alias("row"))
    schema = _schema(own.schema["row"].dataType)
    spill = materialize(own.mapInArrow(_collapse(schema, bucket_bytes, False), schema), "grace-spill")
    groups = _route(spill.select("rep", "h", "n", "top_id", "top_uid", "text", "row"), bucket_bytes, levels)
    carried = T.StructType([T.StructField("row", row_type), T.StructField("void", T.BooleanType()), T.StructField("text", T.StringType())])
    out = carried
    whole = F.struct(F.col("row.row").alias("row"), F.col("row.void").alias("void"), F.col("text")).alias("row")
    settled = groups.select("bucket", "rep", "h", "n", "top_id", "top_uid", "text", whole).mapInArrow(_settle(out, False), out)
    text = F.when(~F.col("void"), F.col("text"))
    return settled.select(*[(text if c == text_col else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(names)])


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
