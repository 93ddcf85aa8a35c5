from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from siltstone.llm import exact_dedup
from siltstone.llm.content_table import ContentTable
from tests.llm import fixtures


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


def check(spark, rows, **limits):
    want = brute(rows)
    by_sha = {v[2]: v for v in want.values()}
    got = exact_dedup.label_copies(fixtures.frame(spark, rows).repartition(3), **limits).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256][:2]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) and {r.text_sha256 for r in kept} == set(by_sha)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_labels(spark):
    check(spark, fixtures.awkward())


def test_buckets_are_split_until_they_fit(spark):
    rows = [fixtures.row(i, f"text number {i % 400} " * 5) for i in range(1200)]
    check(spark, rows + fixtures.awkward(), bucket_bytes=2000)


def test_too_few_levels_raise(spark):
    rows = [fixtures.row(i, f"text number {i} " * 5) for i in range(300)]
    with pytest.raises(RuntimeError):
        exact_dedup.label_copies(fixtures.frame(spark, rows), bucket_bytes=200, levels=1)


def test_a_task_starts_a_table_for_each_bucket():
    """Batches cut where the bucket changes, also across batches; a table never sees two buckets."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(range(len(b)))], names=["bucket", "x"]) for b in ([1, 1, 2], [2, 2], [], [3])]
    assert [(new, b.num_rows) for new, b in exact_dedup._by_bucket(iter(batches))] == [(True, 2), (True, 1), (False, 2), (True, 1)]


def test_dropped_rows_keep_their_columns(spark):
    rows = fixtures.awkward()
    docs = fixtures.frame(spark, rows)
    out = exact_dedup.drop_copies(docs, bucket_bytes=4000)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(brute(rows)) and set(got) <= set(rows)
    assert {(r[0], r[1] or "") for r in got} == {(keep, t) for t, (keep, *_) in brute(rows).items()}


def test_null_text_stays_null(spark):
    out = exact_dedup.drop_copies(fixtures.frame(spark, [fixtures.row(1, None), fixtures.row(0, "")])).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, None)]


def test_empty_table(spark):
    docs = fixtures.frame(spark, [])
    assert exact_dedup.label_copies(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_table_compares_content_not_hashes():
    t = ContentTable(4)
    found = [t.find_or_add(5, c) for c in (b"a", b"b", b"a", b"c", b"d", b"e", b"b")]
    assert found == [(0, True), (1, True), (0, False), (2, True), (3, True), (4, True), (1, False)]
