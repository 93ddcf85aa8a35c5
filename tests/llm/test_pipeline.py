from __future__ import annotations

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from siltstone.llm import decontaminate, langid
from tests.llm import fixtures
from tests.llm.test_decontaminate import brute as leaks_of
from tests.llm.test_mixing import WORD, water
from tests.llm.test_similar import kept_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = fixtures.awkward() + [fixtures.row(100 + i, f"{fixtures.ENGLISH} and then number {i} said something else entirely about {i * 7} things", source="ab"[i % 2]) for i in range(30)]
    rows += [fixtures.row(200, "a passage of the benchmark that nobody should ever have seen before the day of the test itself ok")]
    fixtures.frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, rows[-1][1]), (2, "another item that no document holds in any form at all here now")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def brute(rows, items):
    """The stages on lists of rows."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    best = {}
    for r in rows:
        if r[1] not in best or (best[r[1]][0] is None or (r[0] is not None and r[0] > best[r[1]][0])):
            best[r[1]] = r
    rows = list(best.values())
    stay = set(kept_of(rows))
    rows = [r for r in rows if r[0] in stay]
    bad = {d for d, _ in leaks_of(rows, items, 0.75)}
    rows = [r for r in rows if r[0] not in bad]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    return rows, sizes


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "mixing"]


def test_run_against_brute_force(spark, folder):
    d, rows = folder
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    kept, sizes = brute(rows, items)
    out = corpus_pipeline.run(spark, d)
    got = out.collect()
    names = fixtures.frame(spark, []).columns
    assert set(names) <= set(out.columns)
    taken = defaultdict(int)
    by_id = {r[0]: r for r in kept}
    for r in got:
        assert r.doc_id in by_id and r.text == by_id[r.doc_id][1]
        taken[r.source] += r.taken
    want = water(dict(sizes))
    assert {s: n for s, n in taken.items() if n} == {s: int(want[s]) for s in want if int(want[s])}
    assert 200 not in {r.doc_id for r in got}


def test_each_stage_keeps_the_columns(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), d).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), d).count() == 0


def test_language_keeps_everything_with_letters(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.identify_language(spark, docs, d).count()
    assert got == sum(bool(langid.words_of(r[1])) for r in rows)
    assert decontaminate.words_of(None) == []
