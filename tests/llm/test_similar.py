from __future__ import annotations

import random

import corpus_pipeline
from siltstone.llm import similar
from tests.llm import fixtures


def shingle_set(text, width=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def alike(a, b, similarity=0.8):
    return a == b or len(a & b) >= similarity * len(a | b) - 1e-9


def kept_of(rows, similarity=0.8):
    """All pairs, then the smallest id of each component."""
    sets, label = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j], similarity):
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for r, c in zip(rows, label):
        groups.setdefault(c, []).append(r[0])
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)


def copies(seed=8, n=60):
    """Texts with copies of 0 to 12 changed words, and chains of them."""
    r, rows = random.Random(seed), []
    for _ in range(n):
        w = [f"w{r.randrange(500)}" for _ in range(r.choice((3, 20, 60, 200)))]
        for _ in range(r.choice((1, 2, 5))):
            rows.append(fixtures.row(len(rows) + 100, " ".join(w)))
            for _ in range(r.choice((0, 1, 2, 12))):
                w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
    return rows


def test_stage_drops_what_brute_force_drops(spark):
    rows = fixtures.awkward() + copies()
    docs = fixtures.frame(spark, rows)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows)
    want = kept_of(rows)
    assert sorted((r[0] for r in got), key=str) == want and len(want) < len(rows)


def test_shards_and_thresholds(spark):
    rows = copies(9)
    for similarity in (0.8, 0.95):
        out = similar.drop_similar(fixtures.frame(spark, rows), similarity=similarity, block_bytes=4000)
        assert sorted(r.doc_id for r in out.collect()) == kept_of(rows, similarity)


def test_one_word_changed_in_sixty_is_a_near_copy(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [fixtures.row(1, " ".join(w)), fixtures.row(2, " ".join(w[:30] + ["other"] + w[31:])), fixtures.row(3, " ".join(w[30:] + w[:15]))]
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, fixtures.frame(spark, rows), "").orderBy("doc_id").collect()] == [1, 3]


def test_empty(spark):
    assert corpus_pipeline.drop_near_copies(spark, fixtures.frame(spark, []), "").count() == 0
