from __future__ import annotations

import random

import numpy as np
import pytest

from siltstone.llm import decontaminate as dc
from tests.llm import fixtures


def words(r, n, prefix="w", size=3000):
    return [f"{prefix}{int(size * r.random() ** 2)}" for _ in range(n)]


def corpus(seed=1, n=120):
    """Documents of common words, some with a whole benchmark item, a paraphrase, or a scrap of one."""
    r = random.Random(seed)
    items = [(i, " ".join(words(r, r.choice((12, 40, 120)), f"q{i}x", 400))) for i in range(25)]
    rows, leaks = [], set()
    for d in range(n):
        text = words(r, r.choice((30, 300, 900)))
        if d % 4 == 0:
            i, body = r.choice(items)
            b = body.split()
            kind = r.choice(("whole", "paraphrase", "scrap"))
            if kind == "paraphrase":
                b = [w if r.random() < 0.88 else "zz" for w in b]
            if kind == "scrap":
                b = b[: max(2, len(b) // 6)]
            else:
                leaks.add((d, i))
            at = r.randrange(len(text))
            text[at:at] = b
        rows.append(fixtures.row(d, " ".join(text)))
    return rows, items, leaks


def bench(spark, items):
    return spark.createDataFrame([(*x, 1, "y") for x in items], "item_id long, text string, key int, answer string")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


def brute(rows, items, share):
    """Every item against every window of its length and a half, by plain longest common subsequence."""
    out = set()
    for r in rows:
        text = dc.words_of(r[1])
        for i, body in items:
            b = dc.words_of(body)
            if len(b) < 8 or len(set(b) & set(text)) < share * len(set(b)):
                continue
            step = max(1, len(b) // 2)
            if any(lcs(b, text[k : k + 2 * len(b)]) >= share * len(b) for k in range(0, len(text), step)):
                out.add((r[0], i))
    return out


def test_finds_planted_leaks_and_no_others(spark):
    rows, items, leaks = corpus()
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(fixtures.frame(spark, rows), bench(spark, items)).collect()}
    assert got == leaks == brute(rows, items, 0.75)


def test_clean_documents_stay(spark):
    rows, items, leaks = corpus(2)
    docs = fixtures.frame(spark, rows)
    out = dc.drop_leaks(docs, bench(spark, items))
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(r for r in rows if r[0] not in {d for d, _ in leaks})


def test_slices_give_the_same_leaks(spark):
    rows, items, leaks = corpus(3)
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(fixtures.frame(spark, rows), bench(spark, items), slice_words=300).collect()}
    assert got == leaks


def test_subsequence_by_bits():
    r = random.Random(5)
    for _ in range(100):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 30))] for _ in range(2))
        item = dc.Item(0, a, [], np.ones(6))
        assert item.lcs(b) == lcs(a, b) == pytest.approx(item.weighted_lcs(b))


def test_basis_spans_the_leading_singular_vectors(spark):
    rng = np.random.default_rng(0)
    counts = [rng.choice(40, size=30, p=np.arange(40, 0, -1) / 820).tolist() for _ in range(60)]
    weight = rng.random(40) + 0.1
    m = np.zeros((60, 40))
    for row, ids in zip(m, counts):
        np.add.at(row, ids, 1)
    m *= weight
    basis = dc.randomised_svd(spark.createDataFrame([(c,) for c in counts], "ids array<int>"), weight, 8, rounds=6)
    top = np.linalg.svd(m)[1][:8]
    assert basis.shape == (40, 8) and np.allclose(basis.T @ basis, np.eye(8), atol=1e-8)
    assert np.allclose(np.linalg.svd(m @ basis)[1], top, rtol=1e-3)


def test_awkward_rows(spark):
    items = [(1, fixtures.ENGLISH), (2, None), (3, ""), (4, "too short"), (1, fixtures.ENGLISH), (None, fixtures.SPANISH)]
    rows = fixtures.awkward()
    got = sorted((str(r.doc_id), str(r.item_id)) for r in dc.find_leaks(fixtures.frame(spark, rows), bench(spark, items)).collect())
    leaks = [r for r in rows if r[1] and (fixtures.ENGLISH in r[1].lower() or fixtures.SPANISH in r[1])]
    assert {d for d, _ in got} == {str(r[0]) for r in leaks}
    kept = dc.drop_leaks(fixtures.frame(spark, rows), bench(spark, items)).collect()
    assert len(kept) == len(rows) - len(leaks)


def test_empty_tables(spark):
    docs = fixtures.frame(spark, fixtures.awkward())
    assert dc.find_leaks(docs, bench(spark, [])).count() == 0 and dc.drop_leaks(docs, bench(spark, [])).count() == len(fixtures.awkward())
    assert dc.find_leaks(fixtures.frame(spark, []), bench(spark, [(1, fixtures.ENGLISH)])).count() == 0


def test_copies_do_not_depend_on_the_rank(spark):
    """With one latent dimension left, word-for-word copies of items and of halves of long ones are still found."""
    r = random.Random(7)
    items = [(i, " ".join(words(r, n, f"q{i}x", 400))) for i, n in enumerate((12, 40, 120, 300))]
    rows, want = [], set()
    for d in range(40):
        text = words(r, 200)
        if d % 2 == 0:
            b = items[d // 2 % 4][1].split()
            half = b[: len(b) // 2] if len(b) > 250 else b
            text[50:50] = half
            want.add((d, d // 2 % 4))
        rows.append(fixtures.row(d, " ".join(text)))
    got = {(x.doc_id, x.item_id) for x in dc.find_leaks(fixtures.frame(spark, rows), bench(spark, items), rank=1, min_cos=0.999).collect()}
    assert got == want
