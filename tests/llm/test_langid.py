from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from siltstone.llm import langid
from tests.llm import fixtures


def test_forward_sums_all_segmentations():
    number = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "b▁"])}
    rng = np.random.default_rng(0)
    p = np.vstack([rng.random((len(number) + 1, 3)), np.zeros((1, 3))])

    def total(s, lang):
        if not s:
            return 1.0
        out = 0.0
        for n in range(1, len(s) + 1):
            k = number.get(s[:n], len(number) if n == 1 else None)
            if k is not None:
                out += p[k, lang] * total(s[n:], lang)
        return out

    for n in (1, 3, 5):
        words = ["".join("abc"[(i >> 2 * j) % 3] for j in range(n)) for i in range(20)]
        got = langid.Lattice(words, number).forward(p)
        for w, row in zip(words, got):
            for lang in range(3):
                assert math.isclose(row[lang], math.log(total(langid.START + w, lang)), abs_tol=1e-9)


def test_long_words_do_not_underflow():
    number = {"▁": 0, "a": 1}
    p = np.array([[1e-5], [1e-5], [1e-7], [0.0]])
    got = langid.Lattice(["a" * 500], number).forward(p)[0, 0]
    assert math.isclose(got, 501 * math.log(1e-5), rel_tol=1e-9)


def test_expectation_raises_the_likelihood():
    number = langid.pieces(langid.VOCABULARY)
    counts = {"en": Counter(langid.words_of(fixtures.ENGLISH))}
    score = []
    for rounds in (1, 2, 4):
        _, p = langid.fit(counts, number, rounds, smooth=1e-6)
        s = langid.Scorer(number, p)
        score.append(s.score([fixtures.ENGLISH])[0][0, 0])
    assert score[0] < score[1] < score[2]


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    truth = {r.doc_id: r for r in docs.select("doc_id", "lang", "text").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    n = right = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        t = truth[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t.text or ""))
        if r.held_out and t.lang and r.lang_pred != "und":
            n += 1
            right += r.lang_pred == t.lang
    assert n > 20 and right / n >= 0.9


def test_labels_are_no_inputs(spark, small):
    """Held-out rows get the same prediction whatever their labels and ids' order."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from pyspark.sql import functions as F

    hidden = docs.withColumn("lang", F.when(langid.held_out("doc_id"), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(d).filter("held_out").collect()} for d in (docs, hidden))
    assert a == b


def test_awkward_rows(spark):
    rows = fixtures.awkward() * 2
    got = langid.identify(fixtures.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = {x[1] for x in rows if x[0] == r.doc_id}
        if r.doc_id in (4, 5, 6, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif texts == {fixtures.SPANISH}:
            assert r.lang_pred == "es"
        elif texts == {fixtures.ENGLISH}:
            assert r.lang_pred == "en"
    kept = langid.keep_identified(fixtures.frame(spark, rows))
    assert kept.dtypes == fixtures.frame(spark, []).dtypes
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in fixtures.frame(spark, rows).collect() if langid.words_of(r.text))


def test_without_labels_or_rows(spark):
    none = fixtures.frame(spark, [fixtures.row(1, fixtures.ENGLISH, None)])
    assert [(r.lang_pred, r.score) for r in langid.identify(none).collect()] == [("und", 0.0)]
    assert langid.identify(fixtures.frame(spark, [])).count() == 0


def test_long_words_count_as_short_ones_do():
    """In logarithms or not, expected counts are the same; and words of any length are learned from."""
    number = langid.pieces(langid.VOCABULARY)
    p = langid.uniform(number)
    words, counts = ["unbelievable", "incontestable"[:12]], np.array([2.0, 3.0])
    lattice = langid.Lattice(words, number)
    assert np.allclose(langid.expected(words, counts, number, p), langid._expected_of_long(lattice, counts, p))
    long = "ab" * 3000
    got = langid.expected([long], np.array([1.0]), number, p)
    assert np.isfinite(got).all() and 100 < got.sum() <= len(long) + 1


def brute(texts, langs, p, number):
    """Likelihoods of whole texts by plain recursion over all segmentations, word by word."""
    def word(w, c):
        f = [1.0]
        for j in range(1, len(w) + 1):
            f.append(sum(f[i] * (p[number[w[i:j]], c] if w[i:j] in number else p[len(number), c] if j == i + 1 else 0.0) for i in range(max(0, j - langid.LONGEST), j)))
        return math.log(f[-1])

    return [[sum(word(langid.START + w, c) for w in langid.words_of(t)) for c in range(len(langs))] for t in texts]


def test_query_against_brute_force(spark, small):
    """The query's predictions and scores from a model fitted word by word, all segmentations summed."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    number = langid.pieces(langid.VOCABULARY)
    langs, p = langid.fit(langid.sample_counts(docs, "doc_id", "text", "lang", 300), number)
    rows = [r for r in docs.select("doc_id", "text").orderBy("doc_id").collect() if len(r.text or "") < 1500][:40]
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r, like in zip(rows, brute([r.text for r in rows], langs, p, number)):
        g = got[r.doc_id]
        if g.letters:
            assert g.lang_pred == langs[int(np.argmax(like))]
            assert math.isclose(g.score, 1 / sum(math.exp(x - max(like)) for x in like), rel_tol=1e-6)


def test_no_language_is_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    junk = [(10**6 + i, t, None) for i, t in enumerate(["Жук жужжит над лугом и не видит людей, которые идут по дороге к реке. " * 4, "日本語の文章です。" * 20, "#### 4821", "", None])]
    both = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in langid.keep_identified(both).collect()}
    assert not kept & {x[0] for x in junk}
    assert kept == {r.doc_id for r in docs.collect() if langid.words_of(r.text)}
