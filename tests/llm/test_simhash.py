from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from siltstone.llm import simhash
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    label = list(range(len(prints)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(spark):
    rows = [r for r in fixtures.awkward()] + [fixtures.row(100 + i, fixtures.ENGLISH + f" tail{i}") for i in range(20)]
    got = simhash.near_duplicates(fixtures.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [brute_print(r[1]) for r in rows]
    comp = brute_components(prints)
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", str(least.get(c))) for r, p, c in zip(rows, prints, comp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def random_prints(n, seed=3):
    """Clusters with chains of small steps, and loners."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 2, 5, 12))):
            out.append(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
    return sorted(set(out[:n]))


def test_shards_find_all_links(spark):
    x = random_prints(3000)
    signed = [v - 2**64 if v >= 2**63 else v for v in x]
    prints = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long")
    got = {r.fp: r.component_id for r in simhash.components(prints, 2, shard_size=100, sample=500).collect()}
    arr = np.array(x, np.uint64)
    comp = np.arange(len(x))
    pairs = [(i, j) for i in range(len(x)) for j in np.nonzero(simhash.distance(arr[i + 1 :], arr[i]) <= 2)[0] + i + 1]
    for _ in range(20):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert [got[f] for f in signed] == comp.tolist()


def test_a_set_that_no_vantage_point_splits():
    base = 0x123456789ABCDEF
    x = np.unique(np.array([base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)] + [base], np.uint64))
    assert len(set(simhash.classes(x, 2, leaf=64).tolist())) == 1
    assert len(set(simhash.classes(x, 0, leaf=64).tolist())) == len(x)


def components_of(spark, x, **limits):
    signed = [v - 2**64 if v >= 2**63 else v for v in x]
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long")
    got = {r.fp: r.component_id for r in simhash.components(rows, 2, **limits).collect()}
    return [got[f] for f in signed]


def test_large_balls_are_dealt_over_tasks(spark):
    """All fingerprints within two bits of a point, and others: nothing splits the ball, and no shard is left above its bound."""
    base = 0x0F1E2D3C4B5A6978
    x = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)} | set(random_prints(400, seed=9)))
    got = components_of(spark, x, shard_size=100, sample=4000)
    one = simhash.classes(np.array(x, np.uint64), 2).tolist()
    assert got == one
    distinct = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in x], "fp long")
    dealt, balls = simhash._deal(distinct, len(x), 2, 100, 4000)
    assert max(r["count"] for r in dealt.groupBy("shard").count().collect()) <= 200
    assert balls is not None and max(r["count"] for r in balls.filter("own").groupBy("shard", "part").count().collect()) <= 300


def test_shards_are_split_again(spark):
    """A sample too small for the first tree leaves large shards, which get trees of their own."""
    x = random_prints(4000, seed=5)
    distinct = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in x], "fp long")
    dealt, _ = simhash._deal(distinct, len(x), 2, 150, 200)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert max(sizes) <= 300 and len(sizes) > 12


def test_drop_keeps_one_row_of_each_group(spark):
    rows = fixtures.awkward()
    docs = fixtures.frame(spark, rows)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    comp = brute_components([brute_print(r[1]) for r in rows])
    assert set(got) <= set(rows) and len(got) == len(set(comp))
    for c in set(comp):
        ids = [r[0] for r, k in zip(rows, comp) if k == c]
        assert any(g[0] == min((i for i in ids if i is not None), default=None) for g in got)


def test_empty(spark):
    docs = fixtures.frame(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0
