"""The stage's fingerprints and vantage-point trees against all pairs."""

from __future__ import annotations

import numpy as np

from siltstone.llm import similar
from tests.llm import fixtures
from tests.llm.test_similar import copies, kept_of


def brute_classes(x, side, similarity):
    tables, of = {k: similar.radii(similarity, 64 * k) for k in (1, 2, similar.WORDS)}, np.arange(len(x))
    for i in range(len(x)):
        for j in range(i):
            a, b = sorted((int(x["size"][i]), int(x["size"][j])))
            meet = side[i] == side[j] == 2 or {side[i], side[j]} == {0, 1}
            if meet and a >= similarity * b - 1e-9:
                bits = [int(v).bit_count() for v in x["words"][i] ^ x["words"][j]]
                if all(sum(bits[:k]) <= t[min(b, len(t) - 1)] for k, t in tables.items()) and of[i] != of[j]:
                    of[of == max(of[i], of[j])] = min(of[i], of[j])
    return of


def clustered(n, seed):
    """Fingerprints around a few centres, with loners, and sizes of which some are too far apart to link."""
    rng = np.random.default_rng(seed)
    x = np.zeros(n, similar.PRINT)
    centres = rng.integers(0, 2**64, (6, similar.WORDS), np.uint64)
    for k in range(n):
        flip = np.packbits((rng.random(64 * similar.WORDS) < rng.choice((0.02, 0.1, 0.2, 0.5))).astype(np.uint8)).view(np.uint64)
        x["words"][k] = centres[rng.integers(6)] ^ flip
    x["size"] = rng.choice((90, 100, 111, 140), n)
    return x


def test_trees_find_the_classes_of_all_pairs():
    for seed in (1, 2, 3):
        x = clustered(220, seed)
        for side in (np.full(len(x), 2), np.arange(len(x)) % 2):
            for leaf in (16, 10**6):
                assert similar.near_classes(x, side, 0.8, leaf=leaf).tolist() == brute_classes(x, side, 0.8).tolist()


def test_vantage_points_split_clusters(monkeypatch):
    """Far clusters are not compared with each other."""
    x = clustered(1200, 4)
    rng = np.random.default_rng(5)
    near = np.packbits((rng.random((1200, 64 * similar.WORDS)) < 0.03).astype(np.uint8), axis=1).view(np.uint64)
    x["words"] = np.repeat(x["words"][:4], 300, axis=0) ^ near
    x["size"] = 100
    seen = []
    real = np.flatnonzero
    monkeypatch.setattr(similar.np, "flatnonzero", lambda a: seen.append(a.size) or real(a))
    of = similar.near_classes(x, np.full(1200, 2), 0.8, leaf=64)
    assert len(set(of.tolist())) <= 4 and sum(seen) < 0.6 * 1200 * 1200 / 2


def test_texts_that_link_are_within_the_radius():
    rng = np.random.default_rng(6)
    for both in (4, 8, 16, 40, 200):
        for _ in range(300):
            more = int(both / 0.8 - both + 1e-9)
            cut = both + int(rng.integers(0, more + 1))
            u = rng.integers(0, 2**64, both + more, np.uint64)
            x = np.frombuffer(similar.fingerprint(np.sort(u[:cut])) + similar.fingerprint(np.sort(np.append(u[:both], u[cut:]))), similar.PRINT)
            assert len(set(similar.near_classes(x, np.full(2, 2), 0.8).tolist())) == 1


def test_parts_of_rings_meet(spark):
    rows = fixtures.awkward() + copies(10)
    for part_rows in (3, 20):
        out = similar.drop_similar(fixtures.frame(spark, rows), part_rows=part_rows)
        assert sorted((r.doc_id for r in out.collect()), key=str) == kept_of(rows)
