from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.operators import drift, relations, sketches, textsearch
from siltstone.operators import values as vx
from siltstone.operators.components import connected_components
from siltstone.sources.catalog import Catalog


def lake(spark, tables: dict[str, list[str | None]]) -> Catalog:
    return Catalog({t: spark.createDataFrame([(v,) for v in vs], "c string") for t, vs in tables.items()})


def test_similarity_laws(spark):
    r = random.Random(3)
    sets = {f"t{i}": [str(r.randrange(30)) for _ in range(r.choice((0, 3, 20, 60)))] + [None, " "] for i in range(8)}
    got = {(p.source1, p.source2): p for p in vx.similarities(vx.column_values(lake(spark, sets))).collect()}
    clean = {t: {v for v in vs if v and v.strip()} for t, vs in sets.items()}
    want = {(a, b) for a in clean for b in clean if a < b and clean[a] & clean[b]}
    assert set(got) == want
    for (a, b), p in got.items():
        x, y = clean[a], clean[b]
        assert p.overlap == len(x & y) and p.jaccard == pytest.approx(len(x & y) / len(x | y))
        assert p.containment == pytest.approx(max(len(x & y) / len(x), len(x & y) / len(y))) and 0 < p.jaccard <= p.containment <= 1


def test_keys_and_cardinality(spark):
    v = vx.column_values(lake(spark, {"pk": [str(i) for i in range(10)], "fk": ["1", "1", "2", "3"], "other": ["x"]}))
    pairs = vx.similarities(v)
    assert [(r.source1, r.source2, r.weight) for r in relations.keys(pairs).collect()] == [("fk", "pk", 1.0)]
    assert [(r.source1, r.join_card) for r in relations.join_cardinality(pairs).collect()] == [("fk", "N-1")]


def test_minhash_error_bound(spark):
    k = 256
    tables = {"a": [f"w{i}" for i in range(400)], "b": [f"w{i}" for i in range(100, 500)], "c": [f"w{i}" for i in range(395, 900)]}
    v = vx.column_values(lake(spark, tables))
    for sig in (sketches.signatures(v, k), sketches.one_permutation(v, k)):
        s = {r.source: r.signature for r in sig.collect()}
        assert all(len(x) == k for x in s.values())
        for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
            j = len(set(tables[x]) & set(tables[y])) / len(set(tables[x]) | set(tables[y]))
            est = sum(p == q for p, q in zip(s[x], s[y])) / k
            assert abs(est - j) <= 4 * (j * (1 - j) / k) ** 0.5 + 0.03
    pairs = sketches.band_candidates(sketches.signatures(v, 64), *sketches.banding(0.5, 64)).collect()
    assert ("a", "b") in {(p.source1, p.source2) for p in pairs}


def test_banding_matches_known_parameters():
    assert sketches.banding(0.5, 64) == (14, 4) and sketches.banding(0.2, 64)[1] == 2


def test_numeric_overlap_against_all_pairs(spark):
    r = random.Random(5)
    rows = [(f"t{i}", "c", r.choice((0.0, r.uniform(-1e3, 1e3), r.uniform(0, 1))), r.choice((0.0, 0.5, r.uniform(0, 1e3)))) for i in range(40)]
    got = {(x.source1, x.source2): x.overlap for x in relations.numeric_overlaps(spark.createDataFrame(rows, "source string, column_name string, median double, iqr double"), 0.5).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[3] > 0 and b[3] > 0:
                l, h, x, y = a[2] - a[3], a[2] + a[3], b[2] - b[3], b[2] + b[3]
                o = (y - x) if l <= x and y <= h else (h - x) if l <= x <= h else (y - l) if l <= y <= h else 0
                if round(o / (h - l), 6) >= 0.5:
                    want[a[0], b[0]] = round(o / (h - l), 6)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_density_clusters_against_brute_force(spark):
    r = random.Random(7)
    pts = {f"p{i:02}": (r.choice((0, 0, 3)) + r.gauss(0, 0.3), r.gauss(0, 0.4)) for i in range(50)}
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()], "k string, x double, y double")
    got = {x.k: x.cluster for x in relations.dense_clusters(df, "k", ["x", "y"], 0.3, 4).collect()}
    near = {a: [b for b in pts if (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 <= 0.09] for a in pts}
    core = {a for a in pts if len(near[a]) >= 4}
    label = {a: a for a in core}
    for _ in range(60):
        for a in core:
            label[a] = min(label[b] for b in near[a] if b in core)
    for a in pts:
        own = label.get(a) or min((label[b] for b in near[a] if b in core), default=None)
        assert got[a] == own


def test_components_against_union_find(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(200), 1000 + r.randrange(200)) for _ in range(120)] + [(5000, 5000), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    adj = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            adj[a].add(b)
            adj[b].add(a)
    seen = {}
    for n in sorted(adj):
        if n not in seen:
            stack = [n]
            while stack:
                m = stack.pop()
                if m not in seen:
                    seen[m] = n
                    stack += adj[m]
    assert got == seen


def test_search_edges_cases(spark):
    v = vx.column_values(lake(spark, {"a": ["red ring", "blue ring"], "b": ["green bolt"], "e": [None]}))
    assert textsearch.search(v, "...").count() == 0
    assert [r.source for r in textsearch.search(v, "ring bolt", conjunctive=True).collect()] == []
    assert [r.source for r in textsearch.search(v, "RING").collect()] == ["a"]
    assert {r.value for r in textsearch.autocomplete(v, "gre", 2).collect()} == {"green bolt", "red ring"}
    assert [(r.source, r.distance) for r in textsearch.fuzzy_search(v, "rang").collect()] == [("a", 1)]


def test_drift(spark):
    old, new = (vx.column_values(Catalog({"t": spark.createDataFrame(rows, "a string, b string")})) for rows in ([("1", "x"), ("2", "y")], [("2", "x"), ("3", "y")]))
    d = drift.column_drift(old, new)
    assert {r.column_name: r.jaccard for r in d.collect()} == {"a": pytest.approx(1 / 3, abs=1e-6), "b": 1.0}
    found = drift.changed(d, 0.9)
    q = drift.detection_quality(found, spark.createDataFrame([("t", "a"), ("t", "b")], "source string, column_name string")).first()
    assert (q.precision, q.recall, q.f1) == (1.0, 0.5, pytest.approx(2 / 3))
    est = drift.estimated_drift(sketches.signatures(old, 32), sketches.signatures(new, 32)).filter(F.col("column_name") == "b").first()
    assert est.estimate == 1.0
