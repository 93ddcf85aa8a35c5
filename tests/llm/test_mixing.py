from __future__ import annotations

import random
import re

import duckdb
import pytest

from siltstone.llm import mixing
from tests.agree import assert_agree
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes: dict, weights=(5, 2, 1), share=1.5, epochs=2):
    """Clamp and reshare until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = set(order), share * sum(sizes.values()), {}
    while left:
        level = total / sum(w[s] for s in left)
        full = {s for s in left if level * w[s] > epochs * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in left}
        for s in full:
            out[s] = float(epochs * sizes[s])
            total -= out[s]
        left -= full
    return out


def test_targets_are_the_fixed_point(spark):
    r = random.Random(2)
    for _ in range(6):
        sizes = {s: r.choice((0, 3, 10, 50, 400)) for s in [*"abcdefg"[: r.randint(1, 7)], *[None] * r.randint(0, 1)]}
        own = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.source_targets(own).collect()}
        want = water(sizes)
        assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_whole_mix(spark):
    rows = fixtures.awkward()
    out = mixing.mix(fixtures.frame(spark, rows), carry=["lang", "size", "target"])
    got = out.collect()
    sizes, taken = {}, {}
    assert len(got) == len(rows)
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = water(sizes)
    by_id = {}
    for r in got:
        size, total, target, words = r[1:5]
        source = next(x[3] for x in rows if x[0] == r[0] and len(WORD.findall(x[1] or "")) == size)
        assert total == sizes[source] and target == pytest.approx(want[source]) and 0 <= words <= 2 * size
        taken[source] = taken.get(source, 0) + words
        by_id.setdefault(r[0], []).append(words)
    assert all(taken[s] == int(want[s]) for s in sizes)
    again = {}
    for r in mixing.mix(fixtures.frame(spark, rows).repartition(5)).collect():
        again.setdefault(r[0], []).append(r.taken)
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in again.items()}


def test_empty(spark):
    assert mixing.mix(fixtures.frame(spark, [])).count() == 0


def test_nothing_but_empty_texts(spark):
    got = mixing.mix(fixtures.frame(spark, [fixtures.row(1, ""), fixtures.row(2, None)])).collect()
    assert [r.taken for r in got] == [0, 0] and [r.target for r in got] == [0.0, 0.0]


def test_sql_agrees_on_awkward_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in fixtures.awkward()])
    assert_agree(mixing.mix(fixtures.frame(spark, fixtures.awkward())), con, mixing.oracle_sql())


def test_rows_of_one_id_spread_and_reruns_agree(spark):
    """All ids null: texts still fall into many ranges, and which texts are taken does not depend on the order of rows."""
    rows = [fixtures.row(None, f"text {i} " * (i % 7 + 1), source="ab"[i % 2]) for i in range(400)]
    runs = []
    for parts in (1, 5):
        got = mixing.mix(fixtures.frame(spark, rows).repartition(parts), carry=["text"]).collect()
        runs.append(sorted((r.text, r.taken) for r in got))
    assert runs[0] == runs[1] and len(runs[0]) == 400
