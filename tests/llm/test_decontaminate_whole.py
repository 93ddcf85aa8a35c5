"""Leaks that were missed: parts of long items, and short items."""

from __future__ import annotations

import random

from siltstone.llm import decontaminate as dc
from tests.llm import fixtures
from tests.llm.test_decontaminate import bench, words


def test_half_of_a_long_item_and_short_items(spark):
    r = random.Random(4)
    item = words(r, 400, "q", 4000)
    text = words(r, 300)
    rows = [
        fixtures.row(1, " ".join(text[:150] + item[100:300] + text[150:])), fixtures.row(2, " ".join(text)), fixtures.row(3, " ".join(text[:90] + item[:20] + text[90:])),
        fixtures.row(4, "So who wrote the Iliad? It was Homer"), fixtures.row(5, "the one who wrote of the Iliad"),
    ]
    items = [(1, " ".join(item)), (2, "Who wrote the Iliad?")]
    docs = fixtures.frame(spark, rows)
    assert sorted((x.doc_id, x.item_id) for x in dc.find_leaks(docs, bench(spark, items)).collect()) == [(1, 1), (4, 2)]
    assert sorted(x.doc_id for x in dc.drop_leaks(docs, bench(spark, items)).collect()) == [2, 3, 5]
    assert [(x.doc_id, x.item_id) for x in dc.find_leaks(docs, bench(spark, items[1:])).collect()] == [(4, 2)]
