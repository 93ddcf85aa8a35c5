"""Decoding the zones of a text gives what decoding the whole text gives."""

from __future__ import annotations

import random

import numpy as np

from siltstone.llm import pii


def whole(text, w):
    base = pii.base_spans(text)
    return sorted(base + pii.decode(text, (0, len(text)), base, w))


def test_plain_at_and_other_separators_are_decoded():
    w = np.array(pii.train())
    assert (9, 0, 28) in pii.find("write to john at example.com", w)[1]
    assert (5, 3, 17) in pii.find("call 555·123·4567 now", w)[1]


def test_a_plain_at_without_a_domain_never_scores():
    assert pii.least_at(np.array(pii.train())) < 0


def test_zones_equal_whole_texts():
    w, r = np.array(pii.train()), random.Random(21)
    pieces = ["john", "a.b", "at", "dot", "[at]", "(dot)", "[.]", "example.com", "site", "com", "555", "123", "4567", "10", "0", "4111", "1111", ",", "–", "·", "/", "(", ")", "#", "²", "é", "x1", "mail", "call", "card", "@", "٣", "\n"]
    generated = [t for t, _ in pii._generated(seed=31, n=150)]
    for k in range(600):
        parts = [r.choice(pieces) + r.choice((" ", " ", "", "  ")) for _ in range(r.randint(1, 60))]
        text = r.choice(generated) + " so " * r.randint(0, 30) + "".join(parts) if k % 2 else "".join(parts)
        assert pii.find(text, w)[1] == whole(text, w), text
