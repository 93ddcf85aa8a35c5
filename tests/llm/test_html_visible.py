"""Words of hidden elements never show and all others do, whatever is left open; and hostile pages cost little."""

from __future__ import annotations

import random
import re
import time

import pytest

from siltstone.llm import html_text

CASES = [
    ("<select><option>Opt</select> <button>B</button>", "Opt\nB"),
    ("<p><select><option>1<option>2</select> lost?</p><p>next", "1\n2\nlost?\n\nnext"),
    ("<video><p>fallback</video>after", "after"),
    ("<span hidden><div>no</span>yes", "yes"),
    ('a<a href="x>b', "ab"),
    ("a<a href='x>b</a> c <i>d</i>", "ab c d"),
    ("a<b title=\"it's\">c</b>d", "acd"),
    ("text <a href=", "text"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_text_around_invisible_elements(html, text):
    assert html_text.render(html) == text


def test_spans_place_cells():
    rows = html_text.render("<table><tr><td rowspan=2>aa</td><td>b</td></tr><tr><td>c</td></tr><tr><td colspan=2>wide wide</td><td>d</td></tr></table>").split("\n")
    assert [x.index(c) for x, c in zip(rows, "bcd")][:2] == [5, 5] and rows[2].startswith("wide wide") and rows[2].endswith("| d")
    # columns that no cell starts in take no room
    assert html_text.render("<table><tr><td colspan=900>wide</td><td>x</td></tr></table>") == "wide | x"


def page(r: random.Random, depth: int, shown: bool, words: list[tuple[str, bool]]) -> str:
    """Random nested html; what is left open lies within an element that closes."""
    out = []
    for _ in range(r.randint(1, 5)):
        word = f"w{len(words)}"
        kind = r.random()
        if kind < 0.4 or depth == 0:
            words.append((word, shown))
            out.append(f" {word} ")
            continue
        tag, attr, see, loose = r.choice([
            ("div", "", True, True), ("section", "", True, True), ("select", "", True, True), ("ul", "", True, True), ("blockquote", "", True, True), ("details", " open", True, True), ("button", "", True, True),
            ("div", " hidden", False, True), ("div", " style='display:none'", False, True), ("video", "", False, True), ("audio", "", False, True), ("canvas", "", False, True), ("object", "", False, True),
            ("template", "", False, True), ("noscript", "", False, True), ("span", " hidden", False, True), ("datalist", "", False, True), ("dialog", "", False, True), ("span", "", True, False), ("b", "", True, False),
        ])
        inner = page(r, depth - 1, shown and see, words)
        if loose:  # something open, and text in it
            words.append((f"w{len(words)}", shown and see))
            left = r.choice(("<p>", "<option>", "<b>", "<i>", "<li>", "<em><p>", "<option><u>"))  # none of the name around it, whose end tag it would take
            inner += f"{left} {words[-1][0]} "
        out.append(f"<{tag}{attr}>{inner}</{tag}>")
    return "".join(out)


def test_no_word_is_lost_or_leaked():
    r = random.Random(33)
    for _ in range(2500):
        words: list[tuple[str, bool]] = []
        html = page(r, r.randint(1, 4), True, words)
        assert sorted(re.findall(r"w\d+", html_text.render(html))) == sorted(w for w, shown in words if shown), html


def test_rules_hold_at_any_depth():
    for n in (10, 130, 3000, 100_000):
        assert html_text.render("<div>" * n + "<div hidden>SECRET</div>ok") == "ok"
        assert html_text.render("<div>" * n + "<ul><li>a<li>b</ul>") == "- a\n- b"
    deep = html_text.render("<blockquote>" * 3000 + "x<p hidden>no</p><ul><li>y</ul><table><tr><td>1<td>2</table>")
    assert re.findall(r"\w+", deep) == ["x", "y", "1", "2"] and "no" not in deep
    assert html_text.render("<ul><li>" * 30 + "x").count("-") == 30 and html_text.render("<ul><li>" * 100 + "x").count("-") == 100


@pytest.mark.parametrize("piece", ["<a x='", '<a x="', "<a ", "<b>", "</b>", "<p><b>", "<table><tr><td>", "<span></div>", "<select><option>", "<!--", "<a x='>", "<a x=\"'>", "<td rowspan=9>", "<p><button><div>", "<li>", "<svg>", "<script>", "<![", "<form>"])
def test_a_megabyte_of_anything_takes_seconds(piece):
    html = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    html_text.render(html + " end")
    assert time.perf_counter() - began < 12
