"""Text that a browser shows and that was lost."""

from __future__ import annotations

import random
import re

import pytest

from siltstone.llm import html_text
from tests.llm.test_html import Words

TABLES = [
    ("<table><tbody><form><tr><td>x</td><td>y</td></tr></form></tbody></table>", "x | y"),
    ("<table><form><tr><td>x</td></tr><tr><td>y</td></tr></form></table>", "x\ny"),
    ("<table><tbody><td>x</td><td>y</td></tbody></table>", "x | y"),
    ("<table><td>x<td>y<tr><td>z<td>u</table>", "x | y\nz | u"),
    ("<table><tbody>loose<b>bold</b><tr><td>x</td></tr></tbody><tfoot>end</tfoot></table>", "loose\nbold\nend\nx"),
    ("<table><tr><td>a</td></tr><form>find <input></form></table>", "find\na"),
    ("<table><tbody hidden><td>no</td></tbody><tr><td>x</table>", "x"),
]


@pytest.mark.parametrize(("html", "text"), TABLES)
def test_tables_keep_their_text(html, text):
    assert html_text.render(html) == text


def test_no_word_of_broken_tables_is_lost():
    r = random.Random(12)
    tags = ["table", "tbody", "thead", "tfoot", "form", "tr", "td", "th", "caption", "p", "b", "li"]
    for _ in range(1500):
        parts = [r.choice((f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f" w{k} ", f" w{k} ")) for k in range(r.randint(1, 40))]
        w = Words()
        w.feed(html := "<table>" + "".join(parts))
        assert sorted(re.findall(r"w\d+", html_text.render(html))) == sorted(re.findall(r"w\d+", " ".join(w.out))), html


SHOWN = [
    ("<head><title>t</title><font size=2><p>whole page<p>more", "whole page\n\nmore"),
    ("<head><title>t</title>bare text<p>more", "bare text\n\nmore"),
    ("<head><title>t</title><meta charset=x> <span>a</span> b", "a b"),
    ("<head><style>no</style><script>no</script></head>a", "a"),
    ("so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"),
    ("<math><semantics><mi>x</mi><annotation>no</annotation></semantics></math>", "x"),
    ("a<svg><title>no</title><defs><text>no</text></defs><rect/><g><path d='M0'/><text>in <tspan>it</tspan></text></g></svg>b", "a in it b"),
    ("<svg><path d='M0'><p>after an open svg", "after an open svg"),
    ("a <textarea>\nx\n  y &amp; z</textarea> b", "a\nx\n  y & z\nb"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("<xmp><b>as it is</b></xmp>", "<b>as it is</b>"),
]


@pytest.mark.parametrize(("html", "text"), SHOWN)
def test_text_that_browsers_show(html, text):
    assert html_text.render(html) == text
