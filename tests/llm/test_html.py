from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pytest

from siltstone.llm import html_text

CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
    ("<ol start=3><li>x</li><li value=9>y</li><li>z</ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"),
    ("<table><tr><th colspan=2>head</th></tr><tr><td>1</td><td>2</td></tr></table>", "head\n1 | 2"),
    ("<head><title>t</title></head><body>x<script>if (a < b) {}</script>y", "xy"),
    ("<div style='display: none'>no</div>yes<span hidden>no</span>", "yes"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"),
    ("<blockquote>q</blockquote>", "> q"),
    ("a &amp; b &lt;c&gt; &eacute;", "a & b <c> é"),
    ("<details><summary>s</summary>hidden</details>", "s"),
    ("  lots   of \n space ", "lots of space"),
    ("<b>bo</b>ld <i> it </i>al", "bold it al"),
    ("</p></div>stray", "stray"),
    ("a < b and <", "a < b and <"),
    ("<!-- c -->x<!doctype html>y", "xy"),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_render(html, text):
    assert html_text.render(html) == text


class Words(HTMLParser):
    """All text outside scripts and styles, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style") and self.raw > 0

    def handle_data(self, data):
        if not self.raw:
            self.out.append(data)


def test_no_visible_word_is_lost():
    r = random.Random(4)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "span", "h2", "blockquote", "dl", "dd", "section", "a"]
    for _ in range(300):
        parts = []
        for k in range(r.randint(1, 40)):
            parts.append(r.choice((f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f" w{k} ", f" w{k} ")))
        html = "".join(parts)
        w = Words()
        w.feed(html)
        assert sorted(re.findall(r"w\d+", html_text.render(html))) == sorted(re.findall(r"w\d+", " ".join(w.out))), html


def test_hostile_input_costs_no_stack():
    assert "deep" in html_text.render("<div>" * 50_000 + "deep")
    assert html_text.render("<td colspan=999999999>x" * 50)
    assert html_text.render("<a " + "x=" * 100_000) is not None


def test_query(spark):
    rows = [(1, "u", "<p>a", 5), (1, "u", "<p>a", 5), (2, None, None, None), (None, "u", "", 1), (3, "u", "<p>" + "long " * 200_000, 1)]
    got = sorted(html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect(), key=str)
    assert len(got) == 5 and {r.text for r in got} == {"a", "", ("long " * 200_000).strip()}
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
