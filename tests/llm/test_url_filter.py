from __future__ import annotations

import random
import re

import numpy as np
import pytest

from siltstone.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    m = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:m]


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


URLS = [
    "http://www.example.com/en/a", "http://EXAMPLE.com/en/b", "http://a.example.com/en", "http://example.com/en/?q", "https://x.net/es/1", "https://y.net/fr/1", "https://z.net/de/1", "http://net/es/", "ftp://b.org/es/",
    None, "", "no scheme", "x://", "http://h?q=://y.com/", "http://ÀB.com/#/en/", "http://a.com", "http://com/", "http://xcom/", "http://a.net/es",
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int, rule int, trust string, hit int, id int")


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "<p>x</p>" if i % 3 else None, 1, 2, "x", 3, 4) for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        assert (got[i].host, got[i].path) == (host, path), u
        rule = rule_of(host, path, RULES)
        assert got[i].rule == (rule[0] + rule[1] if rule else None), u
        if rule:
            assert got[i].verdict == rule[2]


def test_long_rule_lists_join_the_same_rules(spark):
    r = random.Random(1)
    rules = RULES + [(f"h{i}.net", r.choice(("/", "/a/", "/a/b/")), r.choice(("allow", "block"))) for i in range(60)]
    rules = list({x[:2]: x for x in rules}.values())
    urls = URLS + [f"http://{r.choice(('', 's.'))}h{r.randrange(70)}.net/{r.choice(('', 'a/', 'a/b/c', 'x'))}" for _ in range(150)]
    own = pages(spark, [(i, u, None, 1, 2, "x", 3, 4) for i, u in enumerate(urls)])
    host, path = url_filter.split_url(own["url"])
    base = own.select("page_id", host.alias("host"), path.alias("path"))
    one, two = ({x.page_id: (x.rule, x.rule_verdict) for x in url_filter.apply_rules(base, rules, n).collect()} for n in (1000, 0))
    assert one == two
    assert all(one[i][0] == ("".join(w[:2]) if (w := rule_of(*split(u), rules)) else None) for i, u in enumerate(urls))


def test_distrust_spreads_against_links(spark):
    """A page that links to a blocked host is distrusted; one that a trusted host links to is not."""
    link = lambda *hosts: " ".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/es/", "", 1, 2, "", 3, 4), (2, "http://ring.org/", link("bad.net"), 1, 2, "", 3, 4), (3, "http://good.com/", link("friend.org"), 1, 2, "", 3, 4), (4, "http://friend.org/", None, 1, 2, "", 3, 4), (5, "http://alone.org/", "", 1, 2, "", 3, 4)]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows)).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    assert got[2].distrust > got[2].trust and got[4].trust > got[4].distrust


def dense(edges, trusted, blocked, rounds=500):
    """Trust and distrust by power iteration over a full matrix; mass without a way returns to the seeds."""
    names = sorted({x for s, t, _ in edges for x in (s, t)} | set(trusted) | set(blocked))
    m = np.zeros((len(names), len(names)))
    for s, t, w in edges:
        m[names.index(s), names.index(t)] += w
    out = []
    for mat, seeds in ((m, trusted), (m.T.copy(), blocked)):
        sums = mat.sum(axis=1, keepdims=True)
        mat = np.divide(mat, sums, out=np.zeros_like(mat), where=sums > 0)
        home = np.array([seeds.get(n, 0.0) for n in names])
        v = home.copy()
        for _ in range(rounds):
            moved = 0.85 * v @ mat
            v = moved + (1 - moved.sum()) * home
        out.append(dict(zip(names, v)))
    return out


def test_scores_match_a_dense_power_iteration(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("d", "a", 1.0)]
    e = spark.createDataFrame(edges, "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(e, seeds, tolerance=1e-12).collect()}
    for k, want in enumerate(dense(edges, {"a": 1.0}, {"c": 1.0})):
        assert all(abs(got.get(n, (0, 0))[k] - want[n]) < 1e-9 for n in want)


def test_defaults_settle_on_rings_and_chains(spark):
    """The query's parameters, on a ring of 40 hosts and a chain of 40 that ends at a blocked host, against full matrices."""
    link = lambda *hosts: " ".join(f'<a class=x href="http://{h}/">x</a>' for h in hosts)
    rows = [(i, f"http://ring{i}.org/", link(f"ring{(i + 1) % 40}.org"), 1, 2, "", 3, 4) for i in range(1, 40)]
    rows += [(40, "http://ring0.com/", link("ring1.org"), 1, 2, "", 3, 4), (41, "http://ring39.org/x", link("ring0.com"), 1, 2, "", 3, 4)]
    rows += [(100 + i, f"http://chain{i}.org/", link(f"chain{i + 1}.org"), 1, 2, "", 3, 4) for i in range(39)]
    rows += [(139, "http://chain39.org/", link("bad.net"), 1, 2, "", 3, 4), (140, "http://bad.net/es/", "", 1, 2, "", 3, 4)]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, rows)).collect()}
    edges = [(split(u)[0], split(t)[0], 1.0) for _, u, h, *_ in rows for t in re.findall(r'href="([^"]*)"', h)]
    trust, distrust = dense([e for e in edges if e[0] != e[1]], {"ring0.com": 1.0}, {"bad.net": 1.0})
    for r in got.values():
        assert abs(r.trust - trust[r.host]) < 1e-4 and abs(r.distrust - distrust[r.host]) < 1e-4
        if r.rule is None:
            assert r.verdict == ("block" if distrust[r.host] > trust[r.host] else "allow")
    assert all(got[100 + i].verdict == "block" for i in range(40))


def test_a_bound_that_is_hit_raises(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    with pytest.raises(RuntimeError):
        url_filter.spread(e, seeds, rounds=16).collect()


def test_empty_and_repeated(spark):
    assert url_filter.judge(pages(spark, [])).count() == 0
    rows = [(1, "http://a.org/", None, 1, 2, "", 3, 4)] * 3 + [(None, None, None, None, None, None, None, None)]
    assert url_filter.judge(pages(spark, rows)).count() == 4
