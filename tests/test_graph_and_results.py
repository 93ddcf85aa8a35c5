from __future__ import annotations

import pytest

from siltstone.operators import graph, results


def edges(spark, *pairs, relation="CONTENT_SIM"):
    rows = [(f"t{a}.n{a}", f"t{b}.n{b}", relation, 1.0) for a, b in pairs]
    return graph.undirected(spark.createDataFrame(rows, "src string, dst string, relation string, weight double"))


CHAIN, ONE, TWO, TRIANGLE, APART = [(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 1), (0, 2), (1, 3)], [(0, 1), (0, 2), (1, 3), (2, 3)], [(0, 1), (0, 2), (1, 2)], [(0, 1), (2, 3)]


@pytest.mark.parametrize(("pairs", "start", "hops", "size"), [(CHAIN, 1, 1, 2), (ONE, 0, 2, 3), (TWO, 0, 2, 4), (TRIANGLE, 0, 2, 2), ([(0, 1), (1, 2)], 0, 1, 1), (APART, 0, 2, 1)])
def test_neighborhood_sizes(spark, pairs, start, hops, size):
    assert graph.neighborhood(edges(spark, *pairs), f"t{start}.n{start}", hops).count() == size


@pytest.mark.parametrize(("pairs", "target", "n"), [([(0, 1), (1, 2)], 2, 1), (TWO, 3, 2), (TRIANGLE, 2, 1), ([], 1, 0)])
def test_path_counts(spark, pairs, target, n):
    assert graph.find_paths(edges(spark, *pairs), "t0.n0", f"t{target}.n{target}").count() == n


def test_simple_and_shortest(spark):
    e = edges(spark, *TRIANGLE)
    assert graph.find_paths(e, "t0.n0", "t2.n2", 3, "simple").count() == 2
    assert [r.path for r in graph.shortest_paths(e, "t0.n0", "t2.n2").collect()] == [["t0.n0", "t2.n2"]]
    with pytest.raises(ValueError):
        graph.level_paths(e, "t0.n0", 2, "other")


def test_bitmaps_and_degrees(spark):
    e = graph.add_edges(edges(spark, (0, 1)), edges(spark, (0, 1), (0, 2), relation="PKFK"))
    assert {(r.src, r.dst): r.bits for r in graph.edge_bitmaps(e).collect()}["t0.n0", "t1.n1"] == 6
    assert graph.top_connected(e, 1).first().node == "t0.n0"


A = [("table_c.v", 1.0), ("table_a.a", 2.0), ("table_a.b", 1.0), ("table_b.c", 1.0), ("table_b.d", 1.0)]
B = [("table_a.b", 5.0), ("table_d.a", 1.0), ("table_d.b", 1.0)]


def result(spark, hits, query):
    found = spark.createDataFrame([(*n.split("."), s) for n, s in hits], "source string, column_name string, score double")
    return results.from_search(found, query)


def test_set_sizes(spark):
    a, b = result(spark, A, "a"), result(spark, B, "b")
    assert [x.hits.count() for x in (a.intersect(b), a.union(b), a.minus(b))] == [1, 7, 4]
    assert {r.node: r.score for r in a.union(b).hits.collect()}["table_a.b"] == 5.0
    assert {r.node for r in a.as_tables().intersect(b.as_tables()).hits.collect()} == {"table_a.a", "table_a.b"}
    with pytest.raises(ValueError):
        a.union(b.as_tables())
    both = {(r.src, r.dst): r.annotation for r in a.union(b).lineage.collect()}
    assert both["?a", "table_a.b"] == "AND" and both["?a", "table_a.a"] is None


def test_laws(spark):
    a, b = result(spark, A, "a"), result(spark, B, "b")
    nodes = lambda x: {r.node for r in x.hits.collect()}
    assert nodes(a.union(b)) == nodes(b.union(a)) and nodes(a.intersect(b)) == nodes(b.intersect(a))
    assert nodes(a.minus(b)) | nodes(a.intersect(b)) == nodes(a)
    empty = result(spark, [], "none")
    assert nodes(a.union(empty)) == nodes(a) and nodes(a.intersect(empty)) == set()


def test_lineage_and_ranking(spark):
    e = spark.createDataFrame([("a.x", "b.y", "PKFK", 0.5), ("b.y", "c.z", "PKFK", 0.25)], "src string, dst string, relation string, weight double")
    base = result(spark, [("a.x", 2.0)], "q")
    two = base.union(base.neighbors(e)).neighbors(e)
    rs = base.union(two)
    assert {r.origin for r in rs.why("c.z").collect()} == {"?q"}
    assert [r.explanation for r in rs.how("c.z").collect()] == ["?q -KW_LOOKUP-> a.x -PKFK-> b.y -PKFK-> c.z"]
    assert {r.node: r.certainty for r in rs.rank_certainty().collect()} == {"a.x": 2.0, "b.y": 2.5, "c.z": 2.75}
    assert {r.item: r.coverage for r in rs.rank_coverage().collect()} == {"a.x": 1.0, "b.y": 1.0, "c.z": 1.0}
    assert [r.node for r in rs.ends().collect()] == ["c.z"]


def test_two_cycles_make_no_predecessor(spark):
    e = edges(spark, (0, 1))
    rs = results.of_columns(spark, ["t0.n0"]).neighbors(e)
    rs = rs.union(rs.neighbors(e))
    assert {r.node for r in rs.origins().collect()} == {"t0.n0", "t1.n1"}


def test_coercion(spark):
    columns = spark.createDataFrame([("a.x",), ("a.y",), ("b.z",)], "node string")
    rs = results.to_result_set(spark, ["a", "b.z"], columns)
    assert {r.node for r in rs.hits.collect()} == {"a.x", "a.y", "b.z"}
    assert results.to_result_set(spark, rs, columns) is rs and results.to_result_set(spark, [], columns).hits.count() == 0
    assert results.to_result_set(spark, "a", columns).mode == results.TABLE


def test_walks_are_counted(spark):
    links = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), ("a", "b")]
    got = {r.hops: r.n_walks for r in graph.count_walks(spark.createDataFrame(links, "src string, dst string"), "a", "c", 5).collect()}
    step = {("a", "b"): 2, ("b", "c"): 1, ("a", "d"): 1, ("d", "c"): 1, ("c", "a"): 1}
    want, at = {}, {"a": 1}
    for hops in range(1, 6):
        ahead = {}
        for (u, v), n in step.items():
            if u in at:
                ahead[v] = ahead.get(v, 0) + at[u] * n
        at = ahead
        if at.get("c"):
            want[hops] = at["c"]
    assert got == want == {2: 3, 5: 9}
    assert graph.count_walks(spark.createDataFrame(links, "src string, dst string"), "x", "c", 2).count() == 0
