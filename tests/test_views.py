from __future__ import annotations

import random

import numpy as np
import pytest

from siltstone import cli
from siltstone.operators import examples, fourc, notes, ontology, questions, synthesis, vectors
from siltstone.operators import values as vx
from siltstone.sources import catalog, sinks

V = {
    "v1": [(1, "ann", "hr"), (2, "bob", "it"), (3, "cat", "it")],
    "v2": [(3, "cat", "it"), (1, "ann", "hr"), (2, "bob", "it")],
    "v3": [(1, "ann", "hr"), (2, "bob", "it")],
    "v4": [(1, "ann", "hr"), (2, "bob", "ops"), (4, "dan", "hr")],
    "v5": [(3, "cat", "it"), (5, "eve", "ops")],
}
W = {"w1": [(1, "x"), (2, "y")], "w2": [(2, "y"), (3, "z")]}


@pytest.fixture(scope="module")
def views(spark):
    out = {n: spark.createDataFrame(r, "id int, name string, dept string") for n, r in V.items()}
    return out | {n: spark.createDataFrame(r, "k int, v string") for n, r in W.items()}


@pytest.fixture(scope="module")
def labels(views):
    return fourc.classify(views)


ALL = {"id", "name", "dept+id", "dept+name", "id+name"}


def test_candidate_keys(labels):
    got = {}
    for r in labels["candidates"].collect():
        got.setdefault(r.view, set()).add(r.key)
    assert got == {**dict.fromkeys(("v1", "v2", "v4"), ALL), **dict.fromkeys(("v3", "v5"), ALL | {"dept"}), "w1": {"k", "v"}, "w2": {"k", "v"}}


def test_relations_of_the_toy_views(labels):
    edges = {(r.view1, r.view2): r.relation for r in labels["edges"].collect()}
    assert edges == {
        ("v1", "v2"): "compatible", ("v1", "v3"): "contained", ("v2", "v3"): "contained",
        ("v1", "v4"): "contradictory/complementary", ("v2", "v4"): "contradictory/complementary", ("v3", "v4"): "contradictory/complementary",
        ("v1", "v5"): "complementary", ("v2", "v5"): "complementary", ("v3", "v5"): "contradictory", ("w1", "w2"): "complementary",
    }
    com = {}
    for r in labels["complementary"].collect():
        com.setdefault((r.view1, r.view2), set()).add(r.key)
    assert com["v1", "v4"] == {"dept+id", "dept+name"} and com["v1", "v5"] == ALL and com["w1", "w2"] == {"k", "v"}
    con = {(r.view1, r.view2, r.key): r.n_values for r in labels["conflicts"].collect()}
    assert {k[2] for k in con if k[:2] == ("v1", "v4")} == {"id", "name", "id+name"} and set(con.values()) == {1}
    assert [r.value for r in fourc.conflict_values(labels["keys"], "v3", "v5", "dept").collect()] == ["it"]


def test_distillation(views):
    left = fourc.distill(views)
    assert set(left) == {"v1", "v4", "v5", "w1+w2"}
    assert {tuple(r) for r in left["w1+w2"].collect()} == {("1", "x"), ("2", "y"), ("3", "z")}
    assert set(fourc.distill(views, union=False)) == {"v1", "v4", "v5", "w1", "w2"}


def test_missing_cells_and_empty_views(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (1, " X ")], "k int, v string")
    assert [tuple(r) for r in fourc.curated(a).collect()] == [("1", "x")]
    empty = a.limit(0)
    c = fourc.classify({"a": a, "e": empty})
    assert c["edges"].count() == 0
    assert fourc.equivalent(a, a) == "" and fourc.equivalent(a, empty) == "size" and fourc.equivalent(a, a.drop("v")) == "schema"


def test_conflicts_against_brute_force(spark):
    r = random.Random(2)
    views = {f"x{i}": [(r.randrange(40), r.choice("ab"), r.randrange(3)) for _ in range(30)] for i in range(5)}
    frames = {n: spark.createDataFrame(v, "a int, b string, c int") for n, v in views.items()}
    rows = {n: set(v) for n, v in views.items()}
    c = fourc.classify(frames, least=0.5)
    cand = {(x.view, x.key) for x in c["candidates"].collect()}
    pick = {"a": 0, "b": 1, "c": 2}
    want = {}
    for m in views:
        for n in views:
            for key in {k for _, k in cand}:
                if m < n and (m, key) in cand and (n, key) in cand:
                    of = lambda row: tuple(row[pick[x]] for x in key.split("+"))  # noqa: E731, B023
                    bad = {of(p) for p in rows[m] for q in rows[n] if of(p) == of(q) and p != q}
                    if bad:
                        want[m, n, key] = len(bad)
    assert {(x.view1, x.view2, x.key): x.n_values for x in c["conflicts"].collect()} == want


def test_join_graphs():
    paths = examples.JoinPaths([("a.x", "b.x"), ("b.y", "c.y"), ("a.z", "b.x")], most_hops=2)
    assert len(paths.between("a", "b")) == 2 and len(paths.between("a", "c")) == 2
    assert paths.between("c", "a")[0] == tuple((r, l) for l, r in reversed(paths.between("a", "c")[0]))
    graphs = list(examples.join_graphs(["c", "a", "b"], paths))
    assert {g.tables for g in graphs} == {("a", "b", "c")} and all(len(g.joins) == 2 for g in graphs)
    assert list(examples.join_graphs(["a", "z"], paths)) == [] and len(list(examples.join_graphs(["a"], paths))) == 1
    assert len(list(examples.join_graphs(["a", "b", "c"], paths, chain=False))) > len(graphs)
    assert examples.view_names([("t", "a"), ("u", "a"), ("u", "b")]) == ["a", "a_2", "b"]


def test_examples_end_to_end(spark):
    lake = catalog.Catalog({"city": spark.createDataFrame([("Bonn", "de"), ("Lyon", "fr"), (None, "fr")], "name string, land string"), "land": spark.createDataFrame([("de", "Germany"), ("fr", "France"), (None, "x")], "code string, title string")})
    v = vx.column_values(lake)
    spec = [examples.Example("", ("bonn", " LYON ", "")), examples.Example("title", ())]
    edges = spark.createDataFrame([("city.land", "land.code")], "src string, dst string")
    found = list(examples.views(lake, v, edges, spec))
    assert len(found) == 1 and {tuple(r) for r in found[0][2].collect()} == {("bonn", "germany"), ("lyon", "france")} | ({(None, "france")})
    assert list(synthesis.explore(v, spec)) == [("city", "land")]
    assert synthesis.materializable(lake.tables, found[0][0], {"land": ("title", "France")}) and not synthesis.materializable(lake.tables, found[0][0], {"land": ("title", "Spain")})


def test_codes_follow_the_order_of_texts(spark):
    words = sorted({f"{a}{b}" for a in ("", "aaaaaaaa", "é", "zz") for b in ("", "x", "xy", "b", "é")})
    got = {r.value: r.code for r in synthesis.codes(spark.createDataFrame([(w,) for w in words * 2], "w string"), "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words, key=str.encode))}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 16))
    x = centers[rng.integers(0, 12, 600)] + 0.4 * rng.standard_normal((600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    for metric in vectors.METRICS:
        got = {}
        for r in vectors.nearest(df, asked, "vec_id", "embedding", 5, metric, block=100).collect():
            got.setdefault(r.query, []).append((r.rank, r.neighbor))
        for q in range(0, 600, 20):
            d = np.round(vectors.distances(x[q : q + 1], x, metric)[0], 6)
            d[q] = np.inf
            assert [n for _, n in sorted(got[q])] == np.lexsort((np.arange(600), d))[:5].tolist()
    exact = vectors.nearest(df, asked, "vec_id", "embedding", 10)
    assert vectors.recall(exact, vectors.nearest_by_buckets(df, asked, "vec_id", "embedding", per_bucket=60)).first().recall >= 0.9
    empty = df.limit(0)
    assert vectors.nearest(empty, empty, "vec_id", "embedding").count() == 0 and vectors.nearest_by_buckets(empty, empty, "vec_id", "embedding").count() == 0
    assert vectors.discretized_keys(df, "vec_id", "embedding", vectors.principal_planes(df.filter("size(embedding) > 0"), "embedding", 4), 0.5).count() == 600


def test_chooser_and_centers():
    c = questions.Chooser(["a", "b"], seed=0)
    assert [c.next(4) for _ in range(4)] == ["a", "b", "a", "b"]
    for _ in range(2):
        c.answer("b", True)
    picks = [c.next(4) for _ in range(200)]
    assert picks.count("b") > 120 and picks.count("a") > 0
    assert questions.k_centers([], 3) == [] and [m for _, m in questions.k_centers(["order_key", "order_date", "size"], 2)] == [["order_date", "order_key"], ["size"]]


def test_classes(spark):
    lines = ['<u:a> <http://www.w3.org/2000/01/rdf-schema#label> "Place" .', "<u:b> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <u:a> .", "junk"]
    assert ontology.parse_triples(lines) == [("u:a", "Place", None), ("u:b", "u:b", "u:a")]
    classes = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "loop", 4)], "class_id int, name string, parent_id int")
    up = ontology.ancestors(classes)
    assert {(r.class_id, r.ancestor_id) for r in up.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (2, 1), (3, 2), (3, 1)}
    m = spark.createDataFrame([("n", 2, 1.0), ("n", 3, 0.5), ("m", 4, 1.0)], "node string, class_id int, score double")
    assert {(r.node, r.class_id) for r in ontology.summarize(m, up).collect()} == {("n", 2), ("m", 4)}
    assert ontology.combine(m, m).count() == 3
    pairs = spark.createDataFrame([("t", "a", "b", 0.9), ("t", "a", "c", 0.8), ("t", "x", "y", 0.9), ("t", "b", "z", 0.1)], "table string, word1 string, word2 string, similarity double")
    assert {r.word for r in ontology.cohesive_groups(pairs, 0.5).collect()} == {"a", "b", "c"}


def test_notes(spark):
    table, comments = notes.empty(spark)
    table = notes.annotate(table, [("ann", "Odd values", notes.WARNING, "t.c", None, None, ["x"]), ("bob", "same", notes.INSIGHT, "t.c", "u.d", "SUBCLASS", [])])
    assert notes.of_node(table, "u.d").count() == 1 and [r.node for r in notes.related(table, "u.d", "SUPERCLASS").collect()] == ["t.c"]
    first = table.filter("author = 'ann'").first().id
    assert notes.search_notes(notes.add_tags(table, first, ["money"]), comments, "MONEY").count() == 1
    with pytest.raises(ValueError):
        notes.annotate(table, [("a", "b", "SHOUT", "t.c", None, None, [])])


def test_csv_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "people.csv").write_text('id,name\n1,"Ann, the first"\n2,Bob\n3\n4,x,y\n5,"say ""hi"""\n')
    lake = catalog.load_sources(spark, [{"name": "hr", "type": "csv", "config": {"path": f"{tmp_path}/in"}}])["hr"]
    assert {tuple(r) for r in lake.tables["people"].collect()} == {("1", "Ann, the first"), ("2", "Bob"), ("5", 'say "hi"')}
    assert lake.tables["people"].count() == 3 and lake.tables["people"].select("id").count() == 3
    assert catalog.csv_with_rejects(spark, f"{tmp_path}/in/people.csv")[1].count() == 2
    sinks.store(lake.tables["people"], f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 3
    sinks.store(lake.tables["people"], None, "noop")
    sinks.store_view(lake.tables["people"], f"{tmp_path}/view", {"joins": []})
    assert spark.read.option("header", True).csv(f"{tmp_path}/view/data").count() == 3
    e = spark.createDataFrame([("a.x", "b.y", "PKFK", 1.0)], "src string, dst string, relation string, weight double")
    assert sinks.triples(e).first().triple == "<urn:column:a.x> <urn:column:relation/pkfk> <urn:column:b.y> ."
    with pytest.raises(ValueError):
        sinks.store(e, "x", "xml")
    sample = [catalog.pruned_sample(lake.tables["people"], "people", ["name"], 2).collect() for _ in range(2)]
    assert sample[0] == sample[1] and len(sample[0]) == 2


def test_command_line(tmp_path, capsys):
    path = str(tmp_path / "sources.yml")
    assert cli.main(["create", path]) == 0 and cli.main(["add-csv", path, "hr", "/data/hr"]) == 0
    assert cli.main(["add-database", path, "db", "postgres", "host", "5432", "shop", "--user", "me"]) == 0
    assert [s["name"] for s in catalog.read_sources_file(path)] == ["hr", "db"]
    assert cli.main(["list", path]) == 0 and "postgres" in capsys.readouterr().out


def test_cells_that_differ(spark, views):
    got = {tuple(r) for r in fourc.differing_cells(views["v1"], views["v4"], "id").collect()}
    assert got == {("2", "dept", "it", "ops")}
    held_twice = views["v4"].union(spark.createDataFrame([(2, "bob", "hr")], "id int, name string, dept string"))
    assert fourc.differing_cells(views["v1"], held_twice, "id").count() == 0
    assert fourc.differing_cells(views["v1"].limit(0), views["v4"], "id").count() == 0


def test_projections_that_repeat(spark, views):
    one = spark.createDataFrame([(1, "HR"), (2, "it"), (2, "it"), (None, "x")], "id int, dept string")
    two = spark.createDataFrame([("it", 2), ("hr ", 1)], "dept string, id int")
    other = spark.createDataFrame([(1, "hr"), (2, "it")], "no int, dept string")
    got = {tuple(r) for r in fourc.repeated_projections({"a": one, "b": two, "c": other, "d": two.limit(1), "e": one}).collect()}
    assert got == {("b", "a"), ("e", "a")}


def test_tree_of_tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "a": make([(1, 10, "p"), (2, 20, "q"), (3, None, "r")], "id int, b int, name string"),
        "b": make([(10, 7, "x"), (20, 8, "y")], "id int, c int, name string"),
        "c": make([(7, "z"), (7, "zz"), (9, "w")], "id int, name string"),
        "d": make([(1, "k"), (2, "m")], "id int, name string"),
    }
    out = synthesis.fold_tree(tables, [(("c", "id"), ("b", "c")), (("a", "b"), ("b", "id")), (("a", "id"), ("d", "id"))])
    assert len(set(out.columns)) == len(out.columns) == 10
    got = sorted(tuple(r[c] for c in out.columns if c.startswith("name")) for r in out.collect())
    assert [sorted(g) for g in got] == [["k", "p", "x", "z"], ["k", "p", "x", "zz"]]
    assert synthesis.fold_tree(tables, [(("a", "id"), ("d", "id"))]).columns == ["id", "b", "name", "id_x", "name_x"]
    with pytest.raises(ValueError, match="no path"):
        synthesis.fold_tree(tables, [(("a", "b"), ("b", "id")), (("c", "id"), ("d", "id"))])
    with pytest.raises(ValueError, match="once"):
        synthesis.fold_tree(tables, [(("a", "b"), ("b", "id")), (("b", "id"), ("d", "id")), (("a", "id"), ("d", "id"))])
