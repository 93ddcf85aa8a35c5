"""The stored index: built, read again, refreshed, and asked from the command line."""

from __future__ import annotations

import pytest

from siltstone import cli
from siltstone.operators import graph, ontology, relations, results, store, textsearch, values
from siltstone.sources import catalog


def lake(spark, n=40):
    people = spark.createDataFrame([(i, f"name {i}", i % 5) for i in range(n)], "id long, name string, town int")
    towns = spark.createDataFrame([(i, f"town {i}") for i in range(5)], "town_id int, town_name string")
    pets = spark.createDataFrame([(i * 2, i % 7) for i in range(30)], "owner long, kind int")
    return catalog.Catalog({"people": people, "towns": towns, "pets": pets})


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_refreshed_index_equals_a_new_one(spark, tmp_path):
    place, other = f"{tmp_path}/a", f"{tmp_path}/b"
    store.build(lake(spark, 20), place)
    small = rows(store.open_index(spark, place).values)
    grown = lake(spark, 60)
    store.refresh(grown, place, ["people"])
    fresh = store.build(grown, other)
    now = store.open_index(spark, place)
    assert rows(now.values) == rows(fresh.values) != small
    assert rows(now.pairs) == rows(fresh.pairs) and rows(now.edges()) == rows(fresh.edges())
    assert now.profiles.count() == fresh.profiles.count() == 7
    # a table that is gone is dropped, with its pairs
    del grown.tables["pets"]
    gone = store.refresh(grown, place, ["pets"])
    assert gone.tables == ["people", "towns"] and gone.pairs.filter("source1 = 'pets' or source2 = 'pets'").isEmpty()


def test_a_failed_refresh_changes_nothing(spark, tmp_path, monkeypatch):
    store.build(lake(spark), str(tmp_path / "i"), with_profiles=False)
    before = rows(store.open_index(spark, str(tmp_path / "i")).values)
    monkeypatch.setattr(store, "_pairs_of", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.refresh(lake(spark, 70), str(tmp_path / "i"), ["people"])
    assert rows(store.open_index(spark, str(tmp_path / "i")).values) == before


def test_missing_and_old_indexes(spark, tmp_path, monkeypatch):
    with pytest.raises(LookupError):
        store.open_index(spark, str(tmp_path / "none"))
    store.build(lake(spark), str(tmp_path / "i"), with_profiles=False)
    monkeypatch.setattr(store, "FORMAT", 2)
    with pytest.raises(LookupError):
        store.open_index(spark, str(tmp_path / "i"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "people.csv").write_text("id,name\n" + "".join(f"{i},name {i}\n" for i in range(9)))
    (tmp_path / "in" / "pets.csv").write_text("owner,kind\n" + "".join(f"{i},{i % 2}\n" for i in range(9)))
    sources, index = f"{tmp_path}/sources.yml", f"{tmp_path}/index"
    cli.main(["create", sources])
    cli.main(["add-csv", sources, "shop", f"{tmp_path}/in"])
    cli.main(["build", sources, index])
    cli.main(["search", f"{index}/shop", "name 3"])
    cli.main(["neighbors", f"{index}/shop", "people.id", "--relation", "CONTENT_SIM"])
    cli.main(["paths", f"{index}/shop", "people.id", "pets.owner"])
    cli.main(["refresh", sources, index, "pets"])
    out = capsys.readouterr().out
    assert "shop 2 tables" in out and "people.name" in out and "CONTENT_SIM pets.owner 1.0" in out and "people.id > pets.owner" in out


def test_domains_are_checked(spark):
    v = values.column_values(lake(spark))
    with pytest.raises(ValueError):
        textsearch.search(v, "x", "nonsense")
    with pytest.raises(ValueError):
        textsearch.search(v, "x", textsearch.ENTITIES)
    labels = spark.createDataFrame([("people", "name", "Person PERSON"), ("towns", "town_name", "place")], "source string, column_name string, text string")
    assert [r.column_name for r in textsearch.search(v, "person", textsearch.ENTITIES, labels=labels).collect()] == ["name"]


def test_cosine_against_all_pairs(spark):
    """Candidates from the heads of vectors lose no pair, for thresholds low and high."""
    import math
    import random

    r = random.Random(4)
    docs = {f"c{i}": [f"w{int(30 * r.random() ** 2)}" for _ in range(r.randint(1, 25))] for i in range(40)}
    posts = spark.createDataFrame([(d, "x", t, ws.count(t)) for d, ws in docs.items() for t in set(ws)], "source string, column_name string, term string, tf long")
    n = len(docs)
    df = {t: sum(t in ws for ws in docs.values()) for ws in docs.values() for t in ws}
    vec = {d: {t: (1 + math.log(ws.count(t))) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(ws)} for d, ws in docs.items()}
    for v in vec.values():
        norm = math.sqrt(sum(x * x for x in v.values()))
        v.update({t: x / norm for t, x in v.items()})
    for least in (0.2, 0.7, 0.95):
        want = {(a, b) for a in vec for b in vec if a < b and sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) >= least}
        got = textsearch.cosine_pairs(textsearch.tfidf(posts, ["source", "column_name"]), ["source", "column_name"], least)
        assert {(x.source1, x.source2) for x in got.collect()} == want


def test_lineage_has_no_cuts(spark):
    chain = [(f"t.n{i}", f"t.n{i + 1}", "R") for i in range(20)]
    rs = results.ResultSet(spark.createDataFrame([("t.n20", "t", 1.0)], results.HITS), spark.createDataFrame(chain, results.LINEAGE))
    assert [x.origin for x in rs.why("t.n20").collect()] == ["t.n0"]
    assert [x.coverage for x in rs.rank_coverage().collect()] == [1.0]
    with pytest.raises(RuntimeError):
        rs.how("t.n20")
    deep = spark.createDataFrame([(i, f"c{i}", i - 1 if i else None) for i in range(30)], "class_id int, name string, parent_id int")
    assert ontology.ancestors(deep).filter("class_id = 29").count() == 30


def test_shortest_paths_stop_at_the_target(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("a", "x"), ("x", "y"), ("y", "e"), ("e", "a")], "src string, dst string")
    assert sorted((x.path, x.hops) for x in graph.shortest_paths(e, "a", "e").collect()) == [(["a", "b", "c", "e"], 3), (["a", "d", "c", "e"], 3), (["a", "x", "y", "e"], 3)]
    assert graph.shortest_paths(e, "e", "nowhere").count() == 0 and graph.shortest_paths(e, "a", "e", 2).count() == 0


def test_entities_readers_and_embeddings(spark, tmp_path):
    found = relations.entity_similar(spark.createDataFrame([("a", "x", "t", 1), ("b", "y", "t", 1)], "source string, column_name string, term string, tf long"), 0.5)
    assert [x.cosine for x in found.collect()] == [1.0]
    lake(spark).tables["towns"].write.parquet(f"{tmp_path}/p/towns.parquet")
    assert list(catalog.parquet_folder(spark, {"path": f"{tmp_path}/p"}).tables) == ["towns"]
    catalog.register_reader("mine", lambda s, c: lake(s))
    assert set(catalog.load_sources(spark, [{"name": "m", "type": "mine", "config": {}}])["m"].tables) == {"people", "towns", "pets"}
    pairs = spark.createDataFrame([("n", 1, 0.95), ("n", 1, 0.1), ("m", 1, 0.05)], "node string, class_id int, similarity double")
    assert sorted((x.node, x.sign) for x in ontology.match_embeddings(pairs, 0.6, 0.2).collect()) == [("m", -1), ("n", 1)]
