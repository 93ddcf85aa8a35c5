"""Registered queries on the relationship graph, result sets, query by example, views, vectors, names and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import components, examples, fourc, graph, notes, ontology, questions, relations, results, synthesis, textsearch, vectors
from siltstone.plans import oracle as o
from siltstone.plans.column_queries import NAMES, ORACLES, PAIRS, PKFK_SQL, QUERIES, column_pairs, index, is_text, lake, pkfk, profiles, query, r  # noqa: F401
from siltstone.plans.shared import materialize


def content_edges(spark, folder) -> DataFrame:
    return relations.as_edges(relations.content_similar(column_pairs(spark, folder), 0.7), relations.CONTENT_SIM, "jaccard")


def nodes(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def joined(c: str, sep: str = ">"):
    return F.array_join(F.col(c), sep).alias(c)


# ---------------------------------------------------------------- graph


@query("neighbors_content", o.graph("SELECT src AS origin, dst AS node, relation, round(weight, 6) AS weight FROM e WHERE src IN ('customer.c_custkey', 'nation.n_nationkey')"))
def neighbors_content(spark, folder):
    return graph.neighbors(content_edges(spark, folder), nodes(spark, "customer.c_custkey", "nation.n_nationkey"), relations.CONTENT_SIM).select("origin", "node", "relation", r("weight"))


@query("neighbors_pkfk", o.similar(f"SELECT source1 || '.' || column_name1 AS origin, source2 || '.' || column_name2 AS node, round(weight, 6) AS weight FROM ({PKFK_SQL}) WHERE source1 = 'lineitem'"))
def neighbors_pkfk(spark, folder):
    edges = relations.as_edges(pkfk(spark, folder), relations.PKFK, "weight", both_ways=False)
    lineitem = nodes(spark, *[f"lineitem.{c}" for c in o.SCHEMA["lineitem"]])
    return graph.neighbors(edges, lineitem, relations.PKFK).select("origin", "node", r("weight"))


def _level_sql(start: str, hops: int, simple: bool = False) -> str:
    rule = "NOT list_contains(p.path, e.dst)" if simple else "NOT EXISTS (SELECT 1 FROM p q WHERE list_contains(q.path, e.dst))"
    return f""", p AS (SELECT [src, dst] AS path, dst AS node, 1 AS hops FROM e WHERE src = '{start}'
UNION ALL SELECT list_append(p.path, e.dst), e.dst, hops + 1 FROM p JOIN e ON e.src = p.node WHERE hops < {hops} AND {rule})"""


@query("two_hop", o.graph(_level_sql("customer.c_custkey", 2) + " SELECT node FROM p", True))
def two_hop(spark, folder):
    return graph.neighborhood(content_edges(spark, folder), "customer.c_custkey", 2)


@query("paths_level", o.graph(_level_sql("customer.c_custkey", 3) + " SELECT node, array_to_string(path, '>') AS path, hops FROM p", True))
def paths_level(spark, folder):
    return graph.level_paths(content_edges(spark, folder), "customer.c_custkey", 3).select("node", joined("path"), "hops")


@query("count_walks", o.graph(", w AS (SELECT dst AS node, 1 AS hops FROM e WHERE src = 'orders.o_custkey' UNION ALL SELECT e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 3) SELECT hops, count(*)::BIGINT AS n_walks FROM w WHERE node = 'customer.c_custkey' GROUP BY 1", True))
def count_walks(spark, folder):
    return graph.count_walks(content_edges(spark, folder), "orders.o_custkey", "customer.c_custkey", 3)


@query("paths_simple", o.graph(_level_sql("orders.o_custkey", 3, True) + " SELECT array_to_string(path, '>') AS path, hops FROM p WHERE node = 'part.p_partkey'", True))
def paths_simple(spark, folder):
    return graph.find_paths(content_edges(spark, folder), "orders.o_custkey", "part.p_partkey", 3, "simple").select(joined("path"), "hops")


@query("shortest_paths", o.graph(_level_sql("orders.o_custkey", 3, True) + ", f AS (SELECT * FROM p WHERE node = 'lineitem.l_partkey') SELECT array_to_string(path, '>') AS path, hops FROM f WHERE hops = (SELECT min(hops) FROM f)", True))
def shortest_paths(spark, folder):
    return graph.shortest_paths(content_edges(spark, folder), "orders.o_custkey", "lineitem.l_partkey", 3).select(joined("path"), "hops")


_TABLE_EDGES = ", te AS (SELECT t1, t2, count(*) AS n FROM (SELECT split_part(src, '.', 1) AS t1, split_part(dst, '.', 1) AS t2 FROM e) WHERE t1 <> t2 GROUP BY t1, t2)"


@query("table_paths", o.graph(_TABLE_EDGES + """, p AS (SELECT [t1, t2] AS tables, t2 AS node, 1 AS hops, n AS n_ways FROM te WHERE t1 = 'customer'
UNION ALL SELECT list_append(tables, t2), t2, hops + 1, n_ways * n FROM p JOIN te ON t1 = node WHERE hops < 3 AND node <> 'part' AND NOT list_contains(tables, t2))
SELECT array_to_string(tables, '>') AS tables, hops, n_ways::BIGINT AS n_ways FROM p WHERE node = 'part'""", True))
def table_paths(spark, folder):
    return graph.table_paths(content_edges(spark, folder), "customer", "part", 3).select(joined("tables"), "hops", "n_ways")


@query("traverse", o.graph(", p AS (SELECT 'nation.n_nationkey' AS node, 0 AS hops UNION SELECT e.dst, hops + 1 FROM p JOIN e ON e.src = p.node WHERE hops < 4) SELECT node, min(hops) AS hops FROM p GROUP BY node", True))
def traverse(spark, folder):
    return graph.traverse(content_edges(spark, folder), nodes(spark, "nation.n_nationkey"), 4)


@query("components", o.graph(", p AS (SELECT DISTINCT src AS a, src AS b FROM e UNION SELECT p.a, e.dst FROM p JOIN e ON e.src = p.b) SELECT a AS node, min(b) AS component FROM p GROUP BY a", True))
def connected(spark, folder):
    return components.connected_components(content_edges(spark, folder), "src", "dst")


@query("degree_topk", o.graph("SELECT src AS node, count(DISTINCT dst) AS degree FROM e GROUP BY src ORDER BY degree DESC, node LIMIT 10"))
def degree_topk(spark, folder):
    return graph.top_connected(content_edges(spark, folder), 10)


@query("relation_pairs", o.graph("SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e"))
def relation_pairs(spark, folder):
    return graph.pairs_of_relation(content_edges(spark, folder), relations.CONTENT_SIM)


@query("edge_bitmaps", o.similar(f"""SELECT src, dst, bit_or(b)::INT AS bits FROM (SELECT source1 || '.' || column_name1 AS src, source2 || '.' || column_name2 AS dst, 4 AS b FROM ({PKFK_SQL})
UNION ALL SELECT source1 || '.' || column_name1, source2 || '.' || column_name2, 2 FROM dir WHERE jaccard >= 0.7) GROUP BY ALL"""))
def edge_bitmaps(spark, folder):
    edges = graph.add_edges(content_edges(spark, folder), relations.as_edges(pkfk(spark, folder), relations.PKFK, "weight", both_ways=False))
    return graph.edge_bitmaps(edges)


@query("same_table", "SELECT 'nation.n_name' AS origin, x AS node FROM (VALUES ('nation.n_nationkey'), ('nation.n_regionkey')) v(x)")
def same_table(spark, folder):
    columns = lake(spark, folder).metadata(spark).select(F.concat_ws(".", "source", "column_name").alias("node"))
    return graph.same_table(columns, nodes(spark, "nation.n_name"))


@query("synthetic_network")
def synthetic_network(spark, folder):
    return graph.degrees(graph.synthetic_network(spark, 100_000, 10, {"CONTENT_SIM": 90_000, "SCHEMA_SIM": 90_000, "PKFK": 90_000}))


# ---------------------------------------------------------------- result sets

_A = "a AS (SELECT source || '.' || column_name AS node, source FROM vals WHERE value = '5')"
_B = "b AS (SELECT source || '.' || column_name AS node, source FROM vals WHERE value IN ('24', 'asia'))"


def _sets(spark, folder) -> tuple[results.ResultSet, results.ResultSet]:
    v = index(spark, folder)
    one = lambda *x: v.filter(F.col("value").isin(*x)).select("source", "column_name").distinct().withColumn("score", F.lit(1.0))
    return results.from_search(one("5"), "5"), results.from_search(one("24", "asia"), "24 asia")


def _set_sql(body: str) -> str:
    return f"WITH {o.vals()}, {_A}, {_B} {body}"


@query("rs_union", _set_sql("SELECT DISTINCT node, source FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"))
def rs_union(spark, folder):
    a, b = _sets(spark, folder)
    return a.union(b).hits.select("node", "source")


@query("rs_intersect", _set_sql("SELECT DISTINCT node, source FROM a WHERE node IN (SELECT node FROM b)"))
def rs_intersect(spark, folder):
    a, b = _sets(spark, folder)
    return a.intersect(b).hits.select("node", "source")


@query("rs_intersect_table", _set_sql("SELECT DISTINCT node, source FROM (SELECT * FROM a WHERE source IN (SELECT source FROM b) UNION ALL SELECT * FROM b WHERE source IN (SELECT source FROM a))"))
def rs_intersect_table(spark, folder):
    a, b = _sets(spark, folder)
    return a.as_tables().intersect(b.as_tables()).hits.select("node", "source")


@query("rs_minus", _set_sql("SELECT DISTINCT node, source FROM a WHERE node NOT IN (SELECT node FROM b)"))
def rs_minus(spark, folder):
    a, b = _sets(spark, folder)
    return a.minus(b).hits.select("node", "source")


@query("rs_tables", _set_sql("SELECT DISTINCT source FROM a"))
def rs_tables(spark, folder):
    return _sets(spark, folder)[0].as_tables().items()


def _expanded(spark, folder) -> results.ResultSet:
    """Columns named like custkey and their neighbours."""
    v, edges = index(spark, folder), content_edges(spark, folder)
    found = materialize(textsearch.search(v, "custkey", textsearch.SCHEMA, limit=None), "hits")
    base = results.from_search(found, "custkey")
    return base.union(base.neighbors(edges, relations.CONTENT_SIM))


def _lineage_sql(body: str) -> str:
    search = o.search_terms("custkey", NAMES.format(o.NAME_WORDS.format("column_name")), "source, column_name")
    return o.graph(f""",{search},
base AS (SELECT source || '.' || column_name AS node, source, score FROM found),
nb AS (SELECT e.dst AS node, max(weight) AS score FROM base JOIN e ON e.src = base.node WHERE split_part(e.src, '.', 1) <> split_part(e.dst, '.', 1) GROUP BY 1),
hits AS (SELECT node, split_part(node, '.', 1) AS source, max(score) AS score FROM (SELECT node, score FROM base UNION ALL SELECT node, score FROM nb) GROUP BY node),
lin AS (SELECT '?custkey' AS src, node AS dst, 'KW_LOOKUP' AS op FROM base UNION SELECT e.src, e.dst, e.relation FROM base JOIN e ON e.src = base.node WHERE split_part(e.src, '.', 1) <> split_part(e.dst, '.', 1)),
lp AS (SELECT '?custkey' AS origin, '?custkey' AS node, ['?custkey'] AS path, []::VARCHAR[] AS ops
  UNION ALL SELECT origin, lin.dst, list_append(path, lin.dst), list_append(ops, op) FROM lp JOIN lin ON lin.src = lp.node WHERE NOT list_contains(path, lin.dst) AND len(ops) < 12)
{body}""", True)


@query("why", _lineage_sql("SELECT DISTINCT origin FROM lp WHERE node = 'part.p_partkey'"))
def why(spark, folder):
    return _expanded(spark, folder).why("part.p_partkey")


@query("how", _lineage_sql("SELECT path[1] || coalesce(array_to_string(list_transform(list_zip(ops, path[2:]), lambda x: ' -' || x[1] || '-> ' || x[2]), ''), '') AS explanation FROM lp WHERE node = 'part.p_partkey'"))
def how(spark, folder):
    return _expanded(spark, folder).how("part.p_partkey")


@query("rank_certainty", _lineage_sql(", ps AS (SELECT lp.node, lp.path, sum(coalesce(h.score, 0)) AS score FROM lp, unnest(lp.path) u(k) LEFT JOIN hits h ON h.node = k GROUP BY ALL) SELECT hits.node, round(max(ps.score), 5) AS certainty FROM hits JOIN ps USING (node) GROUP BY ALL"))
def rank_certainty(spark, folder):
    return _expanded(spark, folder).rank_certainty().select("node", r("certainty", 5))


@query("rank_coverage", _lineage_sql("SELECT hits.node AS item, count(DISTINCT origin) / 1.0 AS coverage FROM hits JOIN lp USING (node) GROUP BY ALL"))
def rank_coverage(spark, folder):
    return _expanded(spark, folder).rank_coverage()


_N_TEXT, _N_NUM = (len(o.columns(*k)) for k in (("str", "time"), o.NUMERIC))


@query("report_counts", o.graph(f"""SELECT 'tables' AS fact, {len(o.TABLES)}::BIGINT AS n UNION ALL SELECT 'columns', {_N_TEXT + _N_NUM} UNION ALL SELECT 'columns of type T', {_N_TEXT} UNION ALL SELECT 'columns of type N', {_N_NUM}
UNION ALL SELECT 'pairs of CONTENT_SIM', count(*) // 2 FROM e"""))
def report_counts(spark, folder):
    return results.report(profiles(spark, folder, semantic=False, cardinality=False, quantiles=False, range=False), content_edges(spark, folder))


# ---------------------------------------------------------------- query by example

SPEC = [examples.Example("name", ("ASIA", "EUROPE")), examples.Example("name", ("NATION_2", "NATION_3"))]
_CAND = """ex(position, example) AS (VALUES (0, 'asia'), (0, 'europe'), (1, 'nation_2'), (1, 'nation_3')),
cand AS (SELECT position, source, column_name, count(DISTINCT example) AS n_examples,
    CASE WHEN list_contains(regexp_extract_all(lower(column_name), '[a-z0-9]+'), 'name') THEN 'ATTR_CELL' ELSE 'CELL' END AS hit
  FROM ex JOIN vals ON value = example GROUP BY ALL HAVING count(DISTINCT example) = 2)"""


@query("qbe_candidates", f"WITH {o.vals()}, {_CAND} SELECT * FROM cand")
def qbe_candidates(spark, folder):
    return examples.candidate_columns(index(spark, folder), SPEC)


@query("qbe_fuzzy_candidates", f"WITH {o.vals()}, ex(position, example) AS (VALUES (0, 'europ'), (0, 'asi')) SELECT position, source, column_name, count(DISTINCT example) AS n_examples, 'CELL' AS hit FROM ex JOIN vals ON levenshtein(value, example) <= CASE WHEN len(example) < 3 THEN 0 WHEN len(example) < 6 THEN 1 ELSE 2 END GROUP BY ALL HAVING count(DISTINCT example) = 2")
def qbe_fuzzy_candidates(spark, folder):
    return examples.candidate_columns(index(spark, folder, is_text), [examples.Example("", ("EUROP", "ASI"))], fuzzy=True)


_FALL = "ex(position, example) AS (VALUES (0, 'asia'), (0, 'europ'), (1, 'buildin'))"


@query("qbe_fallback", f"""WITH {o.vals()}, {_FALL},
near AS (SELECT position, example, source, column_name, cnt, levenshtein(value, example) AS d FROM ex JOIN vals ON levenshtein(value, example) <= CASE WHEN len(example) < 3 THEN 0 WHEN len(example) < 6 THEN 1 ELSE 2 END),
per AS (SELECT position, example, source, column_name, sum(cnt) FILTER (d = 0) AS same FROM near GROUP BY ALL),
best AS (SELECT *, max(same) OVER (PARTITION BY position, example) AS exact FROM per)
SELECT position, example, source, column_name, CASE WHEN exact IS NULL THEN 'FUZZY' ELSE 'EXACT' END AS hit FROM best WHERE exact IS NULL OR same IS NOT NULL""")
def qbe_fallback(spark, folder):
    """An example that a column holds, and two that none does but nearly."""
    return examples.candidates_or_fuzzy(index(spark, folder, is_text), [examples.Example("", ("ASIA", "EUROP")), examples.Example("", ("BUILDIN",))])


@query("qbe_clusters")
def qbe_clusters(spark, folder):
    found = examples.candidate_columns(index(spark, folder), [examples.Example("nationkey", ("3", "7"))])
    return examples.best_clusters(found, content_edges(spark, folder))


@query("qbe_groups", f"WITH {o.vals()}, {_CAND} SELECT CASE WHEN a.source = b.source THEN a.source ELSE least(a.source, b.source) || ',' || greatest(a.source, b.source) END AS tables, count(*) AS n_options FROM cand a, cand b WHERE a.position = 0 AND b.position = 1 GROUP BY 1")
def qbe_groups(spark, folder):
    groups = examples.candidate_groups(examples.candidate_columns(index(spark, folder), SPEC), len(SPEC))
    return spark.createDataFrame([(",".join(t), len(options)) for t, options in groups], "tables string, n_options long")


def _first_view(spark, folder, spec) -> DataFrame:
    for _, _, view in examples.views(lake(spark, folder), index(spark, folder), content_edges(spark, folder), spec):
        return view
    raise LookupError("no view fits the examples")


@query("qbe_view_region_nation", "SELECT lower(r_name) AS r_name, lower(n_name) AS n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def qbe_view_region_nation(spark, folder):
    return _first_view(spark, folder, SPEC)


@query("qbe_view_customer_orders", "SELECT lower(c_mktsegment) AS c_mktsegment, lower(o_orderpriority) AS o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey")
def qbe_view_customer_orders(spark, folder):
    return _first_view(spark, folder, [examples.Example("", ("BUILDING", "MACHINERY")), examples.Example("", ("1-URGENT", "5-LOW"))])


# ---------------------------------------------------------------- view synthesis


@query("filter_columns", f"WITH {o.vals()} SELECT DISTINCT source, column_name FROM vals WHERE value = '7' AND contains(lower(column_name), 'nation')")
def filter_columns(spark, folder):
    return synthesis.joint_filter(index(spark, folder), "nation", "7")


@query("cell_filter_join", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE lower(trim(c_mktsegment)) = 'building'")
def cell_filter_join(spark, folder):
    t = lake(spark, folder).tables
    return synthesis.equi_join(synthesis.cell_filter(t["customer"], "c_mktsegment", " Building"), t["orders"], "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@query("fold_tree", """SELECT r_name, n_name, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT p_partkey) AS n_parts
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def fold_tree(spark, folder):
    t = lake(spark, folder).tables
    hops = [
        (("lineitem", "l_orderkey"), ("orders", "o_orderkey")), (("nation", "n_regionkey"), ("region", "r_regionkey")), (("part", "p_partkey"), ("lineitem", "l_partkey")),
        (("orders", "o_custkey"), ("customer", "c_custkey")), (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")), (("supplier", "s_nationkey"), ("nation", "n_nationkey")),
    ]
    joined = synthesis.fold_tree(t, hops)
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_rows"), F.count_distinct("c_custkey").alias("n_customers"), F.count_distinct("p_partkey").alias("n_parts"))


@query("join_size", "SELECT count(*) AS n_rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_size(spark, folder):
    t = lake(spark, folder).tables
    return synthesis.join_size(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey")


@query("consistent_sample_join", """WITH ka AS (SELECT DISTINCT c_custkey AS k FROM customer), kb AS (SELECT DISTINCT o_custkey AS k FROM orders),
few AS (SELECT k FROM ka WHERE (SELECT count(*) FROM ka) <= (SELECT count(*) FROM kb) UNION ALL SELECT k FROM kb WHERE (SELECT count(*) FROM ka) > (SELECT count(*) FROM kb)),
pick AS (SELECT k FROM few ORDER BY md5(k::VARCHAR) DESC LIMIT 100)
SELECT k::VARCHAR AS key, min(c_name) AS a_c_name, min(o_orderkey) AS b_o_orderkey FROM pick JOIN customer ON c_custkey = k JOIN orders ON o_custkey = k GROUP BY k""")
def consistent_sample_join(spark, folder):
    t = lake(spark, folder).tables
    return synthesis.consistent_sample(t["customer"], t["orders"], "c_custkey", "o_custkey", 100).select("key", "a_c_name", "b_o_orderkey")


@query("rank_join_graphs", o.similar(f"""SELECT DISTINCT source1 || '.' || column_name1 || '=' || source2 || '.' || column_name2 AS join, round(greatest(n1 / filled1, n2 / filled2) / (1 + ln(1 + ln(2))), 6) AS score
FROM dir WHERE source1 = 'customer' AND source2 = 'orders' AND (source1, column_name1, source2, column_name2) IN (SELECT {PAIRS} FROM ({PKFK_SQL}) UNION ALL SELECT source2, column_name2, source1, column_name1 FROM ({PKFK_SQL}))"""))
def rank_join_graphs(spark, folder):
    from siltstone.operators import profiling

    edges = relations.as_edges(pkfk(spark, folder), relations.PKFK, "weight", both_ways=False)
    paths = examples.JoinPaths([(x.src, x.dst) for x in edges.select("src", "dst").distinct().collect()])  # metadata
    ranked = synthesis.rank_graphs(list(examples.join_graphs(["customer", "orders"], paths)), profiling.uniqueness(index(spark, folder)))
    rows = [("{0[0]}.{0[1]}={1[0]}.{1[1]}".format(*g.joins[0]), round(s, 6)) for s, g in ranked]
    return spark.createDataFrame(rows, "join string, score double")


@query("table_sets")
def table_sets(spark, folder):
    found = synthesis.explore(index(spark, folder), SPEC)
    return spark.createDataFrame([(",".join(t),) for t in found], "tables string")


def _jac(x: str, y: str) -> str:
    a, b = o.WORDS.format(x), f"regexp_extract_all('{y}', '[a-z0-9]+')"
    return f"(len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b}))))"


_EXAMPLE_ROWS = [("asia", "nation_2"), ("europe", "nation_3 x")]
_CELLS = [[_jac(c, x) for c, x in zip(("r_name", "n_name"), row)] for row in _EXAMPLE_ROWS]


@query("view_s4_score", f"""WITH v AS (SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey),
s AS (SELECT {' + '.join(f"max({' + '.join(row)})" for row in _CELLS)} AS row_score, {' + '.join(f'max({x})' for row in _CELLS for x in row)} AS column_score FROM v)
SELECT round(row_score, 6) AS row_score, round(column_score, 6) AS column_score, round((0.5 * row_score + 0.5 * column_score) / (1 + ln(1 + ln(2))), 6) AS score FROM s""")
def view_s4_score(spark, folder):
    t = lake(spark, folder).tables
    view = t["region"].join(t["nation"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return synthesis.example_fit(view, _EXAMPLE_ROWS, 2)


@query("path_column_correlation", "SELECT 0 AS hop, round(corr(o_custkey, o_totalprice), 6) AS correlation FROM orders UNION ALL SELECT 1, round(corr(c_custkey, c_nationkey), 6) FROM customer UNION ALL SELECT 2, 1.0")
def path_column_correlation(spark, folder):
    t = lake(spark, folder).tables
    return synthesis.path_correlation([(t["orders"], "o_custkey", "o_totalprice"), (t["customer"], "c_custkey", "c_nationkey"), (t["nation"], "n_nationkey", "n_nationkey")])


@query("category_codes", "SELECT p_name AS value, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)")
def category_codes(spark, folder):
    return synthesis.codes(lake(spark, folder).tables["part"], "p_name")


@query("noise_columns", "SELECT (SELECT count(*) FROM (SELECT DISTINCT p_partkey AS k FROM part) WHERE k IN (SELECT c_custkey FROM customer)) AS n_inside, (SELECT count(*) FROM (SELECT DISTINCT p_partkey AS k FROM part) WHERE k NOT IN (SELECT c_custkey FROM customer)) AS n_outside")
def noise_columns(spark, folder):
    t = lake(spark, folder).tables
    return synthesis.noise_columns(t["customer"].select(F.col("c_custkey").alias("k")), t["part"].select(F.col("p_partkey").alias("k")), "k")


# ---------------------------------------------------------------- relations between views

#: views over customer; the last changes a cell where the nation is 3
_VIEWS = {
    "all": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "moved": "SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 'AUTOMOBILE' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "no_building": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "no_machinery": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'",
    "same": "SELECT c_mktsegment, c_name, c_custkey FROM customer",
}
_COLS = ("c_custkey", "c_mktsegment", "c_name")
_COMBOS = [("c_custkey",), ("c_mktsegment",), ("c_name",), ("c_custkey", "c_mktsegment"), ("c_custkey", "c_name"), ("c_mktsegment", "c_name")]


_PROJECTED = [("c_mktsegment", "c_name"), ("c_name", "c_custkey")]


def _projections_sql() -> str:
    """Whether two projections have equal rows: by set differences in both directions."""
    name = lambda v, c: f"{v}({','.join(c)})"
    made = [(name(v, c), c, f"SELECT {', '.join(c)} FROM ({q})") for v, q in sorted(_VIEWS.items()) for c in _PROJECTED]
    pairs = [
        f"SELECT '{b}' AS projection, '{a}' AS same_as WHERE NOT EXISTS ({qa} EXCEPT {qb}) AND NOT EXISTS ({qb} EXCEPT {qa})"
        for k, (a, ca, qa) in enumerate(made) for b, cb, qb in made[k + 1 :] if ca == cb
    ]
    return "SELECT projection, min(same_as) AS same_as FROM (" + " UNION ALL ".join(pairs) + ") GROUP BY 1"


def _projections(spark, folder) -> dict[str, DataFrame]:
    return {f"{v}({','.join(c)})": df.select(*c) for v, df in customer_views(spark, folder).items() for c in _PROJECTED}


def customer_views(spark, folder) -> dict[str, DataFrame]:
    c = spark.read.parquet(f"{folder}/customer.parquet")
    own = c.select("c_custkey", "c_name", "c_mktsegment")
    return {
        "all": own,
        "moved": c.select("c_custkey", "c_name", F.when(F.col("c_nationkey") == 3, "AUTOMOBILE").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")),
        "no_building": own.filter("c_mktsegment <> 'BUILDING'"),
        "no_machinery": own.filter("c_mktsegment <> 'MACHINERY'"),
        "same": own.select("c_mktsegment", "c_name", "c_custkey"),
    }


def _views_sql(body: str) -> str:
    rows = " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS view, {', '.join(o.norm(f'CAST({c} AS VARCHAR)') + ' AS ' + c for c in _COLS)} FROM ({q})" for n, q in _VIEWS.items())
    keys = " UNION ALL ".join(f"SELECT view, '{'+'.join(k)}' AS key, concat_ws(chr(31), {', '.join(k)}) AS value, row FROM vr" for k in _COMBOS)
    return f"""WITH vr AS MATERIALIZED (SELECT *, concat_ws(chr(31), {', '.join(_COLS)}) AS row FROM ({rows}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _COLS)}),
vn AS (SELECT view, count(*) AS n FROM vr GROUP BY view),
vp AS (SELECT a.view AS view1, b.view AS view2, count(*) AS overlap FROM vr a JOIN vr b ON a.row = b.row AND a.view < b.view GROUP BY ALL),
pr AS (SELECT vp.*, x.n AS n1, y.n AS n2 FROM vp JOIN vn x ON x.view = view1 JOIN vn y ON y.view = view2),
vk AS MATERIALIZED ({keys}),
st AS (SELECT view, key, count(DISTINCT value) / count(*) AS strength FROM vk GROUP BY ALL),
ck AS MATERIALIZED (SELECT view, key, strength FROM (SELECT *, max(strength) OVER (PARTITION BY view) AS best FROM st) WHERE strength >= 0.9 - 1e-8 AND strength >= best - 1e-8),
ok AS MATERIALIZED (SELECT vk.* FROM vk SEMI JOIN ck USING (view, key)),
cf AS MATERIALIZED (SELECT a.view AS view1, b.view AS view2, a.key, count(DISTINCT a.value) AS n_values FROM ok a JOIN ok b ON a.key = b.key AND a.value = b.value AND a.view < b.view AND a.row <> b.row GROUP BY ALL),
cm AS MATERIALIZED (SELECT view1, view2, a.key FROM pr JOIN ck a ON a.view = view1 JOIN ck b ON b.view = view2 AND a.key = b.key WHERE (view1, view2, a.key) NOT IN (SELECT view1, view2, key FROM cf)),
strong AS (SELECT view1, view2, CASE WHEN n1 = n2 THEN 'compatible' ELSE 'contained' END AS relation FROM pr WHERE overlap = least(n1, n2))
{body}"""


def _classified(spark, folder) -> dict[str, DataFrame]:
    return fourc.classify(customer_views(spark, folder))


@query("candidate_keys", _views_sql("SELECT view, key, round(strength, 6) AS strength FROM ck"))
def candidate_keys(spark, folder):
    views = customer_views(spark, folder)
    return fourc.candidate_keys(fourc.keyed(fourc.layout(views), views)).select("view", "key", r("strength"))


@query("views_compatible", _views_sql("SELECT view1, view2 FROM strong WHERE relation = 'compatible'"))
def views_compatible(spark, folder):
    return fourc.compatible(fourc.row_pairs(fourc.layout(customer_views(spark, folder))))


@query("view_fingerprints", _views_sql(", same AS (SELECT view1, view2 FROM pr WHERE overlap = n1 AND n1 = n2) SELECT vn.view, n, 1 + (SELECT count(*) FROM same WHERE vn.view IN (view1, view2)) AS n_equal FROM vn"))
def view_fingerprints(spark, folder):
    """The size of each view, and how many views, itself included, have its fingerprint."""
    prints = fourc.fingerprints(fourc.layout(customer_views(spark, folder)))
    same = prints.groupBy("schema", "n", "total", "mix").agg(F.count("*").alias("n_equal"))
    return prints.join(same, ["schema", "n", "total", "mix"]).select("view", "n", "n_equal")


@query("views_contained", _views_sql("SELECT CASE WHEN n1 > n2 THEN view1 ELSE view2 END AS container, CASE WHEN n1 > n2 THEN view2 ELSE view1 END AS inside FROM pr WHERE overlap = least(n1, n2) AND n1 <> n2"))
def views_contained(spark, folder):
    return fourc.contained(fourc.row_pairs(fourc.layout(customer_views(spark, folder))))


@query("views_contradictory", _views_sql("SELECT view1, view2, key, n_values FROM cf"))
def views_contradictory(spark, folder):
    return _classified(spark, folder)["conflicts"]


@query("views_complementary", _views_sql("SELECT view1, view2, key FROM cm"))
def views_complementary(spark, folder):
    return _classified(spark, folder)["complementary"]


@query("four_c_edges", _views_sql(""", con AS (SELECT view1, view2, string_agg(key, ';' ORDER BY key) AS k, sum(n_values)::BIGINT AS n FROM cf GROUP BY ALL), com AS (SELECT view1, view2, string_agg(key, ';' ORDER BY key) AS k FROM cm GROUP BY ALL)
SELECT view1, view2, relation, '' AS keys, 0::BIGINT AS n_values FROM strong UNION ALL
SELECT view1, view2, CASE WHEN con.k IS NOT NULL AND com.k IS NOT NULL THEN 'contradictory/complementary' WHEN con.k IS NOT NULL THEN 'contradictory' ELSE 'complementary' END, concat_ws('|', con.k, com.k), coalesce(n, 0)
FROM con FULL JOIN com USING (view1, view2) WHERE (view1, view2) NOT IN (SELECT view1, view2 FROM strong)"""))
def four_c_edges(spark, folder):
    return _classified(spark, folder)["edges"]


@query("view_key_conflicts", _views_sql("SELECT DISTINCT a.value FROM ok a JOIN ok b ON a.key = b.key AND a.value = b.value WHERE a.key = 'c_custkey' AND a.view = 'all' AND b.view = 'moved' AND a.row <> b.row"))
def view_key_conflicts(spark, folder):
    return fourc.conflict_values(_classified(spark, folder)["keys"], "all", "moved", "c_custkey")


@query("distilled_views", _views_sql("SELECT view, n AS n_rows FROM vn WHERE view IN ('all', 'moved')"))
def distilled_views(spark, folder):
    left = fourc.distill(customer_views(spark, folder))
    out = None
    for name in sorted(left):
        n = fourc.curated(left[name]).agg(F.lit(name).alias("view"), F.count("*").alias("n_rows"))
        out = n if out is None else out.union(n)
    return out


@query("views_union", _views_sql("SELECT DISTINCT c_custkey, c_mktsegment, c_name FROM vr WHERE view IN ('no_building', 'no_machinery')"))
def views_union(spark, folder):
    v = customer_views(spark, folder)
    left = fourc.distill({k: v[k] for k in ("no_building", "no_machinery")})
    return left["no_building+no_machinery"]


@query("view_key_matches", "SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY') b ON a.k = b.k GROUP BY 1")
def view_key_matches(spark, folder):
    v = customer_views(spark, folder)
    return fourc.key_matches(v["no_building"], v["no_machinery"], "c_custkey")


@query("view_differing_cells", "SELECT c_custkey::VARCHAR AS key, 'c_mktsegment' AS \"column\", lower(c_mktsegment) AS one, 'automobile' AS two FROM customer WHERE c_nationkey = 3 AND c_mktsegment <> 'AUTOMOBILE'")
def view_differing_cells(spark, folder):
    v = customer_views(spark, folder)
    return fourc.differing_cells(v["all"], v["moved"], "c_custkey")


@query("repeated_projections", _projections_sql())
def repeated_projections(spark, folder):
    """Projections of the views on a target and a key, as join paths through them would use."""
    return fourc.repeated_projections(_projections(spark, folder))


@query("view_inconsistent_cells", "SELECT 'c_mktsegment' AS \"column\", count(*) FILTER (c_nationkey = 3 AND c_mktsegment <> 'AUTOMOBILE') AS n FROM customer UNION ALL SELECT 'c_name', 0")
def view_inconsistent_cells(spark, folder):
    v = customer_views(spark, folder)
    return fourc.inconsistent_cells(v["all"], v["moved"], "c_custkey")


# ---------------------------------------------------------------- questions

_SHARE = "SELECT '{v}' AS view, '{c}' AS attribute, round(avg((list_has_any(" + o.WORDS + ", ['building', '7']))::INT), 6) AS share FROM ({q})"


@query("question_attribute_coverage", "SELECT * FROM (VALUES ('c_custkey', 5::BIGINT, 1.0::DOUBLE), ('c_name', 5, 1.0), ('c_mktsegment', 5, 1.0)) t(attribute, n_views, coverage)")
def question_attribute_coverage(spark, folder):
    return questions.attribute_questions(questions.view_attributes(spark, customer_views(spark, folder)))


@query("question_datasets", "SELECT * FROM (VALUES ('nations', 0.333333::DOUBLE), ('regions', 0.75)) t(view, distance)")
def question_datasets(spark, folder):
    t = lake(spark, folder).tables
    return questions.dataset_questions(questions.view_attributes(spark, {"nations": t["nation"].select("n_name", "n_nationkey"), "regions": t["region"]}), "nationkey name")


@query("question_content", " UNION ALL ".join(_SHARE.replace("{}", f"CAST({c} AS VARCHAR)", 1).format(v=v, c=c, q=q) for v, q in _VIEWS.items() for c in _COLS))
def question_content(spark, folder):
    return questions.content_questions(customer_views(spark, folder), "building 7")


@query("question_contradictions", """WITH x AS (SELECT c_custkey::VARCHAR AS value, lower(c_mktsegment) AS a, 'automobile' AS b FROM customer WHERE c_nationkey = 3 AND c_mktsegment <> 'AUTOMOBILE')
SELECT value, round(levenshtein(a, b) / greatest(len(a), len(b)), 6) AS distance FROM x""")
def question_contradictions(spark, folder):
    c = _classified(spark, folder)
    return questions.contradiction_questions(fourc.conflict_rows(c["rows"], c["keys"], "all", "moved", "c_custkey"))


@query("question_word_clouds")
def question_word_clouds(spark, folder):
    names = [c for _, c, _ in o.columns()]
    return spark.createDataFrame([(c, ",".join(m)) for c, m in questions.k_centers(names, 10)], "center string, names string")


@query("shortlist_rank", "SELECT event_type AS view, sum(CASE WHEN value > 10 THEN 1 ELSE -1 END)::BIGINT AS score FROM events GROUP BY 1")
def shortlist_rank(spark, folder):
    answers = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_type").alias("view"), (F.col("value") > 10).alias("kept"))
    return questions.shortlist(answers)


# ---------------------------------------------------------------- vectors


def _knn_sql(distance: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
d AS (SELECT a.id AS query, b.id AS neighbor, round({distance}, 6) AS distance FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor)::INT AS rank FROM d) WHERE rank <= 10"""


def _vectors(spark, folder) -> tuple[DataFrame, DataFrame]:
    """All rows, and the stated queries: every row whose id is divisible by 20."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return rows, rows.filter(F.col("vec_id") % 20 == 0)


@query("knn_cosine", _knn_sql("1 - list_cosine_similarity(a.x, b.x)"))
def knn_cosine(spark, folder):
    return vectors.nearest(*_vectors(spark, folder), "vec_id", "embedding", 10, "cosine")


@query("knn_euclidean", _knn_sql("list_distance(a.x, b.x)"))
def knn_euclidean(spark, folder):
    return vectors.nearest(*_vectors(spark, folder), "vec_id", "embedding", 10, "euclidean")


@query("knn_manhattan", _knn_sql("list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))"))
def knn_manhattan(spark, folder):
    return vectors.nearest(*_vectors(spark, folder), "vec_id", "embedding", 10, "manhattan")


@query("knn_within", _knn_sql("1 - list_cosine_similarity(a.x, b.x)") + " AND distance < 0.7")
def knn_within(spark, folder):
    return vectors.within(knn_cosine(spark, folder), 0.7)


@query("ann_neighbors")
def ann_neighbors(spark, folder):
    return vectors.nearest_by_cells(*_vectors(spark, folder), "vec_id", "embedding")


@query("ann_lsh_recall", "WITH v AS (SELECT vec_id AS id FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0) SELECT (count(*) FILTER (id % 20 = 0) * least(10, count(*) - 1))::BIGINT AS n_true, true AS recall_90 FROM v")
def ann_lsh_recall(spark, folder):
    found = vectors.recall(knn_cosine(spark, folder), ann_neighbors(spark, folder))
    return found.select("n_true", (F.col("recall") >= 0.9).alias("recall_90"))


# ---------------------------------------------------------------- names, classes, notes

CLASSES = [(1, "business entity", None), (2, "customer", 1), (3, "supplier", 1), (4, "place", None), (5, "nation", 4), (6, "region", 4), (7, "asia", 6), (8, "europe", 6), (9, "africa", 6), (10, "part", 1), (11, "nationkey", 5), (12, "order priority", 1)]
_CLASSES = "classes(class_id, name, parent_id) AS (VALUES " + ", ".join(f"({i}, '{n}', {p or 'NULL'})" for i, n, p in CLASSES) + ")"
_NODES = "nodes(node, name) AS (VALUES " + ", ".join([f"('{t}', '{t}')" for t in o.TABLES] + [f"('{t}.{c}', '{c}')" for t, c, _ in o.columns()]) + ")"
_MATCH = f"""{_CLASSES}, {_NODES},
nw AS (SELECT node, list_distinct({o.NAME_WORDS.format('name')}) AS w FROM nodes), cw AS (SELECT class_id, list_distinct({o.NAME_WORDS.format('name')}) AS w FROM classes),
mt AS (SELECT node, class_id, round(len(list_intersect(nw.w, cw.w)) / len(list_distinct(list_concat(nw.w, cw.w))), 6) AS score FROM nw, cw),
ms AS (SELECT * FROM mt WHERE score >= 0.4)"""
_CLOSURE = "cl AS (SELECT class_id, class_id AS ancestor_id, 0 AS distance FROM classes UNION ALL SELECT cl.class_id, c.parent_id, distance + 1 FROM cl JOIN classes c ON c.class_id = ancestor_id WHERE c.parent_id IS NOT NULL)"


def _classes(spark) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class_id int, name string, parent_id int")


def _matches(spark) -> DataFrame:
    names = spark.createDataFrame([(t, t) for t in o.TABLES] + [(f"{t}.{c}", c) for t, c, _ in o.columns()], "node string, name string")
    return ontology.match_names(names, _classes(spark), 0.4)


@query("name_matching", f"WITH {_MATCH} SELECT * FROM ms")
def name_matching(spark, folder):
    return _matches(spark)


@query("content_matching", f"WITH {o.vals()}, {_CLASSES}, k AS (SELECT DISTINCT parent_id, lower(name) AS value FROM classes WHERE parent_id IS NOT NULL), n AS (SELECT parent_id, count(*) AS n FROM k GROUP BY 1) SELECT source, column_name, parent_id, round(count(*) / any_value(n), 6) AS share FROM vals JOIN k USING (value) JOIN n USING (parent_id) GROUP BY ALL HAVING count(*) / any_value(n) >= 0.4")
def content_matching(spark, folder):
    return ontology.match_content(index(spark, folder), _classes(spark), 0.4)


@query("content_matching_fuzzy", f"""WITH {o.vals()}, {_CLASSES}, k AS (SELECT DISTINCT parent_id, lower(name) AS name FROM classes WHERE parent_id IS NOT NULL), n AS (SELECT parent_id, count(*) AS n FROM k GROUP BY 1)
SELECT source, column_name, parent_id, round(count(DISTINCT name) / any_value(n), 6) AS share FROM vals JOIN k ON levenshtein(value, name) <= 0.4 * greatest(len(value), len(name)) + 1e-9 JOIN n USING (parent_id) GROUP BY ALL HAVING round(count(DISTINCT name) / any_value(n), 6) >= 0.1""")
def content_matching_fuzzy(spark, folder):
    return ontology.match_content_fuzzy(index(spark, folder), _classes(spark), 0.1, 0.6)


@query("class_ancestors", f"WITH RECURSIVE {_CLASSES}, {_CLOSURE} SELECT * FROM cl")
def class_ancestors(spark, folder):
    return ontology.ancestors(_classes(spark))


@query("semantic_links", f"WITH RECURSIVE {_MATCH}, {_CLOSURE} SELECT DISTINCT a.node AS node1, b.node AS node2 FROM ms a JOIN cl USING (class_id) JOIN ms b ON b.class_id = ancestor_id WHERE distance > 0 AND a.node <> b.node")
def semantic_links(spark, folder):
    return ontology.is_a_links(_matches(spark), ontology.ancestors(_classes(spark)))


NOTES = [
    ("ann", "Balances may be negative", notes.WARNING, "customer.c_acctbal", None, None, ["money"]),
    ("bob", "Same codes as the nation table", notes.INSIGHT, "customer.c_nationkey", "nation.n_nationkey", "MEANS_SAME", []),
    ("cat", "Are suppliers customers too?", notes.QUESTION, "supplier.s_suppkey", "customer.c_custkey", "SUBCLASS", ["scope"]),
]


@query("annotation_search", "SELECT text FROM (VALUES ('Balances may be negative'), ('Are suppliers customers too?')) t(text)")
def annotation_search(spark, folder):
    table, comments = notes.empty(spark)
    table = notes.annotate(table, NOTES)
    first = table.filter("author = 'ann'").select("id").first().id
    comments = notes.comment(comments, [(first, "dan", "Confirmed by the scope owners")])
    return table.join(notes.search_notes(table, comments, "scope"), "id", "left_semi").select("text")


@query("metadata_search", "WITH " + o.search_terms("codes negative", "SELECT source, column_name, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM (VALUES ('customer', 'c_acctbal', 'Balances may be negative'), ('customer', 'c_nationkey', 'Same codes as the nation table'), ('supplier', 's_suppkey', 'Are suppliers customers too?')) t(source, column_name, text)", "source, column_name") + " SELECT source, column_name, round(score, 5) AS score FROM found")
def metadata_search(spark, folder):
    """The words of notes on columns, searched like the columns' own."""
    table = notes.annotate(notes.empty(spark)[0], NOTES)
    labels = table.select(F.substring_index("source_node", ".", 1).alias("source"), F.substring_index("source_node", ".", -1).alias("column_name"), "text")
    return textsearch.search(index(spark, folder), "codes negative", textsearch.METADATA, limit=None, labels=labels).select("source", "column_name", r("score", 5))


@query("annotation_relations", "SELECT * FROM (VALUES ('customer.c_custkey', 'SUPERCLASS', 'supplier.s_suppkey'), ('supplier.s_suppkey', 'SUBCLASS', 'customer.c_custkey'), ('customer.c_nationkey', 'MEANS_SAME', 'nation.n_nationkey'), ('nation.n_nationkey', 'MEANS_SAME', 'customer.c_nationkey')) t(src, relation, dst)")
def annotation_relations(spark, folder):
    return notes.relation_edges(notes.annotate(notes.empty(spark)[0], NOTES)).select("src", "relation", "dst")
