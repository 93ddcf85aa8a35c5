"""Registered queries on columns: profiles, search, relations between columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import cells
from siltstone.operators import drift, profiling, relations, sketches, store, textsearch
from siltstone.operators import values as vx
from siltstone.plans import oracle as o
from siltstone.plans.shared import shared_dir
from siltstone.sources.catalog import Catalog, csv_with_rejects, parquet_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def lake(spark: SparkSession, folder: str) -> Catalog:
    return parquet_tables(spark, folder, o.TABLES)


def stored(spark: SparkSession, folder: str) -> store.Index:
    """The lake's index, built when a query first asks for it and read by all later ones of the application, unless a
    file of the lake has changed since."""
    state = store.state_of(spark, [f"{folder}/{t}.parquet" for t in o.TABLES])
    place = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/index-{state}"
    try:
        return store.open_index(spark, place)
    except LookupError:
        return store.build(lake(spark, folder), place, with_profiles=False)


def index(spark: SparkSession, folder: str, keep=None) -> DataFrame:
    values = stored(spark, folder).values
    return values if keep is None else values.filter(F.col("nid").isin([a.nid for a in lake(spark, folder).attributes() if keep(a)]))


def column_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder).pairs


def is_text(a) -> bool:
    return a.kind.simpleString() == "string"


def is_number(a) -> bool:
    return isinstance(a.kind, cells.NUMERIC)


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def profiles(spark: SparkSession, folder: str, keep=None, **config) -> DataFrame:
    return profiling.profile(lake(spark, folder), profiling.ProfileConfig(**config), keep)


def numeric_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric columns with exact quantiles."""
    p = profiles(spark, folder, is_number, semantic=False, cardinality=False, quantiles=False).drop("q25", "median", "q75", "iqr")
    return p.join(numeric_quantiles(spark, folder).drop("source", "column_name"), "nid")


def numeric_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles of numeric columns alone."""
    return profiling.quantiles_of(lake(spark, folder))


def r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


# ---------------------------------------------------------------- profiles

NUM_SQL = "SELECT '{t}' AS source, '{c}' AS column_name, count(*) AS total, count({q}) AS non_null, count(*) FILTER ({q} <> 0) AS non_empty, count(DISTINCT " + o.norm("{x}") + ") AS unique_values, min({q})::DOUBLE AS min_value, max({q})::DOUBLE AS max_value, round(avg({q}), 4) AS avg_value, round(stddev_pop({q}), 4) AS std_dev FROM {t}"


@query("profile_numeric", o.per_column(NUM_SQL, *o.NUMERIC))
def profile_numeric(spark, folder):
    p = profiling.with_exact_distinct(profiles(spark, folder, is_number, semantic=False, cardinality=False, quantiles=False), index(spark, folder, is_number))
    return p.select("source", "column_name", "total", "non_null", "non_empty", "unique_values", "min_value", "max_value", r("avg_value", 4), r("std_dev", 4))


@query("profile_text", o.per_column("SELECT '{t}' AS source, '{c}' AS column_name, count(*) AS total, count({q}) AS non_null, count(" + o.norm("{x}") + ") AS non_empty, count(DISTINCT " + o.norm("{x}") + ") AS unique_values FROM {t}", "str", "time"))
def profile_text(spark, folder):
    p = profiling.with_exact_distinct(profiles(spark, folder, lambda a: not is_number(a), semantic=False, cardinality=False, quantiles=False, range=False), index(spark, folder, lambda a: not is_number(a)))
    return p.select("source", "column_name", "total", "non_null", "non_empty", "unique_values")


QUANT_SQL = "SELECT '{t}' AS source, '{c}' AS column_name, quantile_disc({q}::DOUBLE, 0.25) AS q25, quantile_disc({q}::DOUBLE, 0.5) AS median, quantile_disc({q}::DOUBLE, 0.75) AS q75 FROM {t}"


@query("profile_quantiles", f"SELECT *, q75 - q25 AS iqr FROM ({o.per_column(QUANT_SQL, *o.NUMERIC)})")
def profile_quantiles(spark, folder):
    return numeric_quantiles(spark, folder).drop("nid")


@query("profile_distinct_hll")
def profile_distinct_hll(spark, folder):
    return profiles(spark, folder, semantic=False, quantiles=False, range=False).select("source", "column_name", "unique_values")


@query("profile_sketches")
def profile_sketches(spark, folder):
    return profiling.distinct_sketches(lake(spark, folder)).select("nid", F.hll_sketch_estimate("sketch").alias("unique_values"))


@query("column_ids")
def column_ids(spark, folder):
    return lake(spark, folder).metadata(spark).select("nid", "db", "source", "column_name", F.crc32(F.concat("db", "source", "column_name")).alias("crc"))


_T = "CASE WHEN lower(trim({x})) NOT IN ('', 'nan') THEN trim({x}) END"
INFER_SQL = "SELECT '{t}' AS source, '{c}' AS column_name, count(v) AS filled, count(*) FILTER (regexp_matches(v, '" + cells.NUMBER.replace("{", "{{").replace("}", "}}") + "')) AS num, count(*) FILTER (regexp_matches(v, '" + cells.INTEGER + "')) AS whole FROM (SELECT " + _T + " AS v FROM {t})"


@query("type_inference", f"SELECT *, CASE WHEN inferred = 'STRING' THEN 'T' ELSE 'N' END AS data_type FROM (SELECT source, column_name, filled, CASE WHEN filled = 0 OR num < filled THEN 'STRING' WHEN whole < num THEN 'FLOAT' ELSE 'INT' END AS inferred FROM ({o.per_column(INFER_SQL)}))")
def type_inference(spark, folder):
    return profiling.infer_types(lake(spark, folder)).select("source", "column_name", "inferred", "filled", "data_type")


CLEAN_SQL = "SELECT '{t}' AS source, '{c}' AS column_name, count(*) AS total, count(*) FILTER (" + o.norm("{x}") + " IS NULL) AS missing, count(*) FILTER (" + o.norm("{x}") + " IS NOT NULL AND {x} <> trim(regexp_replace({x}, '\\s+', ' ', 'g'))) AS untidy FROM {t}"


@query("cleanliness", f"SELECT *, round(1 - (missing + untidy) / total, 6) AS clean FROM ({o.per_column(CLEAN_SQL)})")
def cleanliness(spark, folder):
    return profiling.cleanliness(lake(spark, folder)).drop("nid")


def _semantic_sql() -> str:
    case = "\n".join(f"WHEN count(*) FILTER (regexp_matches(v, '{p}')) > 0.5 * count(v) THEN '{kind}:{g}'" for kind, g, p in cells.SEMANTIC_PATTERNS)
    one = "SELECT '{t}' AS source, '{c}' AS column_name, CASE @ ELSE 'NONE:' END AS s FROM (SELECT nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '') AS v FROM {t})"
    every = o.per_column(one, "str", "time").replace("@", case)
    return f"SELECT source, column_name, split_part(s, ':', 1) AS semantic_type, nullif(split_part(s, ':', 2), '') AS granularity FROM ({every})"


@query("semantic_types", _semantic_sql())
def semantic_types(spark, folder):
    return profiling.semantic_types(lake(spark, folder)).drop("nid")


@query("cell_casting", o.per_column("SELECT '{t}' AS source, '{c}' AS column_name, count(v) AS n_numbers, round(coalesce(sum(v), 0), 2) AS sum_numbers FROM (SELECT CASE WHEN regexp_matches(trim({x}), '" + cells.NUMBER + "') THEN TRY_CAST(replace(trim({x}), ',', '') AS DOUBLE) END AS v FROM {t})"))
def cell_casting(spark, folder):
    return profiling.cast_cells(lake(spark, folder)).select("source", "column_name", "n_numbers", r("sum_numbers", 2))


@query("column_uniqueness", f"WITH {o.vals()}, u AS (SELECT source, column_name, count(*) / sum(cnt) AS uniqueness FROM vals GROUP BY ALL) SELECT source, column_name, round(uniqueness, 6) AS uniqueness, row_number() OVER (PARTITION BY source ORDER BY uniqueness DESC, column_name) = 1 AS likely_key FROM u")
def column_uniqueness(spark, folder):
    return profiling.uniqueness(index(spark, folder)).select("source", "column_name", r("uniqueness"), "likely_key")


_SKEL = "regexp_replace(regexp_replace(regexp_replace(value, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '9', 'g')"


@query("column_structure", f"WITH {o.vals('str', 'time')}, k AS (SELECT source, column_name, {_SKEL} AS skeleton, sum(cnt)::BIGINT AS n FROM vals GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, column_name ORDER BY n DESC, skeleton)::INT AS rank FROM k) WHERE rank <= 3")
def column_structure(spark, folder):
    return profiling.skeletons(index(spark, folder, lambda a: not is_number(a)), 3)


_LABELS = ", ".join(f"({k}, '{label}', '{s}')" for k, (label, s) in enumerate(profiling.LABELS))


@query("column_labels", f"WITH {o.vals()}, k AS (SELECT source, column_name, {_SKEL} AS skeleton, sum(cnt) AS n FROM vals GROUP BY ALL), t AS (SELECT source, column_name, sum(n) AS total FROM k GROUP BY ALL), l(position, label, skeleton) AS (VALUES {_LABELS}), s AS (SELECT source, column_name, label, n / total AS score, position FROM k JOIN l USING (skeleton) JOIN t USING (source, column_name) WHERE n / total >= 0.5) SELECT source, column_name, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source, column_name ORDER BY score DESC, position) AS i FROM s) WHERE i = 1")
def column_labels(spark, folder):
    return profiling.label_columns(index(spark, folder)).select("source", "column_name", "label", r("score"))


_META = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{'N' if k in o.NUMERIC else 'T'}')" for t, c, k in o.columns()) + ") m(source, column_name, data_type)"


@query("profiles_of_table", _META + " WHERE source = 'orders'")
def profiles_of_table(spark, folder):
    return profiling.profiles_of_table(profiles(spark, folder, semantic=False), "orders", ["source", "column_name", "data_type"])


@query("profiles_like", _META + " WHERE column_name ILIKE '%KEY'")
def profiles_like(spark, folder):
    return profiling.profiles_like(profiles(spark, folder, semantic=False), "column_name", "%KEY").select("source", "column_name", "data_type")


@query("profiles_by_ids", _META + " WHERE (source, column_name) IN (('nation', 'n_name'), ('part', 'p_size'))")
def profiles_by_ids(spark, folder):
    wanted = [a.nid for a in lake(spark, folder).attributes() if (a.source, a.column_name) in (("nation", "n_name"), ("part", "p_size"))]
    return profiling.profiles_by_ids(profiles(spark, folder, semantic=False), wanted).select("source", "column_name", "data_type")


@query("comparable_columns", f"WITH {o.vals('str', 'time')} SELECT source, column_name, count(*) AS unique_values FROM vals GROUP BY ALL HAVING count(*) >= 10")
def comparable_columns(spark, folder):
    p = profiling.with_exact_distinct(profiles(spark, folder, lambda a: not is_number(a), semantic=False, cardinality=False, quantiles=False, range=False), index(spark, folder, lambda a: not is_number(a)))
    return profiling.comparable(p).select("source", "column_name", "unique_values")


@query("numeric_signatures", f"SELECT source, column_name, median, q75 - q25 AS iqr, min_value, max_value FROM ({o.per_column(QUANT_SQL.replace(' FROM {t}', ', min({q})::DOUBLE AS min_value, max({q})::DOUBLE AS max_value FROM {t}'), *o.NUMERIC)})")
def numeric_signatures(spark, folder):
    return profiling.numeric_signatures(numeric_profiles(spark, folder))


@query("text_signatures", f"WITH {o.vals('str', 'time')}, p AS (SELECT source, column_name, unnest({o.WORDS.format('value')}) AS term FROM vals), q AS (SELECT source, column_name, term, count(*) AS tf FROM p GROUP BY ALL) SELECT * FROM q WHERE len(term) > 3 AND tf > 3 AND NOT regexp_matches(term, '[0-9]')")
def text_signatures(spark, folder):
    return profiling.text_signatures(textsearch.postings(index(spark, folder, lambda a: not is_number(a))))


# ---------------------------------------------------------------- search

CONTENT_DOCS = f"SELECT source, column_name, {o.WORDS.format('value')} AS words FROM vals"
NAMES = "SELECT source, column_name, {} AS words FROM (SELECT DISTINCT source, column_name FROM vals)"


def _search_sql(q: str, documents: str = CONTENT_DOCS, where: str = "") -> str:
    return f"WITH {o.vals()},{o.search_terms(q, documents, 'source, column_name')} SELECT source, column_name, score FROM found{where}"


@query("bm25_content", _search_sql("asia building widget 24"))
def bm25_content(spark, folder):
    return textsearch.search(index(spark, folder), "asia building widget 24", limit=None)


@query("bm25_topk", _search_sql("1998 01 05", where=" ORDER BY score DESC, source, column_name LIMIT 10"))
def bm25_topk(spark, folder):
    return textsearch.search(index(spark, folder), "1998 01 05")


@query("bm25_conjunctive", _search_sql("small ring", where=" WHERE hits = 2"))
def bm25_conjunctive(spark, folder):
    return textsearch.search(index(spark, folder), "small ring", limit=None, conjunctive=True)


@query("attribute_search", _search_sql("nationkey name", NAMES.format(o.NAME_WORDS.format("column_name"))))
def attribute_search(spark, folder):
    return textsearch.search(index(spark, folder), "nationkey name", textsearch.SCHEMA, limit=None)


@query("table_search", _search_sql("orders", NAMES.format(o.NAME_WORDS.format("source"))))
def table_search(spark, folder):
    return textsearch.search(index(spark, folder), "orders", textsearch.TABLE, limit=None)


@query("multi_keyword", f"SELECT source, column_name, max(score) AS score FROM (({_search_sql('asia')}) UNION ALL ({_search_sql('europe')})) GROUP BY ALL")
def multi_keyword(spark, folder):
    return textsearch.search_many(index(spark, folder), ["asia", "europe"])


@query("multi_context", f"SELECT source, column_name, max(score) AS score FROM (({_search_sql('part')}) UNION ALL ({_search_sql('part', NAMES.format(o.NAME_WORDS.format('source')))})) GROUP BY ALL")
def multi_context(spark, folder):
    return textsearch.in_contexts(index(spark, folder), ["part"], [textsearch.CONTENT, textsearch.TABLE])


@query("phrase_search", f"WITH {o.vals()} SELECT source, column_name, count(*) AS n_values FROM vals WHERE contains(value, 'not specified') GROUP BY ALL")
def phrase_search(spark, folder):
    return textsearch.phrase_search(index(spark, folder), "NOT SPECIFIED")


@query("fuzzy_search", f"WITH {o.vals()}, w AS (SELECT source, column_name, unnest({o.WORDS.format('value')}) AS word FROM vals) SELECT source, column_name, min(levenshtein(word, 'purchese'))::INT AS distance, count(DISTINCT word) AS n_words FROM w WHERE levenshtein(word, 'purchese') <= 2 GROUP BY ALL")
def fuzzy_search(spark, folder):
    return textsearch.fuzzy_search(index(spark, folder), "purchese")


@query("autocomplete", f"WITH {o.vals()} SELECT value, count(*) AS n_columns, sum(cnt)::BIGINT AS cnt FROM vals WHERE starts_with(value, 'm') OR levenshtein(substr(value, 1, 1), 'm') <= 0 GROUP BY ALL")
def autocomplete(spark, folder):
    return textsearch.autocomplete(index(spark, folder), "M")


_DOCS = f"WITH {o.search_terms('license the warranty', 'SELECT doc_id, ' + o.WORDS.format("coalesce(text, '')") + ' AS words FROM documents', 'doc_id').lstrip()}"


@query("bm25_documents", _DOCS + " SELECT doc_id, score FROM found")
def bm25_documents(spark, folder):
    q = "license the warranty"
    docs = textsearch.row_documents(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", q)
    return textsearch.bm25(docs, q).select("doc_id", "score")


# ---------------------------------------------------------------- relations between columns

_NAME_POST = f"post AS (SELECT source, column_name, term, count(*) AS tf FROM (SELECT source, column_name, unnest({o.NAME_WORDS.format('column_name')}) AS term FROM (SELECT DISTINCT source, column_name FROM vals)) GROUP BY ALL)"
_TEXT_POST = f"post AS (SELECT source, column_name, term, count(*) AS tf FROM (SELECT source, column_name, unnest({o.WORDS.format('value')}) AS term FROM vals) GROUP BY ALL)"
_COS = " SELECT source1, column_name1, source2, column_name2, round(cosine, 6) AS cosine FROM cos WHERE cosine >= {} AND source1 <> source2"


@query("tfidf_schema_sim", f"WITH {o.vals()}, {_NAME_POST},{o.COSINE}" + _COS.format(0.3))
def tfidf_schema_sim(spark, folder):
    return relations.schema_similar(index(spark, folder), 0.3)


@query("tfidf_text_cosine", f"WITH {o.vals('str')}, {_TEXT_POST},{o.COSINE}" + _COS.format(0.01))
def tfidf_text_cosine(spark, folder):
    return relations.text_similar(index(spark, folder, is_text), 0.01)


PAIRS = "source1, column_name1, source2, column_name2"


def pair_columns(*more: str) -> list:
    return [*relations.PAIR, *more]


@query("joinable_columns", o.similar(f"SELECT {PAIRS}, overlap, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM sim WHERE jaccard >= 0.7"))
def joinable_columns(spark, folder):
    pairs = relations.content_similar(column_pairs(spark, folder), 0.7)
    return pairs.select(*pair_columns("overlap"), r("jaccard"), r("containment"))


@query("jaccard_pairs", o.similar(f"SELECT {PAIRS}, overlap, n1, n2, round(jaccard, 6) AS jaccard FROM sim"))
def jaccard_pairs(spark, folder):
    return column_pairs(spark, folder).select(*pair_columns("overlap", "n1", "n2"), r("jaccard"))


@query("containment_pairs", o.similar(f"SELECT {PAIRS}, overlap, round(containment, 6) AS containment FROM sim WHERE containment >= 0.7"))
def containment_pairs(spark, folder):
    return relations.contained(column_pairs(spark, folder), 0.7).select(*pair_columns("overlap"), r("containment"))


@query("overlapping_columns", o.similar(f"SELECT {PAIRS}, overlap FROM sim WHERE overlap > 0.4 * (n1 + n2)"))
def overlapping_columns(spark, folder):
    return column_pairs(spark, folder).filter("overlap > 0.4D * (n1 + n2)").select(*pair_columns("overlap"))


@query("join_cardinality", o.similar(f"SELECT {PAIRS}, CASE WHEN most1 = 1 THEN '1' ELSE 'N' END || '-' || CASE WHEN most2 = 1 THEN '1' ELSE 'N' END AS join_card FROM sim WHERE jaccard >= 0.7"))
def join_cardinality(spark, folder):
    return relations.join_cardinality(relations.content_similar(column_pairs(spark, folder), 0.7)).select(*pair_columns("join_card"))


@query("inclusion_deps", o.similar(f"SELECT {PAIRS}, overlap FROM dir WHERE overlap = n1"))
def inclusion_deps(spark, folder):
    return relations.inclusions(column_pairs(spark, folder)).select(*pair_columns("overlap"))


_TEXT_NAMES = [f"{t}.{c}" for t, c, k in o.columns() if k not in o.NUMERIC]
_IS_NUM = f"(source1 || '.' || column_name1) NOT IN ({', '.join(repr(x) for x in _TEXT_NAMES)}) AND (source2 || '.' || column_name2) NOT IN ({', '.join(repr(x) for x in _TEXT_NAMES)})"
PKFK_SQL = f"SELECT {PAIRS}, greatest(n1 / filled1, n2 / filled2) AS weight FROM dir WHERE CASE WHEN {_IS_NUM} THEN overlap = n1 ELSE jaccard >= 0.7 END AND n2 / filled2 > 0.5"


def pkfk(spark, folder) -> DataFrame:
    numeric = lambda k: ~F.concat_ws(".", f"source{k}", f"column_name{k}").isin(_TEXT_NAMES)
    return relations.keys(column_pairs(spark, folder), 0.5, 0.7, numeric(1) & numeric(2))


@query("pkfk_edges", o.similar(f"SELECT {PAIRS}, round(weight, 6) AS weight FROM ({PKFK_SQL})"))
def pkfk_edges(spark, folder):
    return pkfk(spark, folder).select(*relations.PAIR, r("weight"))


@query("common_name_edges", f"WITH c AS ({_META} WHERE column_name ILIKE '%nationkey') SELECT a.source AS source1, a.column_name AS column_name1, b.source AS source2, b.column_name AS column_name2 FROM c a JOIN c b ON (a.source, a.column_name) < (b.source, b.column_name)")
def common_name_edges(spark, folder):
    return relations.common_names(lake(spark, folder).metadata(spark), "%nationkey")


_IV = f"iv AS (SELECT source, column_name, median - (q75 - q25) AS lo, median + (q75 - q25) AS hi FROM ({o.per_column(QUANT_SQL, *o.NUMERIC)}) WHERE q75 > q25)"


@query("numeric_overlap", f"""WITH {_IV}, p AS (SELECT a.source AS source1, a.column_name AS column_name1, b.source AS source2, b.column_name AS column_name2,
  CASE WHEN b.lo >= a.lo AND b.hi <= a.hi THEN (b.hi - b.lo) / (a.hi - a.lo) WHEN b.lo >= a.lo AND b.lo <= a.hi THEN (a.hi - b.lo) / (a.hi - a.lo)
       WHEN b.hi >= a.lo AND b.hi <= a.hi THEN (b.hi - a.lo) / (a.hi - a.lo) ELSE 0 END AS overlap FROM iv a JOIN iv b ON a.source <> b.source)
SELECT source1, column_name1, source2, column_name2, round(overlap, 6) AS overlap FROM p WHERE round(overlap, 6) >= 0.85""")
def numeric_overlap(spark, folder):
    return relations.numeric_overlaps(numeric_quantiles(spark, folder), 0.85)


KS_PAIRS = [(("lineitem", "l_quantity"), ("part", "p_size")), (("customer", "c_acctbal"), ("supplier", "s_acctbal")), (("lineitem", "l_extendedprice"), ("orders", "o_totalprice"))]


def _ks_sql() -> str:
    one = [f"SELECT {k} AS pair, {s} AS side, TRY_CAST({o.text(c, o.SCHEMA[t][c])} AS DOUBLE) AS x FROM {t}" for k, p in enumerate(KS_PAIRS) for s, (t, c) in enumerate(p)]
    names = ", ".join(f"({k}, '{a[0]}', '{a[1]}', '{b[0]}', '{b[1]}')" for k, (a, b) in enumerate(KS_PAIRS))
    return f"""WITH u AS ({' UNION ALL '.join(one)}), g AS (SELECT pair, x, count(*) FILTER (side = 0) AS n1, count(*) FILTER (side = 1) AS n2 FROM u WHERE x IS NOT NULL GROUP BY ALL),
c AS (SELECT pair, sum(n1) OVER w / sum(n1) OVER (PARTITION BY pair) AS f1, sum(n2) OVER w / sum(n2) OVER (PARTITION BY pair) AS f2 FROM g WINDOW w AS (PARTITION BY pair ORDER BY x)),
n(pair, source1, column_name1, source2, column_name2) AS (VALUES {names})
SELECT {PAIRS}, round(max(abs(f1 - f2)), 6) AS ks FROM c JOIN n USING (pair) GROUP BY ALL"""


@query("ks_statistic", _ks_sql())
def ks_statistic(spark, folder):
    asked = {x for p in KS_PAIRS for x in p}
    return relations.ks_statistics(index(spark, folder, lambda a: (a.source, a.column_name) in asked), KS_PAIRS)


@query("dbscan_1d", f"""WITH p AS (SELECT source, column_name, median FROM ({o.per_column(QUANT_SQL, *o.NUMERIC)})),
s AS (SELECT *, CASE WHEN median - lag(median) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (ORDER BY median, source, column_name)),
c AS (SELECT *, sum(fresh) OVER (ORDER BY median, source, column_name ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT source, column_name, median, CASE WHEN count(*) OVER (PARTITION BY k) >= 2 THEN k ELSE -1 END::BIGINT AS cluster FROM c""")
def dbscan_1d(spark, folder):
    return relations.gap_clusters(numeric_quantiles(spark, folder).select("source", "column_name", "median"), "median", 2.0)


@query("dbscan_signatures")
def dbscan_signatures(spark, folder):
    p = numeric_quantiles(spark, folder).filter("median is not null")
    scaled = lambda c: F.log1p(F.abs(F.col(c)))
    points = p.select(F.concat_ws(".", "source", "column_name").alias("node"), scaled("median").alias("m"), scaled("iqr").alias("i"))
    return relations.dense_clusters(points, "node", ["m", "i"], 0.3, 2)


def text_index(spark, folder) -> DataFrame:
    return index(spark, folder, lambda a: not is_number(a))


@query("minhash_signatures")
def minhash_signatures(spark, folder):
    return sketches.signatures(text_index(spark, folder))


@query("one_permutation_signatures")
def one_permutation_signatures(spark, folder):
    return sketches.one_permutation(text_index(spark, folder), 64)


@query("lsh_candidates")
def lsh_candidates(spark, folder):
    bands, rows = sketches.banding(0.5, 64)
    return sketches.band_candidates(sketches.signatures(index(spark, folder), 64), bands, rows)


@query("minhash_jaccard")
def minhash_jaccard(spark, folder):
    sig = sketches.signatures(index(spark, folder), 64)
    bands, rows = sketches.banding(0.5, 64)
    return sketches.similar_columns(sig, sketches.band_candidates(sig, bands, rows), 0.5)


@query("lsh_recall", o.similar("SELECT count(*) AS n_true, true AS recall_90 FROM sim WHERE jaccard >= 0.7"))
def lsh_recall(spark, folder):
    """Of the pairs of columns with an exact Jaccard similarity of 0.7 or more (of their values), how many banding meets."""
    named = lambda df: df.select(F.array_sort(F.array(F.concat_ws(".", "source1", "column_name1"), F.concat_ws(".", "source2", "column_name2"))).alias("pair"))
    true = named(relations.content_similar(column_pairs(spark, folder), 0.7))
    met = true.join(named(lsh_candidates(spark, folder)), "pair", "left_semi")
    n = true.agg(F.count("*").alias("n_true")).crossJoin(F.broadcast(met.agg(F.count("*").alias("n_met"))))  # one row each
    return n.select("n_true", (F.col("n_met") >= F.col("n_true") * 0.9).alias("recall_90"))


_SOME = ("region", "nation", "supplier", "customer")


@query("index_refresh", o.similar(f"SELECT {PAIRS}, overlap, n1, n2 FROM sim WHERE source1 IN {_SOME} AND source2 IN {_SOME}"))
def index_refresh(spark, folder):
    """An index whose customers are a part of them and whose suppliers are missing, after both tables are refreshed."""
    whole = lake(spark, folder).tables
    place = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/refreshed-{uuid.uuid4().hex}"
    store.build(Catalog({"region": whole["region"], "nation": whole["nation"], "customer": whole["customer"].filter("c_custkey % 3 = 0")}), place, with_profiles=False)
    return store.refresh(Catalog({t: whole[t] for t in _SOME}), place, ["supplier", "customer"]).pairs.select(*pair_columns("overlap", "n1", "n2"))


@query("csv_rejects", "SELECT count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS n_rows, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) AS n_malformed, sum(o_orderkey) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)::BIGINT AS keys FROM orders")
def csv_rejects(spark, folder):
    """Orders written as CSV lines, some with a cell too many or too few, and read back by the reader."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(key, F.lit(',"a, b",c,d'))).when(F.col("o_orderkey") % 11 == 0, key).otherwise(F.concat(key, F.lit(',"a, ""b""",c')))
    place = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"
    orders.select(line.alias("value")).write.text(place)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "text", "rest")])
    good, bad = csv_with_rejects(spark, place, schema=schema, multiline=False, header=False)
    n = good.agg(F.count("*").alias("n_rows"), F.sum(F.col("key").cast("long")).alias("keys")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("n_malformed"))))  # one row each
    return n.select("n_rows", "n_malformed", "keys")


def _half(spark, folder, late: bool) -> Catalog:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    when = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return Catalog({"orders": orders.filter(when if late else ~when)})


_OLD, _NEW = (o.vals(name=n, where={"orders": f"o_orderdate {op} TIMESTAMP '1998-01-01'"}) for n, op in (("old", "<"), ("new", ">=")))


@query("column_drift", f"""WITH {_OLD}, {_NEW}, h AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.column_name, b.column_name) AS column_name, a.value AS a, b.value AS b FROM old a FULL JOIN new b ON a.column_name = b.column_name AND a.value = b.value),
n AS (SELECT source, column_name, count(a) AS n_old, count(b) AS n_new, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS overlap FROM h GROUP BY ALL)
SELECT *, round(overlap / (n_old + n_new - overlap), 6) AS jaccard FROM n""")
def column_drift(spark, folder):
    old, new = (vx.column_values(_half(spark, folder, late)) for late in (False, True))
    return drift.column_drift(old, new)
