"""Building blocks of the SQL that checks the registered queries on the eight relational tables."""

from __future__ import annotations

#: columns of the relational tables and what kind of cell they hold
SCHEMA: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "int", "r_name": "str"},
    "nation": {"n_nationkey": "int", "n_name": "str", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "dbl", "c_mktsegment": "str"},
    "supplier": {"s_suppkey": "int", "s_name": "str", "s_nationkey": "int", "s_acctbal": "dbl"},
    "part": {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "dbl"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "dbl", "o_orderdate": "time", "o_orderpriority": "str"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "dbl", "l_extendedprice": "dbl", "l_discount": "dbl", "l_tax": "dbl", "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "time"},
    "events": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "str", "value": "dbl", "props": "str"},
}
TABLES = list(SCHEMA)
NUMERIC = ("int", "dbl")


def columns(*kinds: str) -> list[tuple[str, str, str]]:
    return [(t, c, k) for t, cs in SCHEMA.items() for c, k in cs.items() if not kinds or k in kinds]


def text(column: str, kind: str) -> str:
    q = f'"{column}"'
    return {"dbl": f"CAST(CAST({q} AS DECIMAL(38,6)) AS VARCHAR)", "time": f"strftime({q}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"CAST({q} AS VARCHAR)")


def per_column(template: str, *kinds: str) -> str:
    """UNION ALL of the template over columns; {t}, {c}, {q} (quoted column) and {x} (its text) are filled in."""
    return "\nUNION ALL ".join(template.format(t=t, c=c, q=f'"{c}"', x=text(c, k)) for t, c, k in columns(*kinds))


def norm(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) NOT IN ('', 'nan', 'null') THEN lower(trim({x})) END"


def vals(*kinds: str, name: str = "vals", where: dict[str, str] | None = None) -> str:
    parts = [f"SELECT '{t}' AS source, '{c}' AS column_name, {norm(text(c, k))} AS value FROM {t}" + (f" WHERE {where[t]}" if where and t in where else "") for t, c, k in columns(*kinds) if where is None or t in where]
    return f"{name} AS MATERIALIZED (SELECT source, column_name, value, count(*) AS cnt FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL GROUP BY ALL)"


SIM = """
sz AS MATERIALIZED (SELECT source, column_name, count(*) AS n, sum(cnt)::BIGINT AS filled, max(cnt) AS most FROM vals GROUP BY ALL),
ov AS MATERIALIZED (SELECT a.source AS source1, a.column_name AS column_name1, b.source AS source2, b.column_name AS column_name2, count(*) AS overlap
  FROM vals a JOIN vals b ON a.value = b.value AND a.source <> b.source AND (a.source, a.column_name) < (b.source, b.column_name) GROUP BY ALL),
sim AS MATERIALIZED (SELECT ov.*, x.n AS n1, y.n AS n2, x.filled AS filled1, y.filled AS filled2, x.most AS most1, y.most AS most2,
    overlap / (x.n + y.n - overlap) AS jaccard, greatest(overlap / x.n, overlap / y.n) AS containment
  FROM ov JOIN sz x ON x.source = source1 AND x.column_name = column_name1 JOIN sz y ON y.source = source2 AND y.column_name = column_name2)"""

DIRECTED = """
dir AS MATERIALIZED (SELECT source1, column_name1, source2, column_name2, overlap, n1, n2, filled1, filled2, jaccard FROM sim
  UNION ALL SELECT source2, column_name2, source1, column_name1, overlap, n2, n1, filled2, filled1, jaccard FROM sim)"""

#: content edges both ways
EDGES = """
e AS MATERIALIZED (SELECT source1 || '.' || column_name1 AS src, source2 || '.' || column_name2 AS dst, 'CONTENT_SIM' AS relation, jaccard AS weight FROM sim WHERE jaccard >= 0.7
  UNION ALL SELECT source2 || '.' || column_name2, source1 || '.' || column_name1, 'CONTENT_SIM', jaccard FROM sim WHERE jaccard >= 0.7)"""


def graph(body: str, recursive: bool = False) -> str:
    """A query over e(src, dst, relation, weight)."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{vals()},{SIM},{EDGES}\n{body}"


def similar(body: str, *kinds: str) -> str:
    """A query over sim and dir."""
    return f"WITH {vals(*kinds)},{SIM},{DIRECTED}\n{body}"


def search_terms(query: str, documents: str, keys: str) -> str:
    """BM25 over documents(keys, words list) for the words of a query: keys, score of documents with any, and hits."""
    import re

    terms = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    tf = ", ".join(f"len(list_filter(words, lambda w: w = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    sums = ", ".join(f"sum(tf{k}) AS tf{k}" for k in range(len(terms)))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    score = " + ".join(f"ln((n - df{k} + 0.5) / (df{k} + 0.5) + 1) * tf{k} * 2.2 / (tf{k} + 1.2 * (1 - 0.75 + 0.75 * l / mean_len))" for k in range(len(terms)))
    hits = " + ".join(f"(tf{k} > 0)::INT" for k in range(len(terms)))
    return f"""
docs AS ({documents}),
freq AS (SELECT {keys}, len(words) AS l, {tf} FROM docs),
doc AS (SELECT {keys}, sum(l) AS l, {sums} FROM freq GROUP BY ALL),
stat AS (SELECT count(*) AS n, avg(l) AS mean_len, {df} FROM doc),
found AS (SELECT {keys}, round({score}, 6) AS score, {hits} AS hits FROM doc, stat WHERE {hits} > 0)"""


WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
NAME_WORDS = r"regexp_extract_all(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"

COSINE = """
tot AS (SELECT count(*) AS n FROM (SELECT DISTINCT source, column_name FROM post)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w0 AS (SELECT source, column_name, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM post JOIN dfs USING (term), tot),
nrm AS (SELECT source, column_name, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY ALL),
vec AS (SELECT w0.source, w0.column_name, term, w / norm AS w FROM w0 JOIN nrm USING (source, column_name)),
cos AS (SELECT a.source AS source1, a.column_name AS column_name1, b.source AS source2, b.column_name AS column_name2, sum(a.w * b.w) AS cosine
  FROM vec a JOIN vec b ON a.term = b.term AND (a.source, a.column_name) < (b.source, b.column_name) GROUP BY ALL)"""
