"""Keyword search over documents that are columns of a catalog or rows of a table.

A search never builds postings of the whole corpus: one pass counts, for each document, its
length and the frequency of each query term; document frequencies and the mean length are
one more row. Postings are there for operators that need every term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.operators.prefix import running_sums
from siltstone.operators.values import co_occurrence
from siltstone.plans.shared import materialize, spread

CONTENT, SCHEMA, TABLE, ENTITIES, METADATA = "content", "schema", "table", "entities", "metadata"


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(cells.TERM, query.lower())))


def _frequencies(words: Column, terms: Sequence[str]) -> list[Column]:
    return [F.size(F.filter(words, lambda w: w == t)).cast("long") for t in terms]  # noqa: B023  (called at once)


def column_documents(values: DataFrame, query: str, domain: str = CONTENT, labels: DataFrame | None = None) -> DataFrame:
    """source, column_name, len, tf0, tf1, ...: a document per column: its distinct values, its name, its table's name, or for
    ENTITIES and METADATA what labels (source, column_name, text) say of it: entities that the caller's recogniser found,
    or notes."""
    keys = ["source", "column_name"]
    terms = query_terms(query)
    if domain in (ENTITIES, METADATA):
        if labels is None:
            raise ValueError(f"a search of {domain} needs labels: source, column_name, text")
        words = F.col("words")
        return labels.select(*keys, cells.terms(F.coalesce("text", F.lit(""))).alias("words")).groupBy(*keys).agg(F.sum(F.size(words)).alias("len"), *[F.sum(x).alias(f"tf{k}") for k, x in enumerate(_frequencies(words, terms))])
    if domain not in (CONTENT, SCHEMA, TABLE):
        raise ValueError(f"{domain}: one of {(CONTENT, SCHEMA, TABLE, ENTITIES, METADATA)}")
    if domain == CONTENT:
        words = F.col("words")  # made once, below the aggregation
        return values.select(*keys, cells.terms(F.col("value")).alias("words")).groupBy(*keys).agg(F.sum(F.size(words)).alias("len"), *[F.sum(x).alias(f"tf{k}") for k, x in enumerate(_frequencies(words, terms))])
    words = cells.name_terms(F.col("source" if domain == TABLE else "column_name"))
    return values.select(*keys).distinct().select(*keys, F.size(words).cast("long").alias("len"), *[x.alias(f"tf{k}") for k, x in enumerate(_frequencies(words, terms))])


def row_documents(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, len, tf0, ...: a document per row; null text is an empty one."""
    words = F.col("words")
    own = spread(rows.select(key, text)).select(key, cells.terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    return own.select(key, F.size(words).cast("long").alias("len"), *[x.alias(f"tf{k}") for k, x in enumerate(_frequencies(words, query_terms(query)))])


def bm25(documents: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, conjunctive: bool = False) -> DataFrame:
    """documents with score, those that hold a query term (conjunctive: all of them). The counts of documents are
    written to the shared folder, as they are read for the statistics and for the scores."""
    n_terms = len(query_terms(query))
    if not n_terms:
        return documents.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    documents = materialize(documents, "term-counts")
    df = [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(n_terms)]
    stats = documents.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"), *df)
    hits = [F.col(f"tf{k}") > 0 for k in range(n_terms)]
    wanted = hits[0]
    for h in hits[1:]:
        wanted = wanted & h if conjunctive else wanted | h

    def part(k: int) -> Column:
        tf, n = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5) + 1)
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))

    score = part(0)
    for k in range(1, n_terms):
        score = score + part(k)
    found = documents.filter(wanted).crossJoin(F.broadcast(stats))  # stats is one row
    drop = ["n_docs", "mean_len", *[f"df{k}" for k in range(n_terms)], *[f"tf{k}" for k in range(n_terms)]]
    return found.withColumn("score", F.round(score, 6)).drop(*drop)


def search(values: DataFrame, query: str, domain: str = CONTENT, limit: int | None = 10, conjunctive: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """source, column_name, score, best first."""
    out = bm25(column_documents(values, query, domain, labels), query, conjunctive=conjunctive).select("source", "column_name", "score")
    return out.orderBy(F.desc("score"), "source", "column_name").limit(limit) if limit else out


def search_many(values: DataFrame, queries: Sequence[str], domain: str = CONTENT) -> DataFrame:
    """Columns that any of the queries finds, with their best score: the union of single searches."""
    out = None
    for q in queries:
        found = search(values, q, domain, limit=None)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("source", "column_name").agg(F.max("score").alias("score"))


def phrase_search(values: DataFrame, phrase: str) -> DataFrame:
    """Columns with cells that contain the phrase, and how many."""
    return values.filter(F.col("value").contains(phrase.strip().lower())).groupBy("source", "column_name").agg(F.count("*").alias("n_values"))


def edits_allowed(term: str) -> int:
    """0 up to 2 letters, 1 up to 5, else 2."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def fuzzy_search(values: DataFrame, term: str, edits: int | None = None) -> DataFrame:
    """Columns with words at most `edits` edits from the term: source, column_name, distance (least), n_words."""
    term = term.lower()
    d = edits_allowed(term) if edits is None else edits
    words = values.select("source", "column_name", F.explode(F.array_distinct(cells.terms(F.col("value")))).alias("word"))
    near = words.filter(F.length("word").between(len(term) - d, len(term) + d)).withColumn("distance", F.levenshtein("word", F.lit(term), d)).filter("distance >= 0")
    return near.groupBy("source", "column_name").agg(F.min("distance").alias("distance"), F.count_distinct("word").alias("n_words"))


def autocomplete(values: DataFrame, prefix: str, edits: int = 0) -> DataFrame:
    """Distinct values that begin with the prefix, or within `edits` edits of it: value, n_columns, cnt."""
    p = prefix.lower()
    fits = F.col("value").startswith(p)
    if edits:
        fits = fits | (F.levenshtein(F.substring("value", 1, len(p)), F.lit(p)) <= edits)
    return values.filter(fits).groupBy("value").agg(F.count("*").alias("n_columns"), F.sum("cnt").alias("cnt"))


def postings(values: DataFrame) -> DataFrame:
    """source, column_name, term, tf over the distinct values of each column."""
    words = values.select("source", "column_name", F.explode(cells.terms(F.col("value"))).alias("term"))
    return words.groupBy("source", "column_name", "term").agg(F.count("*").alias("tf"))


def in_contexts(values: DataFrame, queries: Sequence[str], domains: Sequence[str]) -> DataFrame:
    """Every query in every domain, as one set of columns."""
    out = None
    for d in domains:
        found = search_many(values, queries, d)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("source", "column_name").agg(F.max("score").alias("score"))


def tfidf(postings: DataFrame, owner: list[str]) -> DataFrame:
    """owner, term, w: sublinear frequency times smoothed inverse document frequency, each owner's vector of length 1."""
    n = postings.select(*owner).distinct().agg(F.count("*").alias("n"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    w = postings.join(df, "term").crossJoin(F.broadcast(n))  # n is one row
    w = w.select(*owner, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(*owner).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, owner).withColumn("w", F.col("w") / F.col("norm")).drop("norm")


def cosine_pairs(vectors: DataFrame, owner: list[str], least: float) -> DataFrame:
    """Pairs of owners (columns of a catalog) whose vectors of length 1 have a cosine of `least` or more.

    Terms are ordered from rare to frequent. What is left of a vector behind the place where its length falls below
    `least` can't bring a cosine of `least` by itself, so such pairs share a term before that place in both vectors. Only
    these terms make candidates: a term that all columns share makes none. Candidates are then added up over all terms."""
    vectors = materialize(vectors.withColumn("_owner", F.struct(*owner)).select("_owner", "term", "w"), "vectors")
    df = vectors.groupBy("term").agg(F.count("*").alias("df"))
    # a number that orders terms by frequency and then by a hash
    placed = vectors.join(df, "term").select("_owner", "term", "w", (F.col("df") + F.pmod(F.xxhash64("term"), F.lit(1 << 30)) / F.lit(float(1 << 31))).alias("place"), (F.col("w") * F.col("w")).alias("w2"))
    before = running_sums(placed, ["_owner"], "place", ["w2"], then=("term",))
    # the length from this term on, itself included
    total = placed.groupBy("_owner").agg(F.sum("w2").alias("all"))
    head = before.join(total, "_owner").filter(F.col("all") - F.col("cum_w2") + F.col("w2") >= least * least - 1e-9).select("_owner", "term")
    pairs = co_occurrence(head, ["term"], "_owner").select("a", "b")
    dot = pairs.join(vectors.select(F.col("_owner").alias("a"), "term", F.col("w").alias("wa")), "a").join(vectors.select(F.col("_owner").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    dot = dot.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).filter(F.col("cosine") >= least)
    return dot.select(*[F.col(f"a.{c}").alias(f"{c}1") for c in owner], *[F.col(f"b.{c}").alias(f"{c}2") for c in owner], F.round("cosine", 6).alias("cosine"))


def name_postings(values: DataFrame) -> DataFrame:
    names = values.select("source", "column_name").distinct()
    return names.select("source", "column_name", F.explode(cells.name_terms(F.col("column_name"))).alias("term")).groupBy("source", "column_name", "term").agg(F.count("*").alias("tf"))
