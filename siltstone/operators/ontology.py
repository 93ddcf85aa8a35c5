"""Matching names of tables and columns with the classes of an ontology, and links that follow.

classes(class_id, name, parent_id) is given as a DataFrame; names are compared by their words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells
from siltstone.plans.shared import materialize

STOP = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def parse_triples(lines: Sequence[str]) -> list[tuple[str, str, str | None]]:
    """(class_id, name, parent_id) from N-Triples lines with rdfs:label and rdfs:subClassOf."""
    names, parents = {}, {}
    for line in lines:
        m = re.match(r'\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$', line)
        if m and m[2].endswith("#label"):
            names[m[1]] = m[4]
        elif m and m[2].endswith("#subClassOf"):
            parents[m[1]] = m[3]
    ids = sorted({*names, *parents, *parents.values()})
    return [(i, names.get(i, re.split(r"[/#]", i)[-1]), parents.get(i)) for i in ids]


def name_words(c: Column) -> Column:
    return F.array_except(F.array_distinct(cells.name_terms(c)), F.array(*[F.lit(w) for w in STOP]))


def ancestors(classes: DataFrame) -> DataFrame:
    """class_id, ancestor_id, distance (the least); a class is its own ancestor at 0. Goes on until no pair is new, so
    neither depth nor cycles matter."""
    up = materialize(classes.filter("parent_id is not null").select(F.col("class_id").alias("k"), "parent_id").distinct(), "classes")
    seen = now = materialize(classes.select("class_id", F.col("class_id").alias("ancestor_id"), F.lit(0).alias("distance")).distinct(), "ancestors")
    while not now.isEmpty():
        ahead = now.join(up, now["ancestor_id"] == up["k"]).select("class_id", F.col("parent_id").alias("ancestor_id"), (F.col("distance") + 1).alias("distance")).distinct()
        now = materialize(ahead.join(seen.select("class_id", "ancestor_id"), ["class_id", "ancestor_id"], "left_anti"), "ancestors")
        seen = seen.unionByName(now)
    return seen


def match_names(names: DataFrame, classes: DataFrame, least: float = 0.5) -> DataFrame:
    """names: node, name -> node, class_id, score: word Jaccard of names and class names, through an index of words."""
    n = names.select("node", name_words(F.col("name")).alias("nw"))
    c = classes.select("class_id", name_words(F.col("name")).alias("cw"))
    shared = n.withColumn("w", F.explode("nw")).join(c.withColumn("w", F.explode("cw")), "w").groupBy("node", "class_id").agg(F.count("*").alias("k"), F.first(F.size("nw")).alias("n1"), F.first(F.size("cw")).alias("n2"))
    return shared.withColumn("score", F.round(F.col("k") / (F.col("n1") + F.col("n2") - F.col("k")), 6)).filter(F.col("score") >= least).select("node", "class_id", "score")


def match_content(values: DataFrame, classes: DataFrame, least: float = 0.4) -> DataFrame:
    """source, column_name, parent_id, share: columns whose values name at least `least` of the classes below one parent."""
    kids = classes.filter("parent_id is not null").select("parent_id", F.lower("name").alias("value")).distinct()
    size = kids.groupBy("parent_id").agg(F.count("*").alias("n"))
    hit = values.join(kids, "value").groupBy("source", "column_name", "parent_id").agg(F.count("*").alias("k"))
    return hit.join(size, "parent_id").select("source", "column_name", "parent_id", F.round(F.col("k") / F.col("n"), 6).alias("share")).filter(F.col("share") >= least)


def match_content_fuzzy(values: DataFrame, classes: DataFrame, least: float = 0.4, alike: float = 0.8) -> DataFrame:
    """The same with values that nearly name a class: their edit distance is at most 1 - `alike` of the longer one's length.
    Candidates share a chunk of the class's name: with d edits allowed, one of its d + 1 chunks stands unchanged in the
    value, moved by d places at most, so equal (chunk, place) pairs are joined and nothing is compared with everything."""
    kids = classes.filter("parent_id is not null").select("parent_id", F.lower("name").alias("name")).distinct()
    size = kids.groupBy("parent_id").agg(F.count("*").alias("n"))
    # the longer of the two is at most len / alike long, so the most edits follow from the class's name alone
    edits = lambda n: F.floor((1 - alike) * n + 1e-9).cast("int")
    own = kids.withColumn("d", edits(F.floor(F.length("name") / alike + 1e-9))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("d"))))
    at = lambda k: F.floor(k * F.length("name") / (F.col("d") + 1)).cast("int")
    own = own.withColumns({"from": at(F.col("chunk")), "piece": F.substring("name", at(F.col("chunk")) + 1, at(F.col("chunk") + 1) - at(F.col("chunk")))})
    probes = own.withColumn("place", F.explode(F.sequence(F.greatest(F.lit(0), F.col("from") - F.col("d")), F.col("from") + F.col("d")))).select("parent_id", "name", "piece", "place", F.length("piece").alias("wide"))
    wides = probes.select("wide").distinct()
    most = classes.agg(F.max(F.length("name")).alias("longest"))
    words = values.select("source", "column_name", "value").crossJoin(F.broadcast(most)).filter(F.length("value") * F.lit(alike) <= F.col("longest")).drop("longest")  # most is one row
    grams = words.join(F.broadcast(wides), F.col("wide") <= F.length("value"))  # a row for each length of chunks
    grams = grams.withColumn("place", F.explode(F.sequence(F.lit(0), F.length("value") - F.col("wide")))).withColumn("piece", F.substring("value", F.col("place") + 1, F.col("wide")))
    # chunks of class names are metadata and go to all tasks; neither values nor their pieces are shuffled
    near = grams.join(F.broadcast(probes.drop("wide")), ["piece", "place"]).filter(F.levenshtein("value", "name") <= (1 - alike) * F.greatest(F.length("value"), F.length("name")) + 1e-9)
    hit = near.groupBy("source", "column_name", "parent_id").agg(F.count_distinct("name").alias("k"))
    return hit.join(size, "parent_id").select("source", "column_name", "parent_id", F.round(F.col("k") / F.col("n"), 6).alias("share")).filter(F.col("share") >= least)


def match_embeddings(pairs: DataFrame, positive: float, negative: float, strong: float = 0.9) -> DataFrame:
    """pairs: node, class_id, similarity (of a word of each) -> node, class_id, score, sign: 1 above `positive` (or with one
    pair above `strong`), -1 below `negative`; others are left out."""
    own = pairs.groupBy("node", "class_id").agg(F.avg("similarity").alias("score"), F.max("similarity").alias("top"))
    sign = F.when((F.col("score") > positive) | (F.col("top") >= strong), 1).when(F.col("score") < negative, -1)
    return own.select("node", "class_id", "score", sign.alias("sign")).filter("sign is not null")


#: ways to reduce the similarities of two sets of words to one number
AGGREGATIONS = {
    "mean": lambda p: p.groupBy("node", "class_id").agg(F.avg("similarity").alias("score")),
    "max": lambda p: p.groupBy("node", "class_id").agg(F.max("similarity").alias("score")),
    "min": lambda p: p.groupBy("node", "class_id").agg(F.min("similarity").alias("score")),
    "median": lambda p: p.groupBy("node", "class_id").agg(F.percentile("similarity", 0.5).alias("score")),
    "max_average": lambda p: p.groupBy("node", "class_id", "word1").agg(F.max("similarity").alias("m")).groupBy("node", "class_id").agg(F.avg("m").alias("score")),
    "min_average": lambda p: p.groupBy("node", "class_id", "word1").agg(F.min("similarity").alias("m")).groupBy("node", "class_id").agg(F.avg("m").alias("score")),
}


def cohesive_groups(pairs: DataFrame, least: float) -> DataFrame:
    """pairs: table, word1, word2, similarity -> table, word: words that are similar to every other kept word of the table's
    largest such neighbourhood (words with the most similar partners)."""
    from pyspark.sql import Window

    near = pairs.filter(F.col("similarity") > least)
    both = near.select("table", "word1", "word2").union(near.select("table", F.col("word2"), F.col("word1")))
    stars = both.groupBy("table", "word1").agg(F.count_distinct("word2").alias("n"))
    best = stars.withColumn("r", F.row_number().over(Window.partitionBy("table").orderBy(F.desc("n"), "word1"))).filter("r = 1").select("table", F.col("word1").alias("center"))
    ring = both.join(best, "table").filter("word1 = center").select("table", F.col("word2").alias("word"))
    return ring.union(best.select("table", F.col("center"))).distinct()


def combine(*matches: DataFrame) -> DataFrame:
    """node, class_id, score: the best score of any matcher."""
    out = matches[0]
    for m in matches[1:]:
        out = out.unionByName(m.select(*out.columns))
    return out.groupBy("node", "class_id").agg(F.max("score").alias("score"))


def summarize(matches: DataFrame, closure: DataFrame, least_matches: int = 2, ratio: float = 0.8) -> DataFrame:
    """node, class_id: where at least `ratio` of a node's matches (two or more) lie below one proper ancestor, the nearest
    such ancestor in their place."""
    from pyspark.sql import Window

    n = matches.groupBy("node").agg(F.count_distinct("class_id").alias("n"))
    up = matches.select("node", "class_id").distinct().join(closure, "class_id").groupBy("node", "ancestor_id").agg(F.count_distinct("class_id").alias("k"), F.sum("distance").alias("d"))
    fits = up.join(n, "node").filter((F.col("n") >= least_matches) & (F.col("k") >= least_matches) & (F.col("k") >= ratio * F.col("n")))
    best = fits.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("d", "ancestor_id"))).filter("r = 1").select("node", F.col("ancestor_id").alias("class_id"))
    rest = matches.select("node", "class_id").distinct().join(best.select("node"), "node", "left_anti")
    return best.unionByName(rest)


def is_a_links(matches: DataFrame, closure: DataFrame) -> DataFrame:
    """node1, node2: node1 matches a class of which node2 matches a proper ancestor."""
    low = matches.select(F.col("node").alias("node1"), "class_id")
    high = matches.select(F.col("node").alias("node2"), F.col("class_id").alias("ancestor_id"))
    return low.join(closure.filter("distance > 0"), "class_id").join(high, "ancestor_id").filter("node1 <> node2").select("node1", "node2").distinct()


def precision_recall(found: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """n_found, n_true, n_both, precision, recall of two sets of rows."""
    f, t = found.select(*on).distinct(), truth.select(*on).distinct()
    counts = f.agg(F.count("*").alias("n_found")).crossJoin(F.broadcast(t.agg(F.count("*").alias("n_true")))).crossJoin(F.broadcast(f.join(t, list(on), "left_semi").agg(F.count("*").alias("n_both"))))  # one row each
    share = lambda n: F.when(F.col(n) > 0, F.col("n_both") / F.col(n)).otherwise(0.0)
    return counts.withColumns({"precision": share("n_found"), "recall": share("n_true")})
