"""Questions that narrow down a set of views, and which kind of question to ask next."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import cells

Distance = Callable[[str, str], float]


def word_distance(a: str, b: str) -> float:
    """1 - Jaccard of the words of two names; callers with an embedding model pass their own."""
    import re

    x, y = (set(re.findall(cells.TERM, re.sub("([a-z0-9])([A-Z])", r"\1 \2", s).lower())) for s in (a, b))
    return 1 - len(x & y) / len(x | y) if x | y else 0.0


def view_attributes(spark, views: Mapping[str, DataFrame], least_length: int = 3) -> DataFrame:
    """view, attribute."""
    rows = [(v, c) for v in sorted(views) for c in sorted(views[v].columns) if len(c) >= least_length]
    return spark.createDataFrame(rows, "view string, attribute string")


def attribute_questions(attributes: DataFrame) -> DataFrame:
    """attribute, n_views, coverage: how many of the views have it."""
    n = attributes.agg(F.count_distinct("view").alias("n"))
    per = attributes.groupBy("attribute").agg(F.count_distinct("view").alias("n_views"))
    return per.crossJoin(F.broadcast(n)).select("attribute", "n_views", F.round(F.col("n_views") / F.col("n"), 6).alias("coverage"))  # n is one row


def dataset_questions(attributes: DataFrame, query: str) -> DataFrame:
    """view, distance: 1 - Jaccard of the words of its header with the query's."""
    words = F.array_distinct(F.flatten(F.collect_list(cells.name_terms(F.col("attribute")))))
    header = attributes.groupBy("view").agg(words.alias("words"))
    return header.select("view", F.round(1 - cells.jaccard(F.col("words"), F.array_distinct(cells.terms(F.lit(query)))), 6).alias("distance"))


def content_questions(views: Mapping[str, DataFrame], query: str) -> DataFrame:
    """view, attribute, share: of the cells of each text column, how many hold a word of the query."""
    asked, out = F.array_distinct(cells.terms(F.lit(query))), None
    for name in sorted(views):
        v = views[name]
        texts = [f for f in v.schema.fields if isinstance(f.dataType, cells.SCALAR)]
        cols = [F.struct(F.lit(name).alias("view"), F.lit(f.name).alias("attribute"), F.round(F.avg(F.arrays_overlap(cells.terms(F.coalesce(cells.cell_text(F.col(f"`{f.name}`"), f.dataType), F.lit(""))), asked).cast("int")), 6).alias("share")) for f in texts]
        row = v.agg(*[c.alias(f"p{k}") for k, c in enumerate(cols)]).select(F.inline(F.array(*[f"p{k}" for k in range(len(cols))])))
        out = row if out is None else out.union(row)
    return out


def contradiction_questions(conflict_rows: DataFrame) -> DataFrame:
    """conflict_rows: value, view, row of two views -> value, distance: mean edit distance, relative to length, of the
    cells that differ between their least rows."""
    cell = F.split(F.min("row"), "\x1f")
    by = conflict_rows.groupBy("value", "view").agg(cell.alias("cells"))
    two = by.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("view", "cells"))).alias("x")).filter(F.size("x") == 2)
    d = F.zip_with(F.col("x")[0]["cells"], F.col("x")[1]["cells"], lambda a, b: F.when(a != b, F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))))
    d = F.filter(d, lambda v: v.isNotNull())
    mean = F.when(F.size(d) > 0, F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)).otherwise(0.0)
    return two.select("value", F.round(mean, 6).alias("distance"))


def k_centers(names: Sequence[str], k: int, distance: Distance = word_distance) -> list[tuple[str, list[str]]]:
    """Greedy k-center clusters of names: the first center is the first name in order, then always the farthest."""
    names = sorted(set(names))
    if not names:
        return []
    centers, near = [names[0]], {n: (distance(names[0], n), names[0]) for n in names}
    while len(centers) < min(k, len(names)):
        far = max(names, key=lambda n: (near[n][0], -names.index(n)))
        if near[far][0] <= 0:
            break
        centers.append(far)
        for n in names:
            d = distance(far, n)
            if d < near[n][0]:
                near[n] = d, far
    return [(c, [n for n in names if near[n][1] == c]) for c in centers]


@dataclass
class Chooser:
    """Which interface asks next: each in turn until it asked ceil(log2 n) times, then at random, more often those
    whose questions were answered."""

    interfaces: Sequence[str]
    explore: float = 0.1
    seed: int = 0
    asked: dict[str, int] = field(default_factory=dict)
    answered: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._random = random.Random(self.seed)

    def weights(self) -> list[float]:
        rate = [self.answered.get(i, 0) / self.asked[i] if self.asked.get(i) else 0.0 for i in self.interfaces]
        total, n = sum(rate), len(rate)
        return [(1 - self.explore) * (r / total if total else 1 / n) + self.explore / n for r in rate]

    def next(self, n_candidates: int) -> str:
        turns = ceil(log2(max(2, n_candidates)))
        waiting = [i for i in self.interfaces if self.asked.get(i, 0) < turns]
        pick = min(waiting, key=lambda i: (self.asked.get(i, 0), self.interfaces.index(i))) if waiting else self._random.choices(self.interfaces, self.weights())[0]
        self.asked[pick] = self.asked.get(pick, 0) + 1
        return pick

    def answer(self, interface: str, useful: bool) -> None:
        self.answered[interface] = self.answered.get(interface, 0) + useful


def shortlist(answers: DataFrame) -> DataFrame:
    """answers: view, kept (boolean) -> view, score: times kept less times ignored."""
    return answers.groupBy("view").agg(F.sum(F.when(F.col("kept"), 1).otherwise(-1)).alias("score"))
