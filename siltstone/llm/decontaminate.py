"""Benchmark decontamination by latent semantic retrieval.

1. Passage frequencies of the benchmark's words are counted over the whole corpus (words
   the benchmark lacks have no part in any inner product with it).
2. A randomised SVD of the benchmark's TF-IDF passages gives the latent space: subspace
   iteration from a seeded random matrix, whose products with the passage matrix are summed
   in Spark by blocks of words; only words x rank numbers reach the driver.
3. Every window of every text (`window` words, half overlapping) is projected and compared
   with all benchmark passages of a slice in blocks; pairs of cosine `min_cos` or more are
   candidates. A slice holds about `slice_words` words of items (at least one item), so what
   the driver and executors hold is bounded whatever the benchmark's size; more words mean
   more slices. A window must also cover `min_cover` of the passage's length in that
   direction, which a whole or paraphrased passage does and shared frequent words do not.
   A run of RUN words that stands in a passage makes a candidate as well, whatever the
   latent space keeps of it, so no word-for-word copy depends on the rank.
4. A candidate is checked on the text around the window by longest common subsequence of
   words (bit-parallel, then weighted by inverse frequency, so that shared function words
   don't count), and in the paraphrase range also by its answer: the words of the answer
   column, or else of the item's last sentence, must occur there.

   An item longer than a window also matches by any window of it that is held in this way.

Why the basis is fitted on the benchmark's passages: a basis of the corpus of the same rank
spans its frequent words and loses the rare ones that tell passages apart.

Defined results: null texts and items count as empty and match nothing; an item with fewer
than `min_words` words matches only where its words stand in a row (and those of the answer
column, if there is one, within a window around them), with cosine and share 1; the share of
a match by a window of an item is that of the window; the cosine is 0 where only a run of
words made the candidate; a match is one row per
document row and item; repeated rows give repeated matches; empty tables give no match.
Only the named columns are looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.plans.shared import arrow_bounds

WORDS = re.compile(r"[^\W_]+")
BLOCK = 256
RUN = 8


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _windows(n: int, half: int) -> list[tuple[int, int]]:
    """Half-overlapping windows of 2 * half words; the last may be shorter."""
    return [(a, min(n, a + 2 * half)) for a in range(0, max(1, n - half), half)]


def passage_frequencies(docs: DataFrame, text_col: str, vocab: dict[str, int], window: int) -> tuple[np.ndarray, int]:
    """Passages (consecutive, `window` words) that hold each word, and the number of passages."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    v = len(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df = shared.value.get, np.zeros(v + 1, np.int64)
        for b in batches:
            base, keys = 0, []
            for text in b.column(0).to_pylist():
                w = words_of(text)
                ids = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
                at = np.nonzero(ids >= 0)[0]
                keys.append((base + at // window) * v + ids[at])
                base += -(-len(w) // window)
            df[v] += base
            if keys:
                df[:v] += np.bincount(np.unique(np.concatenate(keys)) % v, minlength=v)
        hit = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(df[hit])], names=["word", "n"])

    out = np.zeros(v + 1, np.int64)
    for word, n in docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out[:v], int(out[v])


def randomised_svd(passages: DataFrame, weight: np.ndarray, rank: int, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """passages: ids array<int> -> words x rank, an orthonormal basis of leading right singular vectors of the weighted count matrix."""
    v = len(weight)
    q = np.random.default_rng(seed).standard_normal((v, min(v, rank + 16)))
    q, _ = np.linalg.qr(q)
    for step in range(rounds + 1):
        shared = passages.sparkSession.sparkContext.broadcast(q)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            z = np.zeros_like(m)
            for b in batches:
                for ids in b.column(0).to_pylist():
                    w, n = np.unique(np.array(ids, np.int64), return_counts=True)
                    x = n * weight[w]
                    z[w] += np.outer(x, x @ m[w])
            blocks = [k for k in range(0, v, BLOCK) if z[k : k + BLOCK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([z[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], names=["block", "part"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p) for p in table.column("part").to_pylist())
            return pa.table({"block": table.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})

        z = np.zeros_like(q)
        for block, part in passages.mapInArrow(product, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").collect():
            z[block : block + BLOCK] = np.frombuffer(part).reshape(-1, q.shape[1])
        if step < rounds:
            q, _ = np.linalg.qr(z)
    values, u = np.linalg.eigh(q.T @ z)
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]
    return q @ u[:, keep]


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words."""
    x = ids.astype(np.int64).view(np.uint64)
    h = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ x[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


class Item:
    """A benchmark item as word numbers, with what the checks need."""

    def __init__(self, key, ids: list[int], answer: list[int], weight: np.ndarray) -> None:
        self.key, self.ids, self.answer = key, np.array(ids), sorted(set(answer))
        self.masks: dict[int, int] = {}
        for k, w in enumerate(ids):
            self.masks[w] = self.masks.get(w, 0) | 1 << k
        self.weights = weight[self.ids]
        self.mass = float(self.weights.sum())
        self.answer_mass = float(weight[self.answer].sum()) if self.answer else 0.0

    def lcs(self, words: list[int]) -> int:
        full = (1 << len(self.ids)) - 1
        v, get = full, self.masks.get
        for w in words:
            if m := get(w):
                u = v & m
                v = (v + u) | (v - u)
        return len(self.ids) - (v & full).bit_count()

    def weighted_lcs(self, words: list[int]) -> float:
        row = np.zeros(len(self.ids) + 1)
        for w in words:
            if w in self.masks:
                hit = np.where(self.ids == w, row[:-1] + self.weights, 0)
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
        return float(row[-1])


class Matcher:
    """The search over one slice of the benchmark."""

    def __init__(self, vocab, items, basis, weight, window, min_cos, min_cover, min_lcs, sure, short=()) -> None:
        self.short: dict[int, dict[int, list[Item]]] = {}  # words -> hash -> items
        for item in short:
            self.short.setdefault(len(item.ids), {}).setdefault(int(grams(item.ids, len(item.ids))[0]), []).append(item)
        self.vocab, self.items, self.half, self.min_cos, self.min_lcs, self.sure, self.weight = vocab, items, window // 2, min_cos, min_lcs, sure, weight
        self.w = np.vstack([basis * weight[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        rows, self.owner, self.parts, runs, run_of = [], [], [], [], []
        for k, item in enumerate(items):
            for a, b in _windows(len(item.ids), self.half):
                runs.append(grams(item.ids[a:b], RUN))
                run_of.append(np.full(len(runs[-1]), len(rows)))
                rows.append(self.w[item.ids[a:b]].sum(axis=0))
                self.owner.append(k)
                self.parts.append(Item(item.key, item.ids[max(0, b - window) : b].tolist(), item.answer, weight) if len(item.ids) > window else None)
        p = np.array(rows, np.float32).reshape(-1, basis.shape[1])
        norm = np.linalg.norm(p, axis=1, keepdims=True)
        self.passages = (p / np.maximum(norm, 1e-9)).T.copy()
        self.least = min_cover * norm[:, 0]  # a window must cover that part of the passage's own length
        self.owner = np.array(self.owner)
        run, passage = np.concatenate([np.zeros(0, np.uint64), *runs]), np.concatenate([np.zeros(0, np.int64), *run_of])
        by = np.lexsort((passage, run))
        self.runs, first = np.unique(run[by], return_index=True)
        self.run_ends, self.run_of = np.append(first, len(by)), passage[by]

    def copies(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(text, start word, passage, 0) of each passage of which a run of words stands in the text, once per window."""
        gap = [np.full(RUN, -1, np.int64)]
        ids = np.concatenate([x for t in texts for x in (t, *gap)] or gap)
        known = np.convolve(ids < 0, np.ones(RUN, np.int64), "valid") == 0 if len(ids) >= RUN else np.zeros(0, bool)
        at = np.nonzero(known)[0]
        if not len(at) or not len(self.runs):
            return
        h = grams(ids, RUN)[at]
        pos = np.searchsorted(self.runs, h)
        pos[pos == len(self.runs)] = 0
        hit = np.nonzero(self.runs[pos] == h)[0]
        ends = np.cumsum([len(t) + RUN for t in texts])
        owner = np.searchsorted(ends, at[hit], "right")
        start = at[hit] - np.append(0, ends)[owner]
        done = set()
        for d, s, r in zip(owner.tolist(), start.tolist(), pos[hit].tolist()):
            for j in self.run_of[self.run_ends[r] : self.run_ends[r + 1]].tolist():
                if (d, j, s // (2 * self.half)) not in done:
                    done.add((d, j, s // (2 * self.half)))
                    yield d, s, j, 0.0

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(text, start word, passage, cosine) of each window and passage that are close."""
        h = self.half
        sizes = [-(-len(x) // h) for x in texts]
        ids = np.full(sum(sizes) * h, -1, np.int64)
        at = 0
        for x, n in zip(texts, sizes):
            ids[at : at + len(x)] = x
            at += n * h
        owner = np.repeat(np.arange(len(texts)), sizes)
        first = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        blocks = []
        for a in range(0, len(ids), 512 * h):
            part = ids[a : a + 512 * h]
            where = np.nonzero(part >= 0)[0]
            rows = self.w[np.append(part[where], -1)]
            edges = np.searchsorted(where, np.arange(0, len(part), h))
            sums = np.add.reduceat(rows, edges, axis=0)
            sums[np.diff(np.append(edges, len(where))) == 0] = 0
            blocks.append(sums)
        if not blocks:
            return
        b = np.concatenate(blocks)
        joined = owner[1:] == owner[:-1]
        lone = np.append(~joined, True) & (np.arange(len(b)) > first)  # a text's last block is in the window before
        b[:-1][joined] += b[1:][joined]
        norm = np.maximum(np.linalg.norm(b, axis=1), 1e-9)
        norm[lone] = np.inf
        for s in range(0, len(b), 2048):
            dot = b[s : s + 2048] @ self.passages
            cos = dot / norm[s : s + 2048, None]
            for i, j in zip(*np.nonzero((cos >= self.min_cos) & (dot >= self.least))):
                k = s + int(i)
                yield int(owner[k]), int(k - first[k]) * h, int(j), float(cos[i, j])

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item key, cosine, share, start word) of the best window of each item that it holds."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.items and not self.short:
            return out
        get, ids = self.vocab.get, []
        for t in texts:
            w = words_of(t)
            ids.append(np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)))
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        for d, start, j, cos in chain(self.candidates(ids), self.copies(ids)) if self.items else ():
            k = int(self.owner[j])
            if (d, k) in best and best[d, k][0] >= 0.999:
                continue
            item, part = self.items[k], self.parts[j]
            share = self.held(item, ids[d], start, len(item.ids))
            if share is None and part is not None:
                share = self.held(part, ids[d], start, self.half)
            if share is not None and ((d, k) not in best or share > best[d, k][0]):
                best[d, k] = share, cos, start
        for (d, k), (share, cos, start) in sorted(best.items()):
            out[d].append((self.items[k].key, cos, share, start))
        for n, table in self.short.items():
            for d, x in enumerate(ids):
                out[d] += [(item.key, 1.0, 1.0, at) for item, at in self.verbatim(x, n, table)]
        return out

    def held(self, item: Item, words: np.ndarray, start: int, reach: int) -> float | None:
        """The item's weighted share in the text around a window; None if it isn't held."""
        region = words[max(0, start - reach) : start + 2 * self.half + reach].tolist()
        if item.lcs(region) < self.min_lcs * len(item.ids):
            return None
        share = item.weighted_lcs(region) / max(item.mass, 1e-9)
        if share < self.min_lcs:
            return None
        if share < self.sure and item.answer_mass > 0:
            there = set(region)
            if sum(self.weight[x] for x in item.answer if x in there) < 0.5 * item.answer_mass:
                return None
        return share

    def verbatim(self, words: np.ndarray, n: int, table: dict[int, list[Item]]) -> Iterator[tuple[Item, int]]:
        """Short items whose words stand in a row, each at its first place with its answer near."""
        h, done = grams(words, n), set()
        for at in np.nonzero(np.isin(h, np.fromiter(table, np.uint64, len(table))))[0].tolist():
            for item in table[int(h[at])]:
                near = words[max(0, at - 2 * self.half) : at + n + 2 * self.half]
                if id(item) not in done and np.array_equal(item.ids, words[at : at + n]) and np.isin(item.answer, near).all():
                    done.add(id(item))
                    yield item, at


def _matchers(docs: DataFrame, bench: DataFrame, text_col: str, item_col: str, item_text: str, answer_col: str | None, window: int, rank: int, min_cos: float, min_cover: float, min_lcs: float, sure: float, min_words: int, slice_words: int):
    spark = docs.sparkSession
    arrow_bounds(spark)
    own = bench.select(F.col(item_col).alias("key"), F.col(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    words = own.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")))).first()[0] or 0
    slices = max(1, math.ceil(words / slice_words))
    for k in range(slices):
        rows = own.filter(F.pmod(F.xxhash64("key", "text"), F.lit(slices)) == k).orderBy("key", "text").collect()
        texts = [(r.key, words_of(r.text), words_of(r.answer) or words_of(re.split(r"[.!?]\s*(?=\S)", r.text.strip())[-1] if r.text else "")) for r in rows]
        brief = [(r.key, words_of(r.text), words_of(r.answer)) for r in rows]
        brief = [x for x in brief if 0 < len(x[1]) < min_words]
        texts = [x for x in texts if len(x[1]) >= min_words]
        vocab = {w: i for i, w in enumerate(sorted({w for _, ws, aw in texts + brief for w in (*ws, *aw)}))}
        if not vocab:
            continue
        df, n = passage_frequencies(docs, text_col, vocab, window)
        weight = np.log((n + 1) / (df + 1)) + 0.01
        items = [Item(key, [vocab[w] for w in ws], [vocab[w] for w in aw], weight) for key, ws, aw in texts]
        passages = items and spark.createDataFrame([([int(x) for x in i.ids[a:b]],) for i in items for a, b in _windows(len(i.ids), window // 2)], "ids array<int>")
        basis = randomised_svd(passages, weight, rank) if items else np.zeros((len(vocab), 1))
        short = [Item(key, [vocab[w] for w in ws], [vocab[w] for w in aw], weight) for key, ws, aw in brief]
        yield spark.sparkContext.broadcast(Matcher(vocab, items, basis, weight, window, min_cos, min_cover, min_lcs, sure, short))


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, window: int = 64, rank: int = 256, min_cos: float = 0.15, min_cover: float = 0.35, min_lcs: float = 0.6, sure: float = 0.85, min_words: int = 8, slice_words: int = 250_000) -> DataFrame:
    """One row per document row and item it holds: id, item, cosine, share, start_word."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, own.schema["id"].dataType), T.StructField(item_col, bench.schema[item_col].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("start_word", T.LongType())])
    out = None
    for shared in _matchers(docs, bench, text_col, item_col, item_text, answer_col, window, rank, min_cos, min_cover, min_lcs, sure, min_words, slice_words):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds, matcher = to_arrow_schema(schema), shared.value
            for b in batches:
                rows = [(key, item, round(cos, 4), round(share, 4), start) for key, hits in zip(b.column(0).to_pylist(), matcher.matches(b.column(1).to_pylist())) for item, cos, share, start in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, window: int = 64, rank: int = 256, min_cos: float = 0.15, min_cover: float = 0.35, min_lcs: float = 0.6, sure: float = 0.85, min_words: int = 8, slice_words: int = 250_000) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    names, at = docs.columns, docs.columns.index(text_col)
    for shared in _matchers(docs, bench, text_col, item_col, item_text, answer_col, window, rank, min_cos, min_cover, min_lcs, sure, min_words, slice_words):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for b in batches:
                yield b.filter(pa.array([not hits for hits in matcher.matches(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
