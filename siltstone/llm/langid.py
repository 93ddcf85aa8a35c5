"""Language identification by segmentation-marginalised unigrams.

A word is a string of pieces of a fixed public vocabulary; its probability in a language is
the sum over all its segmentations of the product of the pieces' probabilities in that
language, computed by a forward pass. A text's score is the product over its words. Piece
probabilities are learned by expectation maximisation on the same lattice (forward and
backward passes over word types with their counts). The vocabulary itself is never
trained: it is read from `vocabulary`, whose path is a parameter.

The model is fitted on a bounded sample of labelled rows: about `per_lang` documents of
each language in expectation, whole texts, chosen by a hash of the id. Prediction covers
every row and every word. A stage rejects what no learned language explains better than a
model in which all pieces of the vocabulary are alike (`keep_identified`).

Defined results: null text or a text without a letter is `und` with score 0; with no
labelled rows everything is `und`; rows with null lang are not learned from; a null id
counts as the empty string for the fold; ties go to the first language by code point; an
empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.plans.shared import arrow_bounds

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORDS = re.compile(r"[^\W\d_]+")
START = "▁"
UNKNOWN = 1e-7  # of a character that no piece covers
LONGEST = 16


def pieces(path: str) -> dict[str, int]:
    """Number of each piece that can occur in lower-cased words; the last number stands for unknown characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and p == p.lower() and len(p) <= LONGEST:
            out.setdefault(p, len(out))
    return out


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Lattice:
    """Words of one length; for each end and piece length the piece numbers of all words."""

    def __init__(self, words: list[str], number: dict[str, int]) -> None:
        self.n, unk = len(words[0]) + 1, len(number)
        marked = [START + w for w in words]
        get = number.get
        self.arcs: list[list[tuple[int, np.ndarray]]] = []
        for j in range(1, self.n + 1):
            at = []
            for i in range(max(0, j - LONGEST), j):
                ids = [get(w[i:j], -1) for w in marked]
                if i == j - 1:
                    ids = [unk if x < 0 else x for x in ids]
                elif max(ids) < 0:
                    continue
                at.append((i, np.array(ids, np.int32)))
            self.arcs.append(at)

    def forward(self, p: np.ndarray, keep: bool = False):
        """p: pieces x languages, with a row for unknown characters and a last row of zeros.
        Log probabilities, words x languages; with keep also the scaled forward values."""
        width = p.shape[1]
        size = len(self.arcs[0][0][1])
        f: list[np.ndarray | None] = [np.ones((size, width))]
        logs = np.zeros((size, width))
        scale = [logs]
        for j, at in enumerate(self.arcs, 1):
            here = np.zeros((size, width))
            for i, ids in at:
                here += f[i] * p[ids]
            m = here if j == self.n or j % 8 == 0 else None
            if m is not None:
                for i in range(max(0, j - LONGEST), j):
                    f[i] = f[i] / m
                here = np.ones_like(here)
                logs = logs + np.log(m)
            f.append(here)
            if not keep and j >= LONGEST:
                f[j - LONGEST] = None
        return logs


def expected(words: list[str], counts: np.ndarray, number: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of one length under p, one language."""
    lat, total = Lattice(words, number), np.zeros(len(p))
    if lat.n > 41:
        return _expected_of_long(lat, counts, p)
    f = [np.ones(len(words))]
    for at in lat.arcs:
        f.append(sum(f[i] * p[ids] for i, ids in at))
    b = [np.zeros(len(words)) for _ in f]
    b[-1] = np.ones(len(words))
    for j in range(lat.n, 0, -1):
        for i, ids in lat.arcs[j - 1]:
            b[i] = b[i] + p[ids] * b[j]
    weight = counts / np.maximum(f[-1], 1e-300)
    for j, at in enumerate(lat.arcs, 1):
        for i, ids in at:
            total += np.bincount(ids + (ids < 0) * len(p), f[i] * p[ids] * b[j] * weight, len(p) + 1)[: len(p)]
    return total


def _expected_of_long(lat: Lattice, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same in logarithms, as the probabilities of long words are too small for floats."""
    with np.errstate(divide="ignore"):
        logp, total, none = np.log(p), np.zeros(len(p)), np.full(len(counts), -np.inf)
    f, b = [np.zeros(len(counts))], [none] * lat.n + [np.zeros(len(counts))]
    for at in lat.arcs:
        f.append(np.logaddexp.reduce([f[i] + logp[ids] for i, ids in at]))
    for j in range(lat.n, 0, -1):
        for i, ids in lat.arcs[j - 1]:
            b[i] = np.logaddexp(b[i], logp[ids] + b[j])
    for j, at in enumerate(lat.arcs, 1):
        for i, ids in at:
            total += np.bincount(ids + (ids < 0) * len(p), np.exp(f[i] + logp[ids] + b[j] - f[-1]) * counts, len(p) + 1)[: len(p)]
    return total


def uniform(number: dict[str, int], unknown: float | None = None) -> np.ndarray:
    """All pieces alike, and characters that no piece covers like them or as stated."""
    q = np.full(len(number) + 2, 1.0 / max(1, len(number)))
    q[len(number) + 1] = 0
    if unknown is not None:
        q[len(number)] = unknown
    return q


def fit(counts: dict[str, Counter], number: dict[str, int], rounds: int = 3, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and the matrix for Lattice.forward."""
    langs = sorted(counts)
    k = len(number)
    p = np.zeros((k + 2, len(langs)))
    for c, lang in enumerate(langs):
        by_len: dict[int, list[str]] = defaultdict(list)
        for w in sorted(counts[lang]):
            by_len[len(w)].append(w)
        q = uniform(number, UNKNOWN)
        for _ in range(rounds):
            got = np.zeros(k + 2)
            for words in by_len.values():
                for at in range(0, len(words), 20_000):
                    part = words[at : at + 20_000]
                    got += expected(part, np.array([counts[lang][w] for w in part], float), number, q)
            q[:k] = (got[:k] + smooth) / (got[:k].sum() + smooth * k)
        p[:, c] = q
    return langs, p


class Scorer:
    """Scores texts; remembers up to `room` words."""

    def __init__(self, number: dict[str, int], p: np.ndarray, room: int = 400_000) -> None:
        self.number, self.p, self.room = number, p, room
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = [np.zeros((0, self.p.shape[1]))]

    def learn(self, words: set[str]) -> None:
        by_len: dict[int, list[str]] = defaultdict(list)
        for w in words:
            by_len[len(w)].append(w)
        for n in sorted(by_len):
            step = max(1, 400_000 // (n * n))
            for at in range(0, len(by_len[n]), step):
                part = by_len[n][at : at + step]
                base = len(self.index)
                self.index.update(zip(part, range(base, base + len(part))))
                self.rows.append(Lattice(part, self.number).forward(self.p))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[bool]]:
        """Log likelihoods (texts x languages) and whether there is a letter."""
        bags = [Counter(words_of(t)) for t in texts]
        if len(self.index) > self.room:
            self.clear()
        self.learn({w for b in bags for w in b if w not in self.index})
        table = np.concatenate(self.rows)
        self.rows = [table]
        out = np.zeros((len(texts), self.p.shape[1]))
        get = self.index.__getitem__
        for i, b in enumerate(bags):
            if b:
                ids = np.fromiter(map(get, b), np.int64, len(b))
                out[i] = np.fromiter(b.values(), float, len(b)) @ table[ids]
        return out, [any(c.isalpha() for w in b for c in w) for b in bags]


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> dict[str, Counter]:
    """Word counts by language of the sample: bounded by per_lang texts of each language."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))  # the text too, as ids may be null
    chosen = labelled.filter(draw < rate[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[lang].update(words_of(text))
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "word", "n"])

    out: dict[str, Counter] = {k: Counter() for k in sizes}
    for lang, word, n in chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        out[lang][word] = n
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, per_lang: int = 300) -> DataFrame:
    """id, held_out, lang_pred, score, letters for every row."""
    own = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("id"), held_out(id_col).alias("held_out"))
    return _judged(docs, own, id_col, text_col, lang_col, vocabulary, per_lang, False).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "letters")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, per_lang: int = 300, evidence: float = 50.0) -> DataFrame:
    """The rows whose text is of a learned language, with their columns. A text goes if it has no letter, or if the model
    of no language, which has all pieces of the vocabulary alike, explains it better than every language by `evidence`
    nats, so that a few unknown words don't reject a text. Without labelled rows only letters decide."""
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    own = docs.select(docs[text_col].alias("_text"), row)
    kept = _judged(docs, own, id_col, text_col, lang_col, vocabulary, per_lang, True, evidence).filter("known")
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _judged(docs: DataFrame, own: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary: str, per_lang: int, against_none: bool, evidence: float = 0.0) -> DataFrame:
    """own (its first column is the text) -> its other columns, lang_pred, score, letters, known."""
    arrow_bounds(docs.sparkSession)
    number = pieces(vocabulary)
    counts = sample_counts(docs, id_col, text_col, lang_col, per_lang)
    langs, p = fit(counts, number) if counts else (["und"], np.zeros((len(number) + 2, 1)))
    if against_none:
        none = uniform(number)
        if START in number:  # how often words start is no sign of a language
            none[number[START]] = p[number[START]].max()
        p = np.column_stack([p, none])
    known = bool(counts)
    model = docs.sparkSession.sparkContext.broadcast((number, p))  # vocabulary x languages
    schema = T.StructType([*own.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letters", T.BooleanType()), T.StructField("known", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            if known:
                like, letters = scorer.score(texts)
            else:
                like, letters = np.zeros((len(texts), p.shape[1])), [any(c.isalpha() for c in t or "") for t in texts]
            none = like[:, len(langs)] if against_none else np.full(len(texts), -np.inf)
            like = like[:, : len(langs)]
            best = like.argmax(axis=1) if len(texts) else np.zeros(0, int)
            post = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1) if len(texts) else np.zeros(0)
            pred = [langs[k] if x else "und" for k, x in zip(best, letters)]
            score = [float(s) if x and known else 0.0 for s, x in zip(post, letters)]
            fits = np.array(letters, bool) & (like.max(axis=1, initial=-np.inf) > none - evidence)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.bool_()), pa.array(fits)], names=schema.names)

    return own.mapInArrow(run, schema)
