"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base spans follow the contract's patterns exactly. Written-out or disguised data that
they miss ("name [at] host [dot] org", "555-123-4567", "4111.1111.1111.1111",
"10[.]0[.]0[.]1") is found by a semi-Markov CRF: features see a whole candidate segment
(its digit groups, checksum, separators, markers and the word before it), and a dynamic
programme over tokens, with segments of at most LONGEST tokens, chooses boundaries and
types together. Training maximises the conditional likelihood on generated sentences
(seeded, about 350, with look-alikes such as dates, versions and order numbers), by
gradient ascent with forward and backward passes over segments; it takes a few seconds on
the driver and its result, some hundred weights, goes to the executors.

Only zones of the text are decoded: LONGEST tokens around a bracketed "at"/"dot", the word
"dot", a plain "at" between a name and a domain, and seven digits without a letter between
them. Elsewhere a segment is outside the model's support, or holds a plain "at" without a
domain, whose score is below zero with whatever other features (`least_at` is checked in
the tests), so decoding zones gives what decoding whole texts gives.
Base spans stay and are walls: no added segment overlaps one.

Defined results: null text counts as empty (no spans); repeated rows keep their rows; an
empty table gives an empty result. Offsets are code points of the whole text. Only the
named columns are looked at.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import arrow_bounds

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match cannot start within a run of digits: from there it would have failed at the run's start too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, free := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---------------------------------------------------------------- the model

LONGEST = 17
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
SUFFIX = "com|org|net|edu|gov|info|io|eu|de|es|fr|it|nl|uk|us|ch|at"
NUMERIC = "".join(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
STRETCH = re.compile(rf"[0-9](?:[\W\d_{NUMERIC}])*+")  # no letter
SIGN = re.compile(rf"[\[({{<]\s?(?:at|dot|\.)\s?[\])}}>]|(?<=\s)dot(?=\s)|(?<=[a-z0-9._%+-]\s)at(?=\s[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{SUFFIX}))", re.I)
AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s", re.I)
DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s", re.I)
CONTEXT = (
    re.compile(r"mail|contact|write|reach", re.I),
    re.compile(r"^ip$|host|server|addr|ping", re.I),
    re.compile(r"card|visa|master|amex|pay|credit|karte|tarjeta|carte", re.I),
    re.compile(r"tel|phone|call|fax|mobile|cell|dial|text", re.I),
)
NATIONAL = re.compile(r"(?:1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}")
TRUNK = re.compile(r"0[0-9]{1,4}[ /-]\s?[0-9]{2,8}(?:[ -][0-9]{2,6}){0,4}")
INTERNATIONAL = re.compile(r"00[1-9][0-9]?(?:[ -]\(?[0-9]{1,6}\)?){2,6}")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:" + SUFFIX + ")")
N_FEATURES = 26


def features(text: str, start: int, end: int, before: str) -> np.ndarray | None:
    """Of a whole segment; None if it is outside the model's support."""
    s = text[start:end]
    digits = "".join(DIGITS.findall(s))
    n = len(digits)
    at, dot = bool(AT.search(s)), bool(DOT.search(s))
    letters = sum(c.isalpha() for c in s)
    if not (at or dot) and (n < 7 or letters):
        return None
    f = np.zeros(N_FEATURES)
    f[0] = 1
    plain = DOT.sub(".", AT.sub("@", s))
    f[1] = bool(SPELLED.fullmatch(plain)) and (at or dot)
    f[2] = f[1] and bool(re.search(r"[\[({<]", s))
    f[3] = plain.count("@") > 1 or (at and not f[1])
    parts = DOT.sub(".", s).split(".")
    f[4] = dot and len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    f[5] = dot and letters > 0 and not at
    f[6] = n > 0 and not letters and n < 10
    f[7] = not letters and 10 <= n <= 12
    f[8] = not letters and 13 <= n <= 19
    f[9] = n > 19
    f[10] = not letters and 13 <= n <= 19 and luhn(digits)
    groups = re.findall(r"[0-9]+", s) if n else []
    seps = set(re.findall(r"[^0-9]+", s)) if n and not letters else set()
    f[11] = len(groups) >= 3 and all(len(g) == 4 for g in groups[:-1]) and len(seps) == 1
    f[12] = len(seps) > 1
    f[13] = f[10] and (f[11] or [len(g) for g in groups] == [4, 6, 5] or len(groups) == 1)
    f[14] = bool(NATIONAL.fullmatch(s))
    f[15] = bool(TRUNK.fullmatch(s)) and 8 <= n <= 13
    f[16] = bool(INTERNATIONAL.fullmatch(s)) and 10 <= n <= 16
    f[17] = bool(re.fullmatch(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}.*", s))
    f[18] = len(groups) == 1 and not letters
    for k, c in enumerate(CONTEXT):
        f[19 + k] = bool(c.search(before))
    near = text[max(0, start - 2) : start] + " " + text[end : end + 2]
    f[23] = bool(re.search(r"[0-9@]|[-/._][0-9]|\w$", text[max(0, start - 2) : start])) and bool(re.search(r"\S$", text[max(0, start - 1) : start])) or bool(re.match(r"[-/._]?[0-9]|[@\w]", text[end : end + 2]))
    f[24] = bool(re.search(r"[#$€£%]", near))
    f[25] = bool(re.search(r"\s{2}|\n", s))
    return f


def segments(text: str, tokens: list[tuple[int, int]], walls: list[Span] = ()) -> list[tuple[int, int, np.ndarray]]:
    """Candidate segments (first token, token after the last, features)."""
    out = []
    for i, (start, _) in enumerate(tokens):
        c = text[start]
        if not (c.isalnum() or c == "(" or c == "+"):
            continue
        back = next((text[a:b] for a, b in reversed(tokens[max(0, i - 3) : i]) if text[a].isalpha()), "")
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            end = tokens[j - 1][1]
            if not text[end - 1].isalnum() or any(a < end and start < b for a, _, b in walls):
                continue
            f = features(text, start, end, back)
            if f is not None:
                out.append((i, j, f))
    return out


def _generated(seed: int = 5, n: int = 350) -> list[tuple[str, list[tuple[int, int, int]]]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "the", "er", "ion", "st", "ou", "re", "il", "mo", "ka")) for _ in range(r.randint(1, 3)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice((".", "_", "  ", " - ", "/"))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("{at}", "{dot}"), ("@", " dot "), ("@", "[.]")))
        host = word() + (dot + word() if r.random() < 0.3 else "")
        return f"{word()}{r.choice(('', '.' + word(), num(2)))}{at}{host}{dot}{r.choice(('com', 'org', 'net', 'de', 'es', 'fr'))}"

    def phone() -> str:
        a = r.choice("23456789") + num(2)
        return r.choice((f"({a}) {num(3)}-{num(4)}", f"{a}-{num(3)}-{num(4)}", f"{a}.{num(3)}.{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(7)}", f"0049 {num(2)} {num(7)}", f"00{r.randint(30, 49)} {num(3)} {num(3)} {num(4)}"))

    def ip() -> str:
        sep = r.choice(("[.]", "(.)", "[dot]", " [.] "))
        return sep.join(str(r.randint(0, 255)) for _ in range(4))

    def decoy() -> str:
        return r.choice((
            f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}", f"{num(16)}", f"#{num(9)}", f"{num(4)}-{num(4)}-{num(4)}-{num(5)}", f"$ {num(3)} {num(3)} {num(3)}",
            f"v{num(1)}.{num(2)}.{num(3)}.{num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"look at {word()}", f"a dot on {word()}", f"meet at the dot {word()}", f"{num(8)}", f"{num(3)}, {num(3)}, {num(3)}", f"{num(2)}/{num(2)}/{num(4)} {num(6)}", f"{num(12)}", f"{num(24)}",
        ))

    made = (email, ip, card, phone)
    lead = (("mail", "contact", ""), ("host", "ip", ""), ("card", "visa", ""), ("call", "tel", "phone", ""))
    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(1, 4))), []
        for _ in range(r.randint(0, 2)):
            k = r.randrange(4)
            text += " " + r.choice(lead[k])
            text = text.rstrip() + r.choice((" ", ": "))
            x = made[k]()
            gold.append((len(text), k, len(text) + len(x)))
            text += x + r.choice((" ", ". ", ", ", "\n")) + word()
        if r.random() < 0.8:
            text += r.choice((" ", ", ")) + r.choice(("", "order ", "on ", "id ")) + decoy() + " " + word()
        out.append((text, gold))
    return out


@functools.lru_cache(1)
def train(rounds: int = 70, rate: float = 1.0, ridge: float = 2e-4) -> tuple[tuple[float, ...], ...]:
    """Weights, kinds x features."""
    data = []
    for text, gold in _generated():
        tokens = [m.span() for m in TOKEN.finditer(text)]
        kept = [(a, k, b) for a, k, b in gold if not any(x < b and a < y for x, _, y in base_spans(text))]
        segs = segments(text, tokens, base_spans(text))
        if not segs:
            continue
        want = {(a, b): k for a, k, b in kept}
        y = np.array([want.get((tokens[i][0], tokens[j - 1][1]), -1) for i, j, _ in segs])
        data.append((len(tokens), [(i, j) for i, j, _ in segs], np.array([f for *_, f in segs]), y))
    w, speed = np.zeros((4, N_FEATURES)), np.zeros((4, N_FEATURES))
    w[:, 0] = -2
    for step in range(rounds):
        grad = np.zeros_like(w)
        for n, spans, f, y in data:
            score = np.exp(np.clip(f @ w.T, -30, 30))
            total = score.sum(axis=1)
            ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for q, (i, j) in enumerate(spans):
                ends[j].append((i, q))
                starts[i].append((j, q))
            fw = [1.0] * (n + 1)
            for j in range(1, n + 1):
                fw[j] = fw[j - 1] + sum(fw[i] * total[q] for i, q in ends[j])
            bw = [1.0] * (n + 1)
            for i in range(n - 1, -1, -1):
                bw[i] = bw[i + 1] + sum(bw[j] * total[q] for j, q in starts[i])
            p = np.array([fw[i] * bw[j] for i, j in spans])[:, None] * score / fw[n]
            for k in range(4):
                grad[k] += f[y == k].sum(axis=0) - p[:, k] @ f
        grad = grad / len(data) - ridge * w
        speed = 0.9 * speed + grad
        w += rate * speed
    return tuple(map(tuple, w))


def decode(text: str, zone: tuple[int, int], walls: list[Span], w: np.ndarray) -> list[Span]:
    tokens = [m.span() for m in TOKEN.finditer(text, *zone)]
    segs = segments(text, tokens, walls)
    if not segs:
        return []
    scores = np.array([f for *_, f in segs]) @ w.T
    ends: dict[int, list[tuple[int, int]]] = {}
    for q, (i, j, _) in enumerate(segs):
        ends.setdefault(j, []).append((i, q))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, q in ends.get(j, ()):
            k = int(scores[q].argmax())
            if best[i] + scores[q, k] > best[j]:
                best[j], back[j] = best[i] + scores[q, k], (i, k)
    out, j = [], len(tokens)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((tokens[i][0], k, tokens[j - 1][1]))
            j = i
    return out[::-1]


def least_at(w: np.ndarray) -> float:
    """The highest score that a segment with a plain "at" but neither a spelled address nor a "dot" can have."""
    free = [9, 17, *range(19, N_FEATURES)]
    return float((w[:, 0] + w[:, 3] + np.maximum(w[:, free], 0).sum(axis=1)).max())


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Ranges to decode, with room for a segment's other parts and the words before it; they break between tokens."""
    now = None
    found = [m.span() for m in SIGN.finditer(text)] + [m.span() for m in STRETCH.finditer(text) if len(DIGITS.findall(m[0])) >= 7]
    for start, end in sorted(found):
        a, b = _before(text, start), _after(text, end)
        if now and a <= now[1]:
            now = now[0], max(now[1], b)
        else:
            if now:
                yield now
            now = a, b
    if now:
        yield now


def _before(text: str, at: int) -> int:
    """The start of the token LONGEST + 3 tokens before the position."""
    reach = 64
    while True:
        low = max(0, at - reach)
        tokens = [m.start() for m in TOKEN.finditer(text, low, at)]
        if low == 0 or len(tokens) > LONGEST + 3:  # the first may be part of a token
            return tokens[-LONGEST - 3] if len(tokens) > LONGEST + 3 else 0
        reach *= 2


def _after(text: str, at: int) -> int:
    end = at
    for k, m in enumerate(TOKEN.finditer(text, at)):
        end = m.end()
        if k == LONGEST:
            break
    return end


def find(text: str | None, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    for zone in zones(text):
        added += decode(text, zone, [s for s in base if s[0] < zone[1] and zone[0] < s[2]], w)
    return base, sorted(base + added)


def label(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    arrow_bounds(docs.sparkSession)
    weights = np.array(train())
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sha, every = [], [], []
            for text in b.column(1).to_pylist():
                base, spans = find(text, weights)
                counts.append([sum(k == x for _, x, _ in base) for k in range(4)])
                sha.append(hashlib.sha256(label(base).encode()).hexdigest())
                every.append(label(spans))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(n[:, k]) for k in range(4)], pa.array(sha, pa.string()), pa.array(every, pa.string())], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return own.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string").withColumnRenamed("id", id_col)
