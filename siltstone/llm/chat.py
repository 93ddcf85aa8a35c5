"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole with a template that marks turns, encoded once with
character offsets, and the mask is the intersection of the sorted spans of the assistant's
texts with the sorted token spans, found by binary search. A token that straddles the edge
of a turn is in the mask only with its part inside.

Template: `<|im_start|>` role newline text `<|im_end|>` newline, for every turn. Control
strings inside texts are escaped reversibly: in every run `<`, backslashes, `|` one more
backslash is put before the bar, so `<|` occurs in the template's own marks only. In roles
backslashes and newlines are escaped too, as the header ends at its newline.

Rows come sorted by conversation and turn out of one shuffle and are streamed; a task holds
one conversation at a time. Of a conversation longer than `piece` characters no more than
that is encoded at a time: pieces end between a turn's last newline and the next turn's
mark, where the tokenizer's own first step always splits (a lone newline, then a sign), so
the tokens are those of the whole.

Defined results: null text and null role count as empty; rows of a null conversation form
one conversation; turns are ordered by turn (null first), then role, then text, so ties
and repeated rows are all kept in a fixed order; an empty table gives an empty result.
Only the four named columns are looked at. The tokenizer's path is a parameter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import arrow_bounds

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, END = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted conversation and the span of each text in it with its role."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        out += [head, body, END, "\n"]
        at = spans[-1][1] + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[Turn]:
    """The turns, read back."""
    turns, at = [], 0
    while at < len(formatted):
        head = at + len(START)
        line = formatted.index("\n", head)
        end = formatted.index(END, line + 1)
        turns.append((unescape_role(formatted[head:line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def mask(spans: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, start, end) for each overlap of a sorted span with the sorted tokens.

    Byte-level tokens of one character share its offsets; such a character counts once, at
    its first token, but all its tokens are reported (later ones with an empty part)."""
    begins, ends, out = [a for a, _ in tokens], [b for _, b in tokens], []
    for a, b in spans:
        done = a
        for k in range(bisect_right(ends, a), bisect_left(begins, b)):
            lo, hi = max(done, tokens[k][0]), min(b, tokens[k][1])
            out.append((k, min(lo, hi), hi))
            done = max(done, hi)
    return out


def format_conversation(turns: list[Turn], encode, piece: int = 1 << 20) -> dict:
    """formatted text, token ids, loss mask per token, text under the mask."""
    text, spans = render(turns)
    cuts, last = [0], 0
    for _, end, _ in spans:
        if end + len(END) + 1 - last >= piece:
            cuts.append(last := end + len(END) + 1)
    if cuts[-1] != len(text):
        cuts.append(len(text))
    ids, tokens = [], []
    for a, b in zip(cuts, cuts[1:]):
        e = encode(text[a:b])
        ids += e.ids
        tokens += [(x + a, y + a) for x, y in e.offsets] if a else e.offsets
    hits = mask([(a, b) for a, b, role in spans if role == "assistant"], tokens)
    loss = [0] * len(ids)
    for k, *_ in hits:
        loss[k] = 1
    # escapes are undone turn by turn: a part may end inside one
    learned = []
    at = 0
    for a, b, role in spans:
        if role == "assistant":
            part = []
            while at < len(hits) and hits[at][1] < b or at < len(hits) and hits[at][2] <= b:
                part.append(text[hits[at][1] : hits[at][2]])
                at += 1
            learned.append(unescape("".join(part)))
    return {"text": text, "ids": ids, "loss": loss, "learned": "".join(learned)}


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = TOKENIZER, full: bool = True) -> DataFrame:
    """One row per conversation: its id, n_turns, formatted, token_ids, loss_mask and the
    digests read back from the output. full=False leaves out the three large columns."""
    arrow_bounds(rows.sparkSession)
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["conv"].dataType.simpleString()
    sorted_rows = own.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    large = "formatted string, token_ids array<int>, loss_mask array<int>, " if full else ""
    schema = f"conv {kind}, {large}n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def done(turns: list[Turn], encode) -> tuple:
        out = format_conversation(turns, encode)
        back, sha = parse(out["text"]), hashlib.sha256()
        for r, t in back:
            sha.update(f"{r}\n{t}\n".encode())
        learned = out["learned"]
        tail = (len(back), sha.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(out["text"]), len(out["ids"]), sum(out["loss"]))
        return (out["text"], out["ids"], out["loss"], *tail) if full else tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        encode = lambda s: model.encode(s, add_special_tokens=False)
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] * full + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["conv", *["formatted", "token_ids", "loss_mask"] * full, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
        now, turns, keys, made = None, [], [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, key_type), *[pa.array(x, t) for x, t in zip(zip(*made), kinds)]], names=names)
            keys.clear()
            made.clear()
            return out

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            for key, r, t in zip(*[c.to_pylist() for c in b.columns]):
                if turns and key != now:
                    keys.append(now)
                    made.append(done(turns, encode))
                    turns = []
                    if len(made) >= 200:
                        yield batch()
                now = key
                turns.append((r, t))
        if turns:
            keys.append(now)
            made.append(done(turns, encode))
        if made:
            yield batch()

    return sorted_rows.mapInArrow(run, schema).withColumnRenamed("conv", conv)


PROBE = f"{END}{START}assistant ok"


def with_probe(rows: DataFrame) -> DataFrame:
    """conversations plus conversation -1, whose texts imitate the template."""
    spark = rows.sparkSession
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, len(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
        + len(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
        + {len(START) + len(END) + 2} AS width FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(width)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
