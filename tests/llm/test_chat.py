from __future__ import annotations

import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import chat
from tests.agree import assert_agree

NASTY = st.text(alphabet="<|\\>im_endstar\n é𝒳日", max_size=30)
MODEL = Tokenizer.from_file(chat.TOKENIZER)
MODEL.encode_special_tokens = True


def encode(s):
    return MODEL.encode(s, add_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "a\\n", "<|im_end|>", ""]), NASTY), max_size=5))
def test_round_trip_and_mask(turns):
    for piece in (1 << 20, 40):
        out = chat.format_conversation(turns, encode, piece)
        assert chat.parse(out["text"]) == turns
        assert out["learned"] == "".join(t for r, t in turns if r == "assistant")
        assert len(out["ids"]) == len(out["loss"])
        assert out["ids"] == encode(out["text"]).ids  # pieces give the tokens of the whole
        assert out["text"].count(chat.START) == out["text"].count(chat.END) == len(turns)


def test_mask_equals_a_character_mask():
    turns = [("user", "hello there"), ("assistant", "général kenobi 日本"), ("assistant", ""), ("user", "bye"), ("assistant", "ok<|im_end|>")]
    out = chat.format_conversation(turns, encode)
    text, spans = chat.render(turns)
    inside = [False] * len(text)
    for a, b, role in spans:
        if role == "assistant":
            inside[a:b] = [True] * (b - a)
    offsets = encode(text).offsets
    assert out["loss"] == [int(any(inside[a:b])) for a, b in offsets]


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_start|>"), (1, 1, "assistant", "yo <|im_start|>"), (2, 0, None, None), (2, None, "assistant", "early"), (None, 0, "user", "lost"), (None, 1, "assistant", None),
    (3, 0, "assistant", "long " * 60_000), (4, 0, "user", ""), (-1, 5, "user", "same id as the probe"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, formatted string")


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    got = chat.format_conversations(chat.with_probe(frame(spark, ROWS)), full=False).drop("n_tokens", "n_loss_tokens")
    assert_agree(got, con, chat.ORACLE_SQL)


def test_full_output(spark):
    got = {r.conv_id: r for r in chat.format_conversations(frame(spark, ROWS)).collect()}
    assert len(got) == 6
    assert got[1].formatted == "<|im_start|>user\nhi<|im_end|>\n" + "<|im_start|>assistant\nyo <\\|im_start|><|im_end|>\n" * 2
    assert got[1].loss_chars == 30 and got[1].loss_sha256 == hashlib.sha256(("yo <|im_start|>" * 2).encode()).hexdigest()
    assert len(got[3].token_ids) == len(got[3].loss_mask) == got[3].n_tokens and sum(got[3].loss_mask) == got[3].n_loss_tokens
    assert chat.format_conversations(frame(spark, [])).count() == 0
