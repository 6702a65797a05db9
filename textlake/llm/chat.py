"""Conversations as token ids with a mask for training.

A turn is <|im_start|>, the ids of its role and a line break, the ids of its content, <|im_end|> and
the ids of a line break. Segments are encoded by themselves as ordinary text and the reserved ids,
which lie beyond the vocabulary, are spliced in between, so no content can produce one. Should a
content spell a control string, a backslash is put into it, so that the text of the whole chat can
be parsed as well. The mask is 1 where the model is to learn: on the content and the end of every
assistant turn; it is the running sum of +1 and -1 at the ends of those stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm import bpe
from textlake.llm.common import int_lists, take_ranges, text_or_empty

START, END, BEGIN = "<|im_start|>", "<|im_end|>", "<|begin|>"
CONTROL = (BEGIN, START, END)
_NAMES = "|".join(re.escape(c[2:-2]) for c in CONTROL)
_PLAIN, _ESCAPED = rf"<(\\*)\|({_NAMES})\|>", rf"<\\(\\*)\|({_NAMES})\|>"


def reserved(v: bpe.Vocabulary, taken: int = 1) -> dict[str, int]:
    """The ids of the control strings, after the vocabulary and the taken ids behind it."""
    return {c: v.size + taken + k for k, c in enumerate(CONTROL)}


def escape(text: str) -> str:
    r"""text with one backslash more in each control string: <|im_end|> becomes <\|im_end|>."""
    return re.sub(_PLAIN, r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    """The text that escape was given."""
    return re.sub(_ESCAPED, r"<\1|\2|>", text)


def _escaped(col: pa.Array) -> pa.Array:
    if not pc.any(pc.match_substring(col, "|>")).as_py():
        return col
    return pc.replace_substring_regex(col, _PLAIN, r"<\\\1|\2|>")


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray, v: bpe.Vocabulary, learn: str = "assistant") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, mask, offsets of the chats) of chats that have turns[i] turns each."""
    special = reserved(v)
    line = np.array(v.encoder.encode_ordinary("\n"), np.int32)
    head, hoff = bpe.encode(pc.binary_join_element_wise(_escaped(roles), pa.scalar("\n", roles.type), pa.scalar("", roles.type)), v)
    body, boff = bpe.encode(_escaped(texts), v)
    h, b = np.diff(hoff), np.diff(boff)
    size = 2 + h + b + len(line)
    chat = np.repeat(np.arange(len(turns)), turns)
    total = np.concatenate([[0], np.cumsum(np.bincount(chat, weights=size, minlength=len(turns)).astype(np.int64) + 1)])
    at = np.cumsum(size) - size + chat + 1  # every chat opens with one id
    ids = np.empty(total[-1], np.int32)
    ids[total[:-1]] = special[BEGIN]
    ids[at] = special[START]
    ids[take_ranges(at + 1, h)] = head
    ids[take_ranges(at + 1 + h, b)] = body
    ids[at + 1 + h + b] = special[END]
    for k, x in enumerate(line):
        ids[at + 2 + h + b + k] = x
    step = np.zeros(total[-1] + 1, np.int8)
    own = np.asarray(pc.equal(roles, learn))
    step[(at + 1 + h)[own]] = 1
    step[(at + 2 + h + b)[own]] = -1
    return ids, np.cumsum(step[:-1], dtype=np.int8), total


def format_chats(turns: DataFrame, learn: str = "assistant", ranks: str = bpe.RANKS) -> DataFrame:
    """conv_id, n_turns, n_tokens, n_learned, ids, mask: one row for each conversation, whole.

    Turns are ordered by turn, then role and text; a null turn comes first. A null text is empty, a
    null role is "". Rows with a null conv_id are left out, as they belong to no conversation. Turns
    that share a number, repeated rows among them, all stay. Conversations of any length are one row.
    Other columns, whatever their names, play no part; an empty table gives no rows. ranks must be
    readable at the same path on every worker.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("t"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    chats = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("x"))
    chats = chats.select("conv_id", F.col("x.role").alias("role"), F.col("x.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(ranks)
        for whole in batches:
            for lo in range(0, len(whole), 500):
                b = whole.slice(lo, 500)
                n = np.asarray(pc.list_value_length(b.column("role")), np.int64)
                flat = [pc.list_flatten(b.column(c)).cast(pa.large_string()) for c in ("role", "text")]
                ids, mask, off = assemble(*flat, n, v, learn)
                learned = np.add.reduceat(mask.astype(np.int64), off[:-1])
                yield pa.record_batch(
                    [b.column("conv_id"), pa.array(n, pa.int32()), pa.array(np.diff(off), pa.int32()), pa.array(learned, pa.int32()), int_lists(ids, off, pa.int32()), int_lists(mask, off, pa.int8())], ["conv_id", "n_turns", "n_tokens", "n_learned", "ids", "mask"]
                )

    return chats.mapInArrow(run, "conv_id bigint, n_turns int, n_tokens int, n_learned int, ids array<int>, mask array<tinyint>")


def render(ids: list[int], v: bpe.Vocabulary) -> str:
    """The text of a chat's ids, control strings spelt out."""
    names = {i: c for c, i in reserved(v).items()}
    out, held = [], []
    for i in [*ids, None]:
        if i is None or i in names:
            out.append(bpe.decode(np.array(held, np.int64), v).decode(errors="replace"))
            out.append(names.get(i, ""))
            held = []
        else:
            held.append(i)
    return "".join(out)
