"""Byte-level BPE ids of many texts at once.

Texts are cut before spaces that follow a letter, digit or sign, where no token reaches across; each
distinct unit of a batch is encoded once, all of them in one call of the library.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken

from textlake.llm.common import TOKENIZER_DIR, flat_utf8, string_array, take_ranges

RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """A rank file, its encoder, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("textlake", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        spelt = [b""] * self.size
        for s, i in ranks.items():
            spelt[i] = s
        self.length = np.array([len(s) for s in spelt], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.raw = np.frombuffer(b"".join(spelt), np.uint8)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once in each process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _solid(raw: np.ndarray) -> np.ndarray:
    """Whether each byte ends a character that is surely no white space."""
    one = (raw > 32) & (raw < 127)
    two, three = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    follows = raw & 0xC0 == 0x80
    two[1:] = follows[1:] & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)
    three[2:] = follows[2:] & follows[1:-1] & (((raw[:-2] >= 0xE4) & (raw[:-2] < 0xF0)) | (raw[:-2] == 0xE0))
    return one | two | three


def encode(col: pa.Array | pa.ChunkedArray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the texts' offsets; null and empty texts have none."""
    raw, off = flat_utf8(col)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    solid = _solid(raw)
    cut_at = np.zeros(len(raw), bool)
    cut_at[1:] = (raw[1:] == 32) & solid[:-1]
    cut_at[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero(cut_at)
    coded = string_array(raw, np.append(at, len(raw))).dictionary_encode()
    seq = np.asarray(coded.indices)
    flat, uoff = flat_utf8(coded.dictionary)
    # between units that open with a space and end solid nothing joins: they are encoded as one text
    joined = (flat[uoff[:-1]] == 32) & _solid(flat)[uoff[1:] - 1]
    alone = np.flatnonzero(~joined)
    own = [v.encoder.encode_ordinary(s) for s in coded.dictionary.take(pa.array(alone)).to_pylist()]
    size = np.diff(uoff)
    chosen = np.flatnonzero(joined)
    text = flat[take_ranges(uoff[:-1][chosen], size[chosen])].tobytes().decode()
    together = np.array(v.encoder.encode_ordinary(text), np.int32)
    ends = np.searchsorted(np.cumsum(v.length[together]), np.cumsum(size[chosen]), "left") + 1
    n = np.zeros(len(uoff) - 1, np.int64)
    n[chosen] = np.diff(np.append(0, ends))
    n[alone] = [len(x) for x in own]
    first = np.zeros(len(n), np.int64)
    first[chosen] = np.append(0, ends[:-1]) if len(chosen) else 0
    first[alone] = len(together) + np.cumsum(n[alone]) - n[alone]
    ids = np.concatenate([together, np.array([i for x in own for i in x], np.int32)])
    per = n[seq]
    total = np.concatenate([[0], np.cumsum(per)])
    return ids[take_ranges(first[seq], per)], total[np.searchsorted(at, off)]


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The bytes the ids spell; ids beyond the vocabulary spell nothing."""
    known = np.asarray(ids, np.int64)
    known = known[(known >= 0) & (known < v.size)]
    return v.raw[take_ranges(v.at[known], v.length[known])].tobytes()
