import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from textlake.llm import sentencepiece_sa as sa

from .cases import empty, odd, odd_rows, prose

SP = sentencepiece.SentencePieceProcessor(model_file=sa.MODEL)


def check(texts):
    p = sa.pieces(sa.MODEL)
    ids, off = sa.encode(pa.array(texts, pa.string()), p)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == SP.encode([t or "" for t in texts])
    assert sa.decode(ids, off, p).to_pylist() == [(t or "").replace("▁", " ") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab thé\n\tЯक▁ß.1\U0001f600", max_size=20), max_size=5))
def test_as_the_library(texts):
    check([*texts, None, ""])


def test_long_runs():
    r = random.Random(3)
    check(["a" * 3000, "ab" * 700, "".join(r.choice("etaoin") for _ in range(4000)), " " * 500, prose(1, 5000)])


@pytest.mark.parametrize("chunk", [1, 50, 5000])
def test_cuts_between_suffix_arrays(monkeypatch, chunk):
    monkeypatch.setattr(sa, "_CHUNK", chunk)
    monkeypatch.setattr(sa, "_DECODE", chunk)
    check([prose(k, 60) for k in range(5)])


def test_documents(spark):
    df = odd(spark).selectExpr("*", "'x' AS ids", "1 AS n_pieces", "2 AS decoded")
    out = sa.encode_documents(df).collect()
    expected = [(d, len(i), i, (t or "").replace("▁", " ")) for (d, t, *_), i in zip(odd_rows(), SP.encode([r[1] or "" for r in odd_rows()]))]
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
    assert sa.encode_documents(empty(spark)).collect() == []


def test_decoding(spark):
    df = spark.createDataFrame([(1, SP.encode("a b")), (2, []), (3, None), (4, [None, 5_000_000, -1, 1, 2]), (5, [SP.unk_id()]), (None, SP.encode("é"))], "doc_id bigint, ids array<int>")
    found = {r.doc_id: r.text for r in sa.decode_documents(df).collect()}
    assert found == {1: "a b", 2: "", 3: "", 4: "", 5: "⁇ ", None: "é"} or found[5].strip() == "⁇"
    assert sa.decode_documents(df.limit(0)).collect() == []


def test_bytes_that_are_no_text(spark):
    p = sa.pieces(sa.MODEL)
    df = spark.createDataFrame([(1, [int(p.byte[0xFF]), int(p.byte[0x41])])], "doc_id bigint, ids array<int>")
    assert sa.decode_documents(df).first().text == "�A"


def test_matches_are_all_occurrences():
    import numpy as np

    p = sa.pieces(sa.MODEL)
    text = "▁the▁theatre▁then▁é"
    edges = sa.suffix_matches(np.array([ord(c) for c in text], np.uint32), p)
    assert (np.diff(edges.first) >= 0).all() and edges.first[-1] == len(edges.which) - 1
    known = {SP.id_to_piece(int(i)): k for k, i in enumerate(p.ids)}
    for a in range(len(text)):
        for n in range(1, p.depth + 1):
            piece = text[a : a + n]
            assert edges.find(np.array([a]), np.array([n]))[0] == (known.get(piece, -1) if a + n <= len(text) else -1)


@pytest.mark.parametrize("depth", [3, 16, 63, 64, 200])
def test_edges_are_found(depth):
    import numpy as np

    r = np.random.default_rng(depth)
    spots = sorted({(int(a), int(n)) for a, n in zip(r.integers(0, 50, 900), r.integers(1, depth + 1, 900))})
    shuffled = r.permutation(len(spots))
    a, n = np.array(spots)[shuffled].T
    edges = sa.Edges(a, n, shuffled.astype(np.int32), 50, depth)
    assert edges.which[:-1].tolist() == list(range(len(spots)))  # sorted by position and length
    every = [(i, k) for i in range(50) for k in range(depth + 1)]
    known = {x: k for k, x in enumerate(spots)}
    i, k = np.array(every).T
    assert edges.find(i, k).tolist() == [known.get(x, -1) for x in every]


@pytest.mark.parametrize("characters", [0, 40, 1 << 20])
def test_known_units_have_the_same_ids(characters):
    p = sa.pieces(sa.MODEL)
    known = sa.Known(p, characters)
    for texts in (["the theatre", None, "a  b"], ["", "the new theatre ▁ 😀", "the"], [], [prose(1, 300)], [prose(1, 300), prose(2, 300)]):
        ids, off = sa.encode(pa.array(texts, pa.string()), p, known)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == SP.encode([t or "" for t in texts])
    assert sum(map(len, known.units.to_pylist())) <= characters
