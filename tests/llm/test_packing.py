import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from textlake.llm import bpe, packing

from .cases import empty, odd, odd_rows, rows

V = bpe.vocabulary(bpe.RANKS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab1 é\n\t 　'sЯ क.▁", max_size=14), max_size=6))
def test_ids_are_the_librarys(texts):
    ids, off = bpe.encode(pa.array([*texts, None]), V)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [V.encoder.encode_ordinary(t) for t in [*texts, ""]]
    assert bpe.decode(ids, V).decode() == "".join(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60))
def test_best_fit_decreasing_is_the_plain_one(lengths):
    n = np.array(lengths, np.int64)
    row, offset = packing.best_fit_decreasing(n, 37)
    room: list[int] = []
    for k in np.argsort(-n, kind="stable"):
        fits = [(r, i) for i, r in enumerate(room) if r >= n[k]]
        if fits:
            room[min(fits)[1]] -= n[k]
        else:
            room.append(37 - n[k])
    used = np.bincount(row, weights=n, minlength=len(room)) if len(n) else np.zeros(0)
    assert sorted(37 - used) == sorted(room)
    for r in set(row.tolist()):  # no two segments overlap
        spans = sorted((o, o + k) for o, k in zip(offset[row == r], n[row == r]))
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 37


def unpacked(found, length):
    parts = []
    for r in found:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == packing.EOT).all() and not places[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            parts.append((d, s, tuple(ids[a:b].tolist())))
    return parts


def test_nothing_is_lost(spark):
    packed = packing.pack_documents(odd(spark), length=256, docs_per_group=5).collect()
    parts = unpacked(packed, 256)
    given_ids = sorted((tuple(V.encoder.encode_ordinary(t or "")) + (packing.EOT,) for _, t, *_ in odd_rows()), key=repr)
    whole, rest = [], sorted(parts, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    assert sum(len(p[2]) for p in parts) == sum(map(len, given_ids))
    for k in {p[0] for p in rest} - {2, 8, None}:  # ids on one text
        whole.append(tuple(i for p in rest if p[0] == k for i in p[2]))
    assert set(whole) <= set(given_ids)
    assert sorted(s for d, s, _ in parts if d == 5) == list(range(0, 256 * len([p for p in parts if p[0] == 5]), 256))
    assert [p[2] for p in parts if p[0] == 4] == [(packing.EOT,)] and [p[2] for p in parts if p[0] == 3] == [(packing.EOT,)]


def test_layout_and_extra_columns_play_no_part(spark):
    a = packing.pack_documents(odd(spark).repartition(1), length=128, docs_per_group=4)
    b = packing.pack_documents(odd(spark).repartition(3).withColumn("g", F.lit(7)).withColumn("ids", F.lit("x")), length=128, docs_per_group=4)
    assert rows(a) == rows(b)


def test_empty(spark):
    out = packing.pack_documents(empty(spark))
    assert out.collect() == [] and out.columns[:3] == ["pack_group", "pack_row", "n_tokens"]


def test_rows_are_full(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(["word"] * r.randint(1, 300))) for k in range(300)], "doc_id bigint, text string")
    found = packing.pack_documents(docs, length=256).collect()
    assert sum(x.n_tokens for x in found) / (256 * len(found)) > 0.97


def test_files(spark, tmp_path):
    packed = packing.pack_documents(odd(spark), length=64, docs_per_group=4)
    made = packing.write_matrices(packed, tmp_path.as_uri()).collect()
    by = {(x.pack_group, x.pack_row): x for x in packed.collect()}
    assert sum(m.rows for m in made) == len(by)
    for m in made:
        ids = np.fromfile(tmp_path / f"{m.name}.ids", "<u2").reshape(-1, 64)
        places = np.fromfile(tmp_path / f"{m.name}.positions", "<u2").reshape(-1, 64)
        cu, at = np.fromfile(tmp_path / f"{m.name}.cu", "<i4"), np.fromfile(tmp_path / f"{m.name}.cu_at", "<i8")
        for k in range(m.rows):
            x = by[m.pack_group, k]
            assert ids[k].tobytes() == x.ids and places[k].tobytes() == x.positions and cu[at[k] : at[k + 1]].tolist() == x.cu_seqlens


@pytest.mark.parametrize("length", [1, 2, 3])
def test_tiny_rows(spark, length):
    parts = unpacked(packing.pack_documents(odd(spark).where("doc_id in (6, 8)"), length=length).collect(), length)
    assert sum(len(p[2]) for p in parts) == sum(len(V.encoder.encode_ordinary(t)) + 1 for d, t, *_ in odd_rows() if d in (6, 8))


def test_hot_groups_are_packed_in_portions(spark, monkeypatch):
    data = [(1, f"text {k} " * (k % 9)) for k in range(300)] + [(None, "the same")] * 700
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    monkeypatch.setattr(packing, "PORTION", 2000)
    found = packing.pack_documents(df.repartition(3), length=64, docs_per_group=40).collect()
    keys = [(r.pack_group, r.pack_row) for r in found]
    assert len(set(keys)) == len(keys)
    for g in {g for g, _ in keys}:
        assert sorted(r for h, r in keys if h == g) == list(range(sum(h == g for h, _ in keys)))
    parts = unpacked(found, 64)
    assert sum(p[0] is None for p in parts) == 700
    assert sum(len(p[2]) for p in parts) == sum(len(V.encoder.encode_ordinary(t)) + 1 for _, t in data)
    assert len({r.pack_group for r in found if 1 in r.doc_ids}) > 5  # one id fills many groups
    assert rows(packing.pack_documents(df.coalesce(1), length=64, docs_per_group=40)) == sorted(map(tuple, found), key=repr)


def test_portions_do_not_follow_the_batches(monkeypatch):
    monkeypatch.setattr(packing, "PORTION", 100)
    r = random.Random(1)
    whole = pa.record_batch([pa.array(sorted(r.randrange(4) for _ in range(200)), pa.int32()), pa.array(["x" * r.randrange(30) for _ in range(200)])], ["g", "text"])
    cut = lambda n: [whole.slice(a, n) for a in range(0, 200, n)]
    by = {n: [p for b in packing._portioned(iter(cut(n)), 50) for p in b.column("portion").to_pylist()] for n in (1, 7, 64, 200)}
    assert by[1] == by[7] == by[64] == by[200] and max(by[1]) > 5
