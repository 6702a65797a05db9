"""Token ids packed into matrices of fixed width.

Documents are dealt to groups by hash. Within a group texts are encoded, those longer than a row are
split without loss, and the segments are packed best fit decreasing: each, the longest first, goes
into the row with the least room that still holds it, which a segment tree over the possible amounts
of room finds in logarithmic time. A group is one block of rows; groups hold as many documents as
docs_per_group on average at any size of the table, so one shuffle of the texts is all that moves.
A group that is much larger, as repeated rows share one, is packed portion by portion.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.arrow import runs_of
from textlake.llm import bpe
from textlake.llm.common import hash_u63, int_lists, slices, take_ranges, text_or_empty

LENGTH, EOT = 2048, 50256
PORTION = 64_000_000  # bytes of a group's texts packed at once
SCHEMA = "pack_group int, pack_row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<int>"


class Room:
    """Rows by the room left in them: a segment tree over 0..capacity says which amounts occur."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.has = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        k = self.base + room
        while k and not self.has[k]:
            self.has[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of a row with the least room of at least need; it is taken out."""
        k, has = self.base + need, self.has
        if not has[k]:
            while k > 1 and (k & 1 or not has[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if has[2 * k] else 2 * k + 1
        room = k - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            has[k] = 0
            k >>= 1
            while k and not (has[2 * k] or has[2 * k + 1]):
                has[k] = 0
                k >>= 1
        return row, room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of each length, which are 1 to capacity; equal lengths in the given order."""
    row, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths == capacity)
    row[full] = np.arange(len(full))
    rows = len(full)
    room = Room(capacity)
    order = np.argsort(-lengths, kind="stable")[len(full) :]
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        found = room.take(n)
        if found is None:
            found = rows, capacity
            rows += 1
        row[k], offset[k] = found[0], capacity - found[1]
        if found[1] > n:
            room.put(found[0], found[1] - n)
    return row, offset


def _portioned(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by g, with the portion of its group that each row falls in: PORTION bytes, to
    which every row adds as much more as limits a portion to docs rows. Batch borders play no part."""
    now, done = None, 0
    for b in batches:
        if not len(b):
            continue
        g = np.asarray(b.column("g"))
        w = np.asarray(pc.binary_length(b.column("text")), np.int64) + -(-PORTION // docs)
        total = np.cumsum(w) - w
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(start, len(g)))
        before = total - np.repeat(total[start], size)
        if g[0] == now:
            before[: size[0]] += done
        now, done = g[-1], int(before[-1] + w[-1])
        yield b.append_column("portion", pa.array(before // PORTION))


def _pack(group: int, first_row: int, doc: pa.Array, ids: np.ndarray, off: np.ndarray, length: int, eot: int, kind: np.dtype) -> pa.RecordBatch:
    n = np.diff(off)
    parts = -(-n // length)
    of = np.repeat(np.arange(len(n)), parts)
    start = take_ranges(np.zeros(len(n), np.int64), parts) * length
    size = np.minimum(length, n[of] - start)
    row, offset = best_fit_decreasing(size, length)
    order = np.lexsort((offset, row))
    of, start, size, row, offset = of[order], start[order], size[order], row[order], offset[order]
    rows = int(row[-1]) + 1 if len(row) else 0
    matrix, places = np.full(rows * length, eot, kind), np.zeros(rows * length, np.uint32 if length > 65536 else np.uint16)
    step = max(1, 4_000_000 // length)
    first = np.searchsorted(row, np.arange(rows + 1))
    for a in range(0, rows, step):  # a few rows at a time bound the indices' memory
        s = slice(first[a], first[min(rows, a + step)])
        to = take_ranges(row[s] * length + offset[s], size[s])
        matrix[to] = ids[take_ranges(off[of[s]] + start[s], size[s])]
        places[to] = take_ranges(np.zeros(s.stop - s.start, np.int64), size[s])
    used = np.add.reduceat(size, first[:-1]) if rows else np.zeros(0, np.int64)
    ends = np.insert(offset + size, first[:-1], 0)  # every row's cumulative lengths open with 0
    binary = lambda m: pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int64) * length * m.itemsize), pa.py_buffer(m)])
    return pa.record_batch(
        [pa.array(np.full(rows, group), pa.int32()), pa.array(first_row + np.arange(rows), pa.int32()), pa.array(used, pa.int32()), binary(matrix), binary(places), int_lists(ends, first + np.arange(rows + 1), pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), doc.take(pa.array(of))), int_lists(start, first, pa.int32())],
        ["pack_group", "pack_row", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts"],
    )


def pack_documents(docs: DataFrame, length: int = LENGTH, eot: int = EOT, docs_per_group: int = 4096, ranks: str = bpe.RANKS, seed: int = 3) -> DataFrame:
    """One row for each row of the packed matrices.

    ids is the matrix row, little-endian uint16 (uint32 if the vocabulary needs it), filled up with
    eot; every text is followed by one eot, so that concatenating a document's segments in the order
    of starts gives all its ids. positions has each place's position within its segment (0 again at
    every segment, and in the filling), cu_seqlens the cumulative lengths from 0 to n_tokens, doc_ids
    and starts each segment's document and place in it. Null and empty texts are a lone eot, so that
    none is lost; null doc_ids and repeated rows are packed like others, each on its own. Ties in
    length go by doc_id and text. Extra columns play no part. An empty table gives no rows. Rows go to
    groups by doc_id and text, so an id on very many texts fills many groups. The result does not
    depend on how docs is partitioned. ranks must be readable on every worker. doc_id is cast to bigint.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("g", F.pmod(hash_u63("doc_id", "text", seed=seed), F.lit(groups)).cast("int"))
    rows = rows.repartition("g").sortWithinPartitions("g", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(ranks)
        kind = np.dtype("<u2" if max(v.size, eot + 1) <= 65536 else "<u4")
        group, row = None, 0
        for b in runs_of(_portioned(batches, 4 * docs_per_group), ["g", "portion"]):
            ids, sizes = [], []
            for part in slices(b, size=12_000_000):
                x, off = bpe.encode(part.column("text"), v)
                whole = np.full(len(x) + len(part), eot, kind)  # one eot after each text
                whole[np.arange(len(x)) + np.repeat(np.arange(len(part)), np.diff(off))] = x
                ids.append(whole), sizes.append(np.diff(off) + 1)
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            this = b.column("g")[0].as_py()
            row = row if this == group else 0
            out = _pack(this, row, b.column("doc_id"), np.concatenate(ids), off, length, eot, kind)
            group, row = this, row + len(out)
            for a in range(0, len(out), 1024):
                part = out.slice(a, 1024)
                yield pa.record_batch([c.cast(pa.binary()) if c.type == pa.large_binary() else c for c in part.columns], part.schema.names)

    return rows.mapInArrow(run, SCHEMA)


class _Files:
    """A group's files, written as its rows come."""

    def __init__(self, fs: pa.fs.FileSystem, root: str, group: int) -> None:
        self.fs, self.root, self.group, self.name, self.rows, self.at = fs, root, group, f"group-{group:08d}", 0, 0
        self.open = {what: fs.open_output_stream(self.path(what)) for what in ("ids", "positions", "cu", "cu_at")}
        self.open["cu_at"].write(np.zeros(1, "<i8").tobytes())

    def path(self, what: str) -> str:
        return f"{self.root}/.{self.name}.{what}.{os.getpid()}"

    def add(self, b: pa.RecordBatch) -> None:
        cu = b.column("cu_seqlens")
        ends = self.at + np.cumsum(np.asarray(pc.list_value_length(cu), np.int64))
        for what in ("ids", "positions"):
            self.open[what].write(b"".join(b.column(what).to_pylist()))
        self.open["cu"].write(np.asarray(pc.list_flatten(cu), "<i4").tobytes())
        self.open["cu_at"].write(ends.astype("<i8").tobytes())
        self.rows, self.at = self.rows + len(b), int(ends[-1])

    def done(self) -> pa.RecordBatch:
        for what, f in self.open.items():
            f.close()
            self.fs.move(self.path(what), f"{self.root}/{self.name}.{what}")
        return pa.record_batch([pa.array([self.group], pa.int32()), pa.array([self.rows], pa.int64()), pa.array([self.name])], ["pack_group", "rows", "name"])


def write_matrices(packed: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Write each group's ids, positions, cumulative lengths and their offsets as raw files in folder.

    folder is a URI that all workers reach. A file is written under another name and moved, so that
    a repeated task leaves the same whole file. Returns pack_group, rows, name (of the files). packed
    is what pack_documents gives, whole: rows in any order, each once; an empty table writes nothing
    and gives no rows, other columns play no part.
    """
    rows = packed.repartition("pack_group").sortWithinPartitions("pack_group", "pack_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        held: _Files | None = None
        for b in batches:
            g = np.asarray(b.column("pack_group"))
            for lo, hi in itertools.pairwise([*np.flatnonzero(np.append(True, g[1:] != g[:-1]))[: len(g)], len(g)]):
                if held is None or held.group != g[lo]:
                    if held is not None:
                        yield held.done()
                    held = _Files(fs, root, int(g[lo]))
                held.add(b.slice(lo, hi - lo))
        if held is not None:
            yield held.done()

    return rows.mapInArrow(run, "pack_group int, rows bigint, name string")
