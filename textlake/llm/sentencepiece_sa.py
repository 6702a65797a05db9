"""SentencePiece encoding and decoding with suffix-array matching.

A batch's texts are cut where no piece can reach across (before spaces), and the distinct units that
the task has not met before are laid end to end. A suffix array of that text is built to the depth of the longest piece; every piece
is found in it by binary search, which gives its range of occurrences. The occurrences are edges
from a position over a length; they are sorted by position and length and then relaxed.

The order of relaxation is the model's: this reads BPE models, in which the piece of the best score
that joins two current neighbours is formed first, and not the path of the best summed score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import TOKENIZER_DIR, flat_utf8, slices, spaced_units, string_array, take_ranges, text_or_empty

MODEL = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
_CHUNK = 1 << 18  # characters in one suffix array
_DECODE = 500_000  # ids decoded at once
_LONG = 64  # a run of more characters is merged with a heap
_SPACE = "▁"
_NONE = np.int64(1 << 62)


class Pieces:
    """The pieces of a model, laid out for matching."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = [sp.id_to_piece(i) for i in plain]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.full(self.size, len(order), np.int64)  # 0 is formed first
        self.rank[plain] = [order[sp.get_score(i)] for i in plain]
        self.ids = np.array(plain, np.int32)
        self.length = np.array([len(t) for t in text], np.int64)
        self.depth = int(self.length.max())
        self.codes = np.zeros((len(plain), self.depth), np.uint32)
        for k, t in enumerate(text):
            self.codes[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(self.codes[self.codes > 0])
        a, b = self.codes[:, :-1].astype(np.uint64), self.codes[:, 1:].astype(np.uint64)
        self.inside = np.unique((a << np.uint64(32) | b)[b > 0])  # neighbours that some piece holds
        self.byte = np.zeros(256, np.int32)
        raw = [b""] * self.size
        for i in range(self.size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[value], raw[i] = i, bytes([value])
            elif sp.is_unknown(i):
                raw[i] = " ⁇ ".encode()
        for i, t in zip(plain, text):
            raw[i] = t.replace(_SPACE, " ").encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        cross = [t for t in text if _SPACE in t.lstrip(_SPACE)]
        if cross:
            raise ValueError("a piece reaches across a space; such models are not supported")


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model's pieces, read once in each process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class Edges:
    """Occurrences of pieces, sorted by position and length. has holds, for each position, a bit for
    each length of an edge from it, so that an edge's place is that of the position's first one and
    the number of shorter ones."""

    def __init__(self, start: np.ndarray, length: np.ndarray, which: np.ndarray, n: int, depth: int) -> None:
        order = _sorted(start * (depth + 1) + length)
        start, length = start[order], length[order]
        self.which = np.append(which[order], -1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))])
        self.bit = np.uint64(1) << (np.arange(depth + 1) & 63).astype(np.uint64)
        self.below = self.bit - np.uint64(1)
        self.has = []
        for k in range(depth // 64 + 1):  # the bits of a position's edges differ, so that their sum joins them
            own = length >> 6 == k if depth >= 64 else slice(None)
            at, bits = start[own], self.bit[length[own]]
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
            word = np.zeros(n, np.uint64)
            word[at[new]] = np.add.reduceat(bits, new) if len(at) else 0
            self.has.append(word)

    def place(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place among the edges of the one from each start over each length; the last, which is
        no edge's, where there is none."""
        at = self.first[start]
        if len(self.has) == 1:
            has = self.has[0][start]
        else:
            has = np.choose(length >> 6, [w[start] for w in self.has])
            for k, w in enumerate(self.has[:-1]):
                at = at + np.where(k < length >> 6, np.bitwise_count(w[start]), 0)
        at = at + np.bitwise_count(has & self.below[length])
        return np.where(has & self.bit[length], at, len(self.which) - 1)

    def find(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece (its index, or -1) that leads from each start over each length."""
        return self.which[self.place(start, length)]


def _sorted(keys: np.ndarray) -> np.ndarray:
    """The order of non-negative keys, 16 bits at a time, the lowest first: a radix sort."""
    order = np.arange(len(keys))
    for shift in range(0, max(int(keys.max(initial=0)).bit_length(), 1), 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def suffix_matches(cp: np.ndarray, p: Pieces) -> Edges:
    """The occurrences of all pieces in a text of code points."""
    here = np.intersect1d(np.unique(cp), p.alphabet)
    two = len(here) > 253
    code = (np.arange(len(here)) + 1).astype(np.uint16 if two else np.uint8)
    other = np.iinfo(code.dtype).max - 1  # a character that no piece has

    def coded(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(here, x), max(len(here) - 1, 0))
        known = here[at] == x if len(here) else np.zeros(x.shape, bool)
        return np.where(known, code[at] if len(here) else 0, other).astype(code.dtype)

    wide = p.depth + -p.depth % 8
    text = np.zeros(len(cp) + wide, code.dtype)
    text[: len(cp)] = coded(cp)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, wide)[: len(cp)].astype(text.dtype.newbyteorder(">")))
    words = windows.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    flat = np.dtype(f"S{wide * code.itemsize}")
    sorted_suffixes = windows[order].view(flat).ravel()
    possible = np.flatnonzero(((p.codes == 0) | np.isin(p.codes, here)).all(1))
    low = np.zeros((len(possible), wide), windows.dtype)
    low[:, : p.depth] = np.where(p.codes[possible] > 0, coded(p.codes[possible]), 0)
    high = np.where(np.arange(wide) < p.length[possible, None], low, np.iinfo(code.dtype).max).astype(windows.dtype)
    lo = np.searchsorted(sorted_suffixes, np.ascontiguousarray(low).view(flat).ravel(), "left")
    hi = np.searchsorted(sorted_suffixes, np.ascontiguousarray(high).view(flat).ravel(), "right")
    start = order[take_ranges(lo, hi - lo)]
    which = np.repeat(possible, hi - lo)
    return Edges(start, p.length[which], which.astype(np.int32), len(cp), p.depth)


def _merge_long(a: int, b: int, edges: Edges, p: Pieces) -> list[int]:
    """Ends of the pieces of cp[a:b], by a heap of joins."""
    table = edges.find(np.repeat(np.arange(a, b), p.depth + 1), np.tile(np.arange(p.depth + 1), b - a)).reshape(b - a, -1)
    nxt, prv, end = list(range(1, b - a + 1)), list(range(-1, b - a - 1)), list(range(a + 1, b + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j < b - a and (n := end[j] - (a + i)) <= p.depth and (k := table[i, n]) >= 0:
            heapq.heappush(heap, (int(p.rank[p.ids[k]]), i, end[j]))

    for i in range(b - a):
        offer(i)
    gone = bytearray(b - a)
    while heap:
        _, i, to = heapq.heappop(heap)
        if gone[i] or (j := nxt[i]) >= b - a or end[j] != to:
            continue
        end[i], nxt[i], gone[j] = to, nxt[j], 1
        if nxt[j] < b - a:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    out, i = [], 0
    while i < b - a:
        out.append(end[i])
        i = nxt[i]
    return out


def _relax(cp: np.ndarray, runs: np.ndarray, edges: Edges, p: Pieces) -> np.ndarray:
    """Sorted ends of all pieces; runs are the starts of the stretches that no piece leaves."""
    n = len(cp)
    bound = np.append(runs, n)
    size = np.diff(bound)
    ends = [np.zeros(0, np.int64)]
    for r in np.flatnonzero(size > _LONG):
        ends.append(np.array(_merge_long(int(bound[r]), int(bound[r + 1]), edges, p), np.int64))
    short = np.flatnonzero(size <= _LONG)
    start = take_ranges(bound[short], size[short])
    run = np.repeat(np.arange(len(short)), size[short])
    stop = start + 1
    rank = np.append(p.rank[p.ids[edges.which[:-1]]], _NONE)  # by place

    def joins(i: np.ndarray, start: np.ndarray, stop: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The rank of joining symbols i and i + 1."""
        j = np.minimum(i + 1, len(start) - 1)
        length = stop[j] - start[i]
        ok = (i + 1 < len(start)) & (run[j] == run[i]) & (length <= p.depth)
        return np.where(ok, rank[edges.place(start[i], np.where(ok, length, 0))], _NONE)

    best = joins(np.arange(len(start)), start, stop, run) if len(start) else np.zeros(0, np.int64)
    while len(start):
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        low = np.minimum.reduceat(best, first)
        count = np.diff(np.append(first, len(start)))
        live = low < _NONE
        if not live.all():  # runs with nothing left to join are done
            stay = np.repeat(live, count)
            ends.append(stop[~stay])
            start, stop, run, best = start[stay], stop[stay], run[stay], best[stay]
            low, count = low[live], count[live]
            if not len(start):
                break
        hit = np.flatnonzero(best == np.repeat(low, count))
        at = hit[np.append(True, run[hit[1:]] != run[hit[:-1]])]  # the leftmost of each run
        stop[at] = stop[at + 1]
        keep = np.ones(len(start), bool)
        keep[at + 1] = False
        start, stop, run, best = start[keep], stop[keep], run[keep], best[keep]
        at -= np.arange(len(at))
        best[at] = joins(at, start, stop, run)
        before = at[(at > 0) & (run[at - 1] == run[at])] - 1
        best[before] = joins(before, start, stop, run)
    return np.sort(np.concatenate(ends))


def encode_units(units: pa.Array, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and their offsets."""
    size = np.asarray(pc.utf8_length(units), np.int64)
    ends = np.cumsum(size)
    ids, counts, a = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while a < len(units):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CHUNK)))
        raw, _ = flat_utf8(units[a:b])
        cp = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        cp[cp == 32] = ord(_SPACE)
        heads = np.concatenate([[0], np.cumsum(size[a:b])])
        edges = suffix_matches(cp, p)
        pair = cp[:-1].astype(np.uint64) << np.uint64(32) | cp[1:].astype(np.uint64)
        spot = np.minimum(np.searchsorted(p.inside, pair), len(p.inside) - 1)
        cut_at = np.append(True, p.inside[spot] != pair)
        cut_at[heads[:-1]] = True
        stop = _relax(cp, np.flatnonzero(cut_at), edges, p)
        start = np.append(0, stop[:-1])
        which = edges.find(start, np.minimum(stop - start, p.depth))
        found = np.where(which >= 0, p.ids[which], -1)
        unit = np.searchsorted(heads, start, "right") - 1
        lost = np.flatnonzero(found < 0)
        n = np.ones(len(found), np.int64)
        if len(lost):  # characters without a piece become bytes
            spelt = [chr(c).encode() for c in cp[start[lost]].tolist()]
            n[lost] = [len(s) for s in spelt]
            full = np.repeat(found, n)
            full[take_ranges((np.cumsum(n) - n)[lost], n[lost])] = p.byte[np.frombuffer(b"".join(spelt), np.uint8)]
            found = full
        ids.append(found.astype(np.int32))
        counts.append(np.bincount(unit, weights=n, minlength=b - a).astype(np.int64))
        a = b
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


class Known:
    """The ids of units encoded before, up to so many characters; words come again and again."""

    def __init__(self, p: Pieces, characters: int = 1 << 22) -> None:
        self.p, self.room = p, characters
        self.units = pa.array([], pa.large_string())
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (distinct) units end to end, and their offsets."""
        at = np.asarray(pc.fill_null(pc.index_in(units, self.units), -1), np.int64)
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        fresh = units.take(pa.array(new))
        ids, off = encode_units(fresh, self.p)
        start, n = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        start[old], n[old] = self.off[at[old]], np.diff(self.off)[at[old]]
        start[new], n[new] = off[:-1] + len(self.ids), np.diff(off)
        out = np.concatenate([self.ids, ids])[take_ranges(start, n)]
        size = np.cumsum(np.asarray(pc.utf8_length(fresh), np.int64))
        more = int(np.searchsorted(size, self.room, "right"))
        if more:
            self.room -= int(size[more - 1])
            self.units = pa.concat_arrays([self.units, fresh[:more]])
            self.ids, self.off = np.concatenate([self.ids, ids[: off[more]]]), np.concatenate([self.off, off[1 : more + 1] + self.off[-1]])
        return out, np.concatenate([[0], np.cumsum(n)])


def encode(col: pa.Array | pa.ChunkedArray, p: Pieces, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and their offsets; null and empty texts have none."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.replace_substring(pc.fill_null(col.cast(pa.large_string()), ""), _SPACE, " ")  # as the model's normaliser would
    units, seq, off = spaced_units(col)
    ids, at = known.of(units) if known else encode_units(units, p)
    n = np.diff(at)[seq]
    total = np.concatenate([[0], np.cumsum(n)])
    return ids[take_ranges(at[seq], n)], total[off]


def decode(ids: np.ndarray, off: np.ndarray, p: Pieces) -> pa.Array:
    """Texts of the id lists; ids that are no piece's, and control pieces, give nothing."""
    if len(ids) > _DECODE and len(off) > 2:  # in parts, as the indices take 20 times the text's memory
        parts, a = [], 0
        while a < len(off) - 1:
            b = max(a + 1, int(np.searchsorted(off, off[a] + _DECODE, "right")) - 1)
            parts.append(decode(ids[off[a] : off[b]], off[a : b + 1] - off[a], p))
            a = b
        return pa.concat_arrays(parts)
    bad = (ids < 0) | (ids >= p.size)
    i = np.where(bad, 1, ids)
    n = np.where(bad, 0, np.diff(p.raw_at)[i])
    raw = p.raw[take_ranges(p.raw_at[i], n)]
    at = np.concatenate([[0], np.cumsum(n)])[off]
    drop = at[:-1][(np.diff(at) > 0)]
    drop = drop[raw[drop] == 32]  # the space that encoding put before the text
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    raw = raw[keep]
    try:
        raw.tobytes().decode()
        text = string_array(raw, at)
        if len(at) > 1 and len(raw) and (raw[at[:-1][at[:-1] < len(raw)]] & 0xC0 == 0x80).any():
            raise UnicodeError
    except UnicodeError:
        text = pa.array([raw[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:])], pa.large_string())
    return text


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, decoded: one row for each row of docs, whole texts.

    ids equal what the SentencePiece library gives; decoded is the text made from them again, which
    is the text itself unless that holds U+2581, which decodes to a space. Null and empty texts have
    an empty list and an empty decoded. Null doc_ids and repeated rows are passed on. Other columns,
    whatever their names, play no part. An empty table gives no rows. model must be readable at the
    same path on every worker.
    """
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        known = Known(p)
        for whole in batches:
            for b in slices(whole, size=4_000_000):
                ids, off = encode(b.column("text"), p, known)
                out = decode(ids, off, p)
                yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(off), pa.int32()), _lists(ids, off), out.cast(pa.string())], ["doc_id", "n_pieces", "ids", "decoded"])

    return kept.mapInArrow(run, "doc_id bigint, n_pieces int, ids array<int>, decoded string")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids. A null list gives an empty text, a null id nothing."""
    kept = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            lists = b.column("ids")
            off = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
            ids = np.asarray(pc.fill_null(pc.list_flatten(lists), -1), np.int64)
            yield pa.record_batch([b.column("doc_id"), decode(ids, off, p).cast(pa.string())], ["doc_id", "text"])

    return kept.mapInArrow(run, "doc_id bigint, text string")
