"""Self-join of texts on the Jaccard similarity of their word n-gram sets.

MinHash signatures are cut into bands of rows, both counts chosen for a target recall at the
threshold. Texts that share a band hash are candidates. A byte of every minimum, kept as a sketch,
rules out the candidates that share too few of them (one pair in ten thousand at the threshold would
be ruled out); the others' components are small, as no text joins one by a chance hash. Each is cut
into tiles of like texts, and two tiles are verified on the full n-gram sets if a candidate pair lies
between them. Texts with equal words are one class throughout, so copies cost nothing; hot buckets
are cut into cells, so that no task sees a whole one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import cut, flat_utf8, fresh, partitions_for, row_hash, slices, small_side, string_array, take_ranges, text_or_empty
from textlake.llm.components import connected_components, joined

N, THRESHOLD, RECALL = 3, 0.6, 0.97
TILE_CHARS = 4_000_000  # texts of one group verified at once; larger groups are split into pairs of tiles
BUCKET = 1024  # classes of a band bucket that are compared in one task; larger buckets are split into pairs of parts
MISSED = 1e-4  # the part of pairs at the threshold that their sketches may rule out
_PAIRS = 1 << 17  # pairs of sketches compared at once
_WORD = np.ones(256, bool)
_WORD[:128] = [chr(i).isalnum() for i in range(128)]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(threshold: float, recall: float, far: float = 0.05) -> tuple[int, int]:
    """(bands, rows): the fewest rows that bring under far of the pairs at a third of the threshold
    together, with the bands that then find a pair at the threshold with probability recall."""
    for rows in range(1, 20):
        p = threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-p))) if p < 1 else 1
        if 1 - (1 - (threshold / 3) ** rows) ** bands <= far:
            break
    return bands, rows


def sketch_cut(threshold: float, places: int, missed: float = MISSED) -> int:
    """The most agreeing places of a sketch that a pair at the threshold falls short of with
    probability missed at most."""
    log, p, tail = math.lgamma, min(threshold, 1 - 1e-12), 0.0
    for k in range(places + 1):
        tail += math.exp(log(places + 1) - log(k + 1) - log(places - k + 1) + k * math.log(p) + (places - k) * math.log1p(-p))
        if tail > missed:
            return k
    return places


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each string."""
    raw, off = flat_utf8(words)
    n = np.diff(off)
    place = np.arange(len(raw)) - np.repeat(off[:-1], n)
    mixed = _mix((raw.astype(np.uint64) + np.uint64(1)) * _M1 + place.astype(np.uint64) * _M2)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(mixed, off[some])
    return _mix(out + n.astype(np.uint64))


def grams(col: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams, offsets of the texts among them, hash of each text's words).

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, in lower
    case. A text of fewer than n words has one n-gram of all of them, one without words none.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw, off = flat_utf8(pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")))
    word = _WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts_of_text = off[:-1][np.diff(off) > 0]
    first[starts_of_text] = word[starts_of_text]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[off[1:][np.diff(off) > 0] - 1] = word[off[1:][np.diff(off) > 0] - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    where = np.searchsorted(a, off)  # words before each text
    count = np.diff(where)
    # words are made adjacent so that they can be looked at as strings
    size = b - a
    kept = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(word, out=kept[1:])
    coded = string_array(raw[word], np.append(kept[a], kept[-1])).dictionary_encode() if len(size) else None
    w = _word_hashes(coded.dictionary)[np.asarray(coded.indices)] if coded is not None else np.zeros(0, np.uint64)
    g = np.zeros_like(w)
    for k in range(n):  # a gram that would run past its text is dropped below
        g[: len(w) - k] += _mix(w[k:] + np.uint64(k))
    whole = np.zeros(len(count), np.uint64)
    spot = np.arange(len(w), dtype=np.uint64) - np.repeat(where[:-1], count).astype(np.uint64)
    mixed = _mix(w + spot * _M2)
    some = np.flatnonzero(count)
    if len(some):
        whole[some] = np.add.reduceat(mixed, where[some])
    whole = _mix(whole + count.astype(np.uint64))
    keep = np.ones(len(w), bool)
    for k in range(1, n):
        keep[where[1:][count >= n] - k] = False
    short = np.flatnonzero((count > 0) & (count < n))
    for k in range(1, n):
        keep[(where[short] + k)[count[short] > k]] = False
    g[where[short]] = whole[short]
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    return _mix(g[keep]), np.concatenate([[0], np.cumsum(per)]).astype(np.int64), whole


def signatures(g: np.ndarray, off: np.ndarray, bands: int, rows: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(texts, bands) hashes of the bands' minima, and (texts, bands * rows) bytes of the minima;
    every text has at least one n-gram."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(off) - 1, bands), np.uint64)
    sketch = np.zeros((len(off) - 1, bands * rows), np.uint8)
    step = 1 << 16
    at = 0
    while at < len(off) - 1:  # a few texts at a time stay in the cache
        to = max(at + 1, int(np.searchsorted(off, off[at] + step, "right")) - 1)
        x, o = g[off[at] : off[to]], off[at:to] - off[at]
        buf = np.empty_like(x)
        for k in range(bands * rows):
            np.multiply(x, mul[k], out=buf)
            np.add(buf, add[k], out=buf)
            low = np.minimum.reduceat(buf, o)
            out[at:to, k // rows] = _mix(out[at:to, k // rows] + low + np.uint64(k))
            sketch[at:to, k] = low >> np.uint64(8)
        at = to
    return out, sketch


def _described(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tid (hash of the text), words (class), size (characters), bands, sketch of each row;
    the last four are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                g, off, words = grams(b.column("text"), n)
                has = np.diff(off) > 0
                some = np.flatnonzero(has)
                sig, sketch = signatures(g, np.append(off[some], off[-1]), bands, rows)
                at = np.concatenate([[0], np.cumsum(has)])
                lists = pa.ListArray.from_arrays(pa.array(at * bands, pa.int32()), pa.array(sig.astype(np.int64).ravel()), mask=pa.array(~has))
                bytes_ = pa.Array.from_buffers(pa.binary(), len(b), [pa.py_buffer(np.packbits(has, bitorder="little")), pa.py_buffer((at * bands * rows).astype(np.int32)), pa.py_buffer(sketch)])
                yield pa.record_batch(
                    [b.column("doc_id"), b.column("tid"), pa.array(words.astype(np.int64), mask=~has), pa.array(np.asarray(pc.utf8_length(b.column("text")), np.int64), mask=~has), lists, bytes_], ["doc_id", "tid", "words", "size", "bands", "sketch"]
                )

    return docs.mapInArrow(run, "doc_id bigint, tid bigint, words bigint, size bigint, bands array<bigint>, sketch binary")


def _near(sketches: np.ndarray, cell: np.ndarray, side: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of rows of one cell (runs of equal numbers) whose sketches agree in least places;
    in cells of two sides only pairs of both."""
    end = np.searchsorted(cell, cell, "right")
    after = end - 1 - np.arange(len(cell))
    ends = np.cumsum(after)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    two = np.maximum.reduceat(side, first) > np.minimum.reduceat(side, first)
    mixed = np.repeat(two, np.diff(np.append(first, len(cell))))
    a = 0
    while a < len(cell):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _PAIRS)))
        i = np.repeat(np.arange(a, b), after[a:b])
        j = take_ranges(np.arange(a, b) + 1, after[a:b])
        if mixed[a:b].any():
            ok = ~mixed[i] | (side[i] != side[j])
            i, j = i[ok], j[ok]
        near = (sketches[i] == sketches[j]).sum(1, dtype=np.uint16) >= least
        yield i[near], j[near]
        a = b


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], size: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] = lambda b: iter([b])) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches, regrouped so that no run of equal keys goes on in the next; with the places
    where the runs begin, and the end."""
    rest = None
    for whole in batches:
        for f in size(whole):
            f = f if rest is None else pa.concat_batches([rest, f])
            key = np.stack([np.asarray(f.column(c), np.int64) for c in keys], 1)
            change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(change):
                yield f.slice(0, change[-1]), np.append(0, change)
                f = f.slice(change[-1])
            rest = f
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _buckets(one: DataFrame) -> DataFrame:
    """hash, m (its classes) of the band hashes of several classes; of hashes with the same classes
    only one."""
    slots = one.select("words", F.explode("bands").alias("hash"))
    many = slots.groupBy("hash").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("words")).alias("x"), F.min("words").alias("a"), F.max("words").alias("b")).where("m > 1")
    return cut(many.groupBy("m", "x", "a", "b").agg(F.min("hash").alias("hash")).select("hash", "m"))


def _candidates(one: DataFrame, buckets: DataFrame, least: int, spots: DataFrame | None = None) -> DataFrame:
    """a, b: pairs of classes that connect all candidates; with spots (words, component, tile) the
    component, lo, hi of the tiles between which there are candidates."""
    slots = one.select("words", F.explode("bands").alias("hash"))
    extra = []
    if spots is not None:
        slots = slots.join(small_side(spots, 3), "words")
        extra = ["component", "tile"]
    slots = slots.join(small_side(buckets, 2), "hash")
    parts = F.ceil(F.col("m") / BUCKET).cast("int")
    part = F.pmod(F.xxhash64("words", F.lit(1)), parts).cast("int")
    cells = slots.withColumn("part", part).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select("words", "hash", *extra, "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    cells = cells.join(one.select("words", "sketch"), "words")
    keys = ["hash", "lo", "hi"]
    cells = cells.repartition(partitions_for(one), *keys).sortWithinPartitions(*keys, "part", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, at in _whole_runs(batches, keys):
            cell = np.repeat(np.arange(len(at) - 1), np.diff(at))
            side, words = np.asarray(f.column("part")), np.asarray(f.column("words"))
            sketches = np.frombuffer(b"".join(f.column("sketch").to_pylist()), np.uint8).reshape(len(f), -1)
            if extra:
                group, tile = (np.asarray(f.column(c)) for c in extra)
                for i, j in _near(sketches, cell, side, least):
                    out = np.unique(np.stack([group[i], np.minimum(tile[i], tile[j]), np.maximum(tile[i], tile[j])], 1)[(tile[i] != tile[j]) & (group[i] == group[j])], axis=0)
                    yield pa.record_batch([pa.array(out[:, k]) for k in range(3)], ["component", "lo", "hi"])
                continue
            low = np.arange(len(f))
            for i, j in _near(sketches, cell, side, least):
                # what is connected already needs no further pair
                low = joined(len(f), np.concatenate([np.arange(len(f)), i]), np.concatenate([low, j]))
            new = np.flatnonzero(low != np.arange(len(f)))
            yield pa.record_batch([pa.array(words[new]), pa.array(words[low[new]])], ["a", "b"])

    return cells.mapInArrow(run, "component bigint, lo bigint, hi bigint" if extra else "a bigint, b bigint").distinct()


def _verify(texts: pa.Array, words: np.ndarray, left: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of the pairs i < j that reach the threshold; where left is both True and
    False, only of pairs between the two sides. Texts whose words are not those in words, or that
    repeat an earlier one, are passed over."""
    g, off, found = grams(texts, n)
    own = np.flatnonzero(found.astype(np.int64) == words)
    real = np.zeros(len(texts), bool)
    real[own[np.unique(words[own], return_index=True)[1]]] = True
    who = np.repeat(np.arange(len(texts)), np.diff(off))
    g, who = g[real[who]], who[real[who]]
    order = np.lexsort((g, who))
    g, who = g[order], who[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (who[1:] != who[:-1])
    g, who = g[new], who[new]
    size = np.bincount(who, minlength=len(texts))
    _, gram, times = np.unique(g, return_inverse=True, return_counts=True)
    shared = times[gram] > 1  # the others take no part in any intersection
    gram, w = gram[shared], who[shared]
    _, gram = np.unique(gram, return_inverse=True)
    both = np.zeros((len(texts), len(texts)), np.float32)
    if len(gram):
        width = max(256, min(int(gram.max()) + 1, 8_000_000 // len(texts)))
        order = np.argsort(gram, kind="stable")
        gram, w = gram[order], w[order]
        for c in range(0, int(gram[-1]) + 1, width):
            a, b = np.searchsorted(gram, [c, c + width])
            dense = np.zeros((len(texts), width), np.float32)
            dense[w[a:b], gram[a:b] - c] = 1
            both += dense @ dense.T  # counts below 2^24 are exact
    i, j = np.nonzero(np.triu(both, 1))
    if left.any() and not left.all():
        across = left[i] != left[j]
        i, j = i[across], j[across]
    inter = both[i, j].astype(np.float64)
    jac = inter / (size[i] + size[j] - inter)
    ok = jac >= threshold
    return i[ok], j[ok], jac[ok]


def _tiled(placed: DataFrame) -> DataFrame:
    """placed (words, component, size, lead) with the tile of each row: 0 in all components but those
    over TILE_CHARS, whose tiles are ranges of lead (like texts have like leads), and of those the
    ones over TILE_CHARS again parts by hash. A text also counts for a 1024th of a tile."""
    weight = F.sum(F.col("size") + F.lit(TILE_CHARS // 1024))
    large = cut(placed.groupBy("component").agg(weight.alias("w")).where(F.col("w") > TILE_CHARS).select("component", F.ceil(F.col("w") / TILE_CHARS).alias("tiles")))
    place = F.shiftrightunsigned("lead", 11) / F.lit(2.0**53)
    rows = placed.join(small_side(large, 2), "component", "left").withColumn("range", F.coalesce(F.floor(place * F.col("tiles")), F.lit(0)))
    hot = cut(rows.where("tiles is not null").groupBy("component", "range").agg(weight.alias("w")).where(F.col("w") > TILE_CHARS).select("component", "range", F.ceil(F.col("w") / TILE_CHARS).alias("parts")))
    rows = rows.join(small_side(hot, 3), ["component", "range"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("words", F.lit(2)), F.col("parts")), F.lit(0))
    return rows.select("words", "component", (F.shiftleft("range", 24) + part).cast("bigint").alias("tile"), F.col("tiles").isNotNull().alias("large"))


def described_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(seen, pairs): doc_id, tid (hash of the text) and class (hash of the words, null without words)
    of every row of docs that has a doc_id, and a < b, jaccard of the classes that reach the
    threshold. seen are the members of the classes, pairs hold a class once whatever its copies."""
    bands, rows = bands_for(threshold, recall)
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).where("doc_id is not null").withColumn("tid", F.xxhash64("text"))
    seen = cut(_described(kept, n, bands, rows))
    one = cut(seen.where("words is not null").groupBy("words").agg(F.min(F.struct("doc_id", "tid", "size", "bands", "sketch")).alias("s")).select("words", "s.*"))
    buckets, least = _buckets(one), sketch_cut(threshold, bands * rows)
    group = cut(connected_components(_candidates(one, buckets, least)))
    placed = cut(one.select("words", "doc_id", "tid", "size", F.get("bands", F.lit(0)).alias("lead")).join(small_side(group, 2), F.col("words") == F.col("node")).drop("node"))
    tiles = cut(_tiled(placed))
    spots = cut(tiles.where("large").select("words", "component", "tile"))
    own = tiles.select("words", "component", "tile", F.col("tile").alias("lo"), F.col("tile").alias("hi"))
    if spots.count():  # all of two tiles meet where one candidate lies between them
        between = cut(_candidates(one, buckets, least, spots))
        across = [spots.join(small_side(between, 3).withColumnRenamed("component", "c"), (F.col("component") == F.col("c")) & (F.col("tile") == F.col(side))).select("words", "component", "tile", "lo", "hi") for side in ("lo", "hi")]
        own = own.unionByName(across[0]).unionByName(across[1])
    meets = cut(own.join(placed.select("words", "doc_id", "tid"), "words"))
    met = cut(meets.select("doc_id", "tid").distinct())
    # texts without a candidate are not moved, repeated rows once
    texts = kept.join(small_side(met, 2), ["doc_id", "tid"], "left_semi").groupBy("doc_id", "tid").agg(F.min("text").alias("text"))
    keys = ["component", "lo", "hi"]
    sent = texts.join(meets, ["doc_id", "tid"]).select(*keys, "words", "tile", "text").repartition(partitions_for(docs), *keys).sortWithinPartitions(*keys, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, at in _whole_runs(batches, keys, slices):
            words, tile, lo = (np.asarray(f.column(c)) for c in ("words", "tile", "lo"))
            hi, text, out = np.asarray(f.column("hi")), f.column("text"), []
            for a, b in zip(at[:-1], at[1:]):
                left = tile[a:b] == lo[a] if lo[a] != hi[a] else np.ones(b - a, bool)
                i, j, jac = _verify(text.slice(a, b - a), words[a:b], left, n, threshold)
                out.append((words[a:b][i], words[a:b][j], jac))
            x, y, z = (np.concatenate([o[k] for o in out]) for k in range(3))
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(z)], ["a", "b", "jaccard"])

    # a pair is found once, in the cell of its two tiles
    return seen.select("doc_id", "tid", F.col("words").alias("class")), cut(sent.mapInArrow(run, "a bigint, b bigint, jaccard double"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_copies, n_links: one row for each document, which is a distinct doc_id and
    set of words in their order.

    Two documents are linked if the Jaccard similarity of their n-gram sets reaches the threshold.
    n_links is the number of other documents that a document is linked to, n_copies how many of
    these have the same words; class_id is the least doc_id among all that links connect it to. The
    pairs themselves are those of described_classes, between one text of each class.

    Every document is compared, whole. Texts with the same words are always linked; other pairs at
    the threshold are found with probability recall at least, and more above it. Rows with a null
    doc_id are left out. A null, empty or wordless text has no links; all such texts under one id
    are one document. Repeated rows count once; a doc_id on texts of different words is that many
    documents, which may be linked to each other. An empty table gives no rows. Other columns play
    no part, and there are no ties to break.
    """
    seen, pairs = described_classes(docs, n, threshold, recall)
    members = cut(seen.select("doc_id", "class").distinct())
    size = members.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("to")))
    ends = cut(both.select("class").distinct())
    # classes of one document without a pair need no looking after
    size = cut(size.join(small_side(ends), "class", "left_semi").unionByName(size.join(small_side(ends), "class", "left_anti").where("n > 1")))
    near = both.join(small_side(size.select(F.col("class").alias("to"), "n"), 2), "to").groupBy("class").agg(F.sum("n").alias("near"))
    group = connected_components(pairs).select(F.col("node").alias("class"), "component")
    info = size.join(near, "class", "left").join(group, "class", "left").withColumn("component", F.coalesce("component", "class"))
    info = cut(info)
    least = info.groupBy("component").agg(F.min("first").alias("class_id"))
    info = cut(info.join(small_side(cut(least), 2), "component").select("class", "class_id", (F.col("n") - 1).alias("n_copies"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    out = members.join(small_side(info, 4), "class", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_copies", "n_links")])


def keep_one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each group of near copies: the one with the least doc_id, of those the
    one with the least hash of the words and the text.

    Groups are the connected components of ngram_jaccard_join's links. Each text is judged by itself,
    whatever doc_id it shares with others, so that unrelated texts under one id all stay. Rows with a
    null doc_id and texts without words stay as they are, repeated or not; other rows that repeat a
    doc_id and text are copies, of which the one with the least hash of all columns stays (and all
    that are equal in all columns but one go). An empty table gives no rows; all columns are kept.
    """
    seen, pairs = described_classes(docs, n, threshold, recall)
    seen = cut(seen.where("class is not null").groupBy("doc_id", "tid", "class").agg(F.count("*").alias("n")))
    group = cut(connected_components(pairs))
    whole = seen.join(small_side(group, 2), F.col("class") == F.col("node"), "left").select("doc_id", "tid", "class", F.coalesce("component", "class").alias("c"))
    first = whole.groupBy("c").agg(F.min(F.struct("doc_id", "class", "tid")).alias("s"), F.count("*").alias("k")).where("k > 1").select("c", F.col("s.doc_id").alias("d"), F.col("s.tid").alias("t"))
    id_name, text_name = fresh(docs, "__id"), fresh(docs, "__tid")
    gone = whole.join(small_side(cut(first), 3), "c").where("doc_id <> d or tid <> t").select(F.col("doc_id").alias(id_name), F.col("tid").alias(text_name))
    twice = seen.where("n > 1").select(F.col("doc_id").alias(id_name), F.col("tid").alias(text_name))
    gone, twice = cut(gone), cut(twice)
    same = (F.col("doc_id").cast("bigint") == F.col(id_name)) & (F.xxhash64(text_or_empty()) == F.col(text_name))
    stays = docs.join(small_side(gone, 2), same, "left_anti")
    if not twice.count():
        return stays
    row, key, nth = fresh(docs, "__row"), fresh(docs, "__key"), fresh(docs, "__nth")
    again = stays.join(small_side(twice, 2), same, "left_semi").withColumn(row, row_hash(docs)).withColumn(key, F.xxhash64(text_or_empty()))
    one = again.withColumn(nth, F.row_number().over(Window.partitionBy(F.col("doc_id").cast("bigint"), key).orderBy(row))).where(F.col(nth) == 1)
    return stays.join(small_side(twice, 2), same, "left_anti").unionByName(one.drop(row, key, nth))
