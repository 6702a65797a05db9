"""Links between near-equal embeddings by int8 tile products with error bounds.

Every vector is scaled to length 1 and quantised to int8 with its own scale; the length of what that
leaves over is kept. For x = x' + e and y = y' + f the product differs from x'y' by at most
|e||y'| + |f| (as |x| = 1), so a pair whose quantised product lies lower than the threshold by more
than that is ruled out for certain, and one that lies higher by as much is certain too. What remains
in between is computed again from the full vectors.

Vectors are dealt to blocks by hash; each pair of blocks is one cell, which gets the 64 bytes or so
of its vectors and multiplies them tile by tile. All pairs are looked at: work grows with the square
of the rows, what is moved with rows x blocks x bytes of a quantised vector. Of its certain pairs a
cell gives each vector's number and the fewest that connect what they connect, so that a group of
near-equal vectors is never written out pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.arrow import runs_of
from textlake.llm.common import cut, fresh, hash_u63, small_side
from textlake.llm.components import connected_components, joined

THRESHOLD = 0.9
BLOCK = 16_384  # vectors of a block on average
_TILE = 1024
_EXACT = 1000  # int8 products summed over as many places are exact in float32
_SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, length of scale * q, length of the rest) of each row of x, which have length 1."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    d = a.shape[1]
    if d <= _EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T).astype(np.float64) for k in range(0, d, _EXACT))


def possible_pairs(left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs that may reach the threshold, and whether they certainly do, by tile;
    if same, only i < j."""
    (q, s, n, e), (p, t, m, f) = left, right
    for a in range(0, len(q), _TILE):
        for b in range(a if same else 0, len(p), _TILE):
            i, j = slice(a, a + _TILE), slice(b, b + _TILE)
            dots = _products(q[i], p[j])
            # one bound for each row first: the least that any column could need
            need = threshold - e[i] * m[j].max() - f[j].max() - _SLACK
            scale = s[i] * np.where(need > 0, t[j].max(), t[j].min())
            x, y = np.nonzero(dots >= (need / scale * (1 - 1e-6 * np.sign(need)))[:, None])
            x, y = x + a, y + b
            if same:
                x, y = x[x < y], y[x < y]
            value, rest = dots[x - a, y - b] * s[x] * t[y], e[x] * m[y] + f[y] + _SLACK
            ok = value + rest >= threshold
            yield x[ok], y[ok], (value - rest >= threshold)[ok]


def _quantised(vectors: DataFrame) -> DataFrame:
    """id, h, dim, q (bytes), scale, len, err of the vectors that can be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(pc.fill_null(pc.list_value_length(b.column("v")), 0), np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            flat = np.asarray(pc.fill_null(pc.list_flatten(b.column("v")), np.nan), np.float64)
            for d in np.unique(n[n > 0]).tolist():
                rows = np.flatnonzero(n == d)
                x = flat[at[rows][:, None] + np.arange(d)]
                with np.errstate(over="ignore", invalid="ignore"):
                    size = np.linalg.norm(x, axis=1)
                ok = np.isfinite(size) & (size > 0)
                rows, x = rows[ok], x[ok] / size[ok, None]
                if not len(rows):
                    continue
                q, scale, length, rest = quantise(x)
                yield pa.record_batch(
                    [b.column("id").take(pa.array(rows)), b.column("h").take(pa.array(rows)), pa.array(np.full(len(rows), d), pa.int32()), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(length), pa.array(rest)],
                    ["id", "h", "dim", "q", "scale", "len", "err"],
                )

    return vectors.mapInArrow(run, "id bigint, h bigint, dim int, q binary, scale double, len double, err double")


def _cells(placed: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """kind, a, ah, b, bh, n: 0, the number n of a vector's certain links in a cell; 1, a pair of the
    few that connect all that certain links connect; 2, a pair that may be linked."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    cells = placed.select("*", other).select("id", "h", "dim", "q", "scale", "len", "err", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    cells = cells.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi", "b", "id", "h")

    def out(kind: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(n), kind), pa.int32()), *(pa.array(x, pa.int64()) for x in (*a, *b, n))], ["kind", "a", "ah", "b", "bh", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in runs_of(batches, ["dim", "lo", "hi"]):
            ids, h, b = (np.asarray(c.column(k)) for k in ("id", "h", "b"))
            q = np.frombuffer(b"".join(c.column("q").to_pylist()), np.int8).reshape(len(ids), -1)
            rest = [np.asarray(c.column(k)) for k in ("scale", "len", "err")]
            lo, hi = c.column("lo")[0].as_py(), c.column("hi")[0].as_py()
            one, two = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
            if not len(one) or not len(two):
                continue
            left, right = ((q[k], *(r[k] for r in rest)) for k in (one, two))
            links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for i, j, sure in possible_pairs(left, right, threshold, lo == hi):
                x, y = one[i], two[j]
                new = ids[x] != ids[y]
                x, y, sure = x[new], y[new], sure[new]
                ask = ~sure
                if ask.any():
                    yield out(2, (ids[x[ask]], h[x[ask]]), (ids[y[ask]], h[y[ask]]), np.ones(ask.sum(), np.int64))
                x, y = x[sure], y[sure]
                if len(x):
                    links += np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
                    low = joined(len(ids), np.concatenate([np.arange(len(ids)), x]), np.concatenate([low, y]))
            k = np.flatnonzero(links)
            yield out(0, (ids[k], h[k]), (ids[k], h[k]), links[k])
            k = np.flatnonzero(low != np.arange(len(ids)))
            yield out(1, (ids[k], h[k]), (ids[low[k]], h[low[k]]), np.ones(len(k), np.int64))

    return cells.mapInArrow(run, "kind int, a bigint, ah bigint, b bigint, bh bigint, n bigint")


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:  # noqa: A002
    """id, class_id, n_links: one row for each distinct id and vector.

    Two rows of different ids are linked if their cosine is at least the threshold (above 0); none is
    missed. n_links is the number of rows that a row is linked to, class_id the least id among all
    that links connect its id to. Vectors that are null, empty, all zero, or hold a null, NaN or
    infinity have no links; vectors are linked only to ones of their own dimension. Rows with a null
    id are left out, repeated rows count once, and an id on several vectors has a row for each.
    There are no ties to break. An empty table gives no rows. Other columns play no part.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    v = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null").withColumn("h", F.xxhash64("v"))
    blocks = max(1, -(-vectors.count() // block))
    quantised = _quantised(v.where("size(v) > 0")).groupBy("id", "h").agg(F.first(F.struct("dim", "q", "scale", "len", "err")).alias("s")).select("id", "h", "s.*")
    placed = cut(quantised.withColumn("b", F.pmod(hash_u63("id", "h", seed=5), F.lit(blocks)).cast("int")))
    found = cut(_cells(placed, blocks, threshold))
    maybe = found.where("kind = 2").select("a", "ah", "b", "bh")
    asked = cut(maybe.select(F.col("a").alias("id"), F.col("ah").alias("h")).unionByName(maybe.select(F.col("b").alias("id"), F.col("bh").alias("h"))).distinct())
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    full = v.join(small_side(asked, 2), ["id", "h"], "left_semi").groupBy("id", "h").agg(F.first("v").alias("v")).withColumn("m", F.sqrt(dot(F.col("v"), F.col("v"))))
    x, y = full.select(F.col("id").alias("a"), F.col("h").alias("ah"), F.col("v").alias("x"), "m"), full.select(F.col("id").alias("b"), F.col("h").alias("bh"), F.col("v").alias("y"), F.col("m").alias("n"))
    exact = maybe.join(x, ["a", "ah"]).join(y, ["b", "bh"]).where(dot(F.col("x"), F.col("y")) / (F.col("m") * F.col("n")) >= threshold)
    exact = cut(exact.select("a", "ah", "b", "bh"))
    one = F.lit(1).cast("bigint").alias("n")
    degree = found.where("kind = 0").select("a", "ah", "n").unionByName(exact.select("a", "ah", one)).unionByName(exact.select(F.col("b").alias("a"), F.col("bh").alias("ah"), one))
    degree = cut(degree.groupBy("a", "ah").agg(F.sum("n").alias("n_links")))
    group = cut(connected_components(found.where("kind = 1").select("a", "b").unionByName(exact.select("a", "b"))))
    rows = v.select("id", "h").distinct().join(small_side(degree, 3), (F.col("id") == F.col("a")) & (F.col("h") == F.col("ah")), "left").join(small_side(group, 2), F.col("id") == F.col("node"), "left")
    return rows.select(F.col("id").alias(id), F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def drop_near_copies(vectors: DataFrame, threshold: float = THRESHOLD, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:  # noqa: A002
    """vectors with one id of each group of near copies (what near_links connects), the least one.

    All rows of an id stay or go together, repeated ones too. Rows with a null id and vectors that
    have no links, null, empty and zero ones among them, all stay; so do all columns, whatever their
    names. An empty table gives no rows.
    """
    name = fresh(vectors, "__gone")
    gone = cut(near_links(vectors, threshold, id, embedding).where(F.col(id) != F.col("class_id")).select(F.col(id).alias(name)).distinct())
    return vectors.join(small_side(gone), F.col(id).cast("bigint") == F.col(name), "left_anti")
