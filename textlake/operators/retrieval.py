"""Similarity search over embeddings.

Up to QUERY_BLOCK queries are sent to every task as one matrix, and the corpus is read where it lies.
More queries are dealt into blocks of that size, and the corpus into as many as keep all cores at
work; each pair of blocks is a cell that one task multiplies, with the corpus passing through in
batches. What is moved is each side once for each block of the other. A task holds a block of queries
and their best so far, and gives on k rows per query, not pairs, whatever the size of the tables.

Products in single precision rule out what is surely not among a query's best; what is left is scored
in double precision, term by term as SQL sums it, so that equal vectors tie.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions.arrow import give_back

QUERY_BLOCK, CORPUS_BLOCK = 32_768, 1_000_000  # the most rows of a cell's two sides
_TILE = 2048
_PAIRS = 65_536  # scored at once


def dot(x: str | Column, y: str | Column) -> Column:
    """Inner product in double precision."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def cosine(x: str | Column, y: str | Column) -> Column:
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _matrices(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the rows that have a vector of it, and the vectors, in the precision they have."""
    n = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    out = {}
    for d in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == d)
        flat = np.asarray(pc.fill_null(pc.list_flatten(col.take(pa.array(rows))), np.nan)).reshape(len(rows), d)
        size = _sizes(flat)
        ok = np.isfinite(size) & (size > 0)
        if ok.any():
            out[d] = (rows, flat) if ok.all() else (rows[ok], flat[ok])
    return out


def _sizes(x: np.ndarray) -> np.ndarray:
    """The lengths of vectors: squares are summed in order, in double precision."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for c in x.T:
            total += np.square(c, dtype=np.float64)
        return np.sqrt(total)


class _Vectors:
    """ids and vectors of one dimension: columns to score by, lengths, and of length 1 in single precision."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        small = _sizes(x) < 1e-100
        if small.any():  # a power of two, so that products of lengths do not vanish
            x = np.where(small[:, None], x * 2.0**400, x)
        self.ids, self.columns, self.size = ids, np.ascontiguousarray(x.T), _sizes(x)
        self.unit = np.empty(x.shape, np.float32)
        for lo in range(0, len(x), _TILE):
            self.unit[lo : lo + _TILE] = x[lo : lo + _TILE] / self.size[lo : lo + _TILE, None]

    def score(self, i: np.ndarray, other: _Vectors, j: np.ndarray) -> np.ndarray:
        """The cosine of each pair."""
        out = np.empty(len(i))
        for lo in range(0, len(i), _PAIRS):
            a, b = i[lo : lo + _PAIRS], j[lo : lo + _PAIRS]
            total = np.zeros(len(a))
            for p, q in zip(self.columns, other.columns):
                total += np.multiply(p[a], q[b], dtype=np.float64)
            out[lo : lo + _PAIRS] = total / (self.size[a] * other.size[b])
        return out


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, id: str = "vec_id", embedding: str = "embedding", least: float | None = None) -> DataFrame:  # noqa: A002
    """query_id, corpus_id, score, rank: each query's k nearest by cosine, rank 1 first, ties by id.

    A query finds vectors of its own dimension only, whatever others the tables hold. Rows without a
    usable vector find and are found by nothing. least drops hits whose score is lower. Scores are in
    double precision.
    """
    kinds = {dict(df.dtypes)[embedding] for df in (queries, corpus)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    q, c = (df.select(F.col(id).cast("bigint").alias("id"), F.col(embedding).cast(kind).alias("v")).where("id is not null and size(v) > 0") for df in (queries, corpus))
    n = q.count()
    found = _broadcast(q, c, k, least) if n <= QUERY_BLOCK else _cells(q, c, n, c.count(), k, least)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Best:
    """The k best of each query among what has been added, of vectors of one dimension."""

    def __init__(self, queries: _Vectors, k: int, least: float | None) -> None:
        n, d = queries.unit.shape
        self.queries, self.k, self.least = queries, k, -np.inf if least is None else least
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.margin = 2 * (d + 8) * 2.0**-23  # over twice what single precision is off by
        self.bound = np.full(n, self.least - self.margin)
        self.space = np.empty((1024, _TILE), np.float32)

    def add(self, corpus: _Vectors) -> None:
        for lo in range(0, len(corpus.ids), _TILE):
            x = corpus.unit[lo : lo + _TILE]
            for a in range(0, len(self.queries.ids), 1024):
                y = self.queries.unit[a : a + 1024]
                s = np.matmul(y, x.T, out=self.space[: len(y), : len(x)])
                bound = np.nextafter(self.bound[a : a + 1024].astype(np.float32), np.float32(-np.inf))
                near = s >= bound[:, None]
                if s.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(y):
                    near = s >= np.maximum(bound, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - np.float32(self.margin))[:, None]
                i, j = np.nonzero(near)
                for at in range(0, len(i), 16 * _PAIRS):
                    self._take(a + i[at : at + 16 * _PAIRS], corpus, lo + j[at : at + 16 * _PAIRS])

    def _take(self, i: np.ndarray, corpus: _Vectors, j: np.ndarray) -> None:
        """Pairs of a query and a row, by query."""
        s = self.queries.score(i, corpus, j)
        ok = s >= np.maximum(self.least, self.score[i, -1])
        i, j, s = i[ok], j[ok], s[ok]
        asked = i[np.flatnonzero(np.diff(i, prepend=-1))]
        all_i, all_s = np.concatenate([np.repeat(asked, self.k), i]), np.concatenate([self.score[asked].ravel(), s])
        all_id = np.concatenate([self.id[asked].ravel(), corpus.ids[j]])
        order = np.lexsort((all_id, -all_s, all_i))
        first = np.flatnonzero(np.diff(all_i[order], prepend=-1))
        best = order[first[:, None] + np.arange(self.k)]  # each has k of before at least
        self.score[asked], self.id[asked] = all_s[best], all_id[best]
        self.bound[asked] = np.maximum(self.least, self.score[asked, -1]) - self.margin

    def result(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.record_batch([pa.array(self.queries.ids[i]), pa.array(self.id[i, j]), pa.array(self.score[i, j])], ["query_id", "corpus_id", "score"])


_FOUND = "query_id bigint, corpus_id bigint, score double"


def _vectors(b: pa.RecordBatch) -> dict[int, _Vectors]:
    ids = np.asarray(b.column("id"))
    return {d: _Vectors(ids[rows], x) for d, (rows, x) in _matrices(b.column("v")).items()}


def _run(queries: dict[int, _Vectors], corpus: Iterator[pa.RecordBatch], k: int, least: float | None) -> Iterator[pa.RecordBatch]:
    best = {d: _Best(v, k, least) for d, v in queries.items()}
    for b in corpus:
        for d, v in _vectors(b).items():
            if d in best:
                best[d].add(v)
    for d in list(best):
        yield best.pop(d).result()
    give_back()


def _broadcast(q: DataFrame, c: DataFrame, k: int, least: float | None) -> DataFrame:
    table = q.toArrow().combine_chunks()
    batches = table.to_batches()
    shared = q.sparkSession.sparkContext.broadcast(_vectors(batches[0]) if batches else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _run(shared.value, batches, k, least)

    return c.mapInArrow(run, _FOUND)


def _cells(q: DataFrame, c: DataFrame, n: int, m: int, k: int, least: float | None) -> DataFrame:
    cores = q.sparkSession.sparkContext.defaultParallelism
    qs = -(-n // QUERY_BLOCK)
    cs = max(1, -(-2 * cores // qs), -(-m // CORPUS_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "v", block(qs).alias("bq"), all_of(cs).alias("bc"), F.lit(0).alias("side"))
    right = c.select("id", "v", all_of(qs).alias("bq"), block(cs).alias("bc"), F.lit(1).alias("side"))
    cells = left.unionByName(right).select("id", "v", "side", (F.col("bq") * cs + F.col("bc")).alias("cell"))
    cells = cells.repartitionById(qs * cs, F.col("cell")).select("side", "id", "v").sortWithinPartitions("side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        rest: list[pa.RecordBatch] = []
        for b in batches:
            n = int(np.searchsorted(np.asarray(b.column("side")), 1))
            asked.append(b.slice(0, n))
            if n < len(b):
                rest.append(b.slice(n))
                break
        if not rest:
            return
        queries = _vectors(pa.concat_batches(asked))
        asked.clear()
        yield from _run(queries, itertools.chain(rest, batches), k, least)

    return cells.mapInArrow(run, _FOUND)


def near_duplicates(queries: DataFrame, corpus: DataFrame, label: str, tau: float = 0.95, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:  # noqa: A002
    """split, query_id, corpus_id, similarity: the nearest corpus row of each query, if the similarity
    is at least tau (before it is rounded to 4 places)."""
    top = search(queries, corpus, 1, id, embedding, least=tau)
    return top.select(F.lit(label).alias("split"), "query_id", "corpus_id", F.round("score", 4).alias("similarity"))


def most_similar(found: DataFrame, show: int | None = None) -> DataFrame:
    """near_duplicates' rows, the most similar first (ties by split and ids); only so many if show is
    given, as a report does."""
    out = found.orderBy(F.desc("similarity"), "split", "query_id", "corpus_id")
    return out if show is None else out.limit(show)


def context(hits: DataFrame, texts: DataFrame, tau: float = 0.30, most: int = 3000, none: str = "No context was found.") -> DataFrame:
    """query_id, context, sources of each query among the hits: the texts of the hits above tau in
    rank order, line by line, cut to most characters; the sources name origin and score."""
    kept = hits.join(texts, hits["corpus_id"] == texts["id"]).where(F.col("score") > tau)
    lines = F.sort_array(F.collect_list(F.struct("rank", "text", "origin", "score")))
    by = kept.groupBy("query_id").agg(lines.alias("x"))
    made = by.select("query_id", F.substring(F.array_join("x.text", "\n"), 1, most).alias("context"), F.array_join(F.transform("x", lambda h: F.format_string("• %s (Score: %.2f)", h["origin"], h["score"])), "\n").alias("sources"))
    asked = hits.select("query_id").distinct()
    return asked.join(made, "query_id", "left").select("query_id", F.coalesce("context", F.lit(none)).alias("context"), F.coalesce("sources", F.lit("")).alias("sources"))
