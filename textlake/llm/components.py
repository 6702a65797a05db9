"""Connected components by alternating star contractions; few edges are joined in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import cut

FEW = 1_000_000  # edges (16 MB of numbers) that one task joins


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place in the component of each of n places, which the pairs (i, j) connect."""
    low = np.arange(n)
    while len(i):
        a, b = low[i], low[j]
        least = np.minimum(a, b)
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        while not (low[low] == low).all():
            low = low[low]
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    return low


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([np.asarray(b.column(c), np.int64) for c in ("u", "v")]) for b in batches]
        uv = np.concatenate([np.zeros((2, 0), np.int64), *held], 1)
        nodes, at = np.unique(uv, return_inverse=True)
        i, j = at.reshape(uv.shape)
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[joined(len(nodes), i, j)])], ["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node bigint, component bigint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node of its group.

    Up to FEW distinct edges are joined in one task. For more, each round points every node's larger
    neighbours at its least neighbour (large star), then its smaller ones (small star); it needs
    O(log n) rounds in practice and stops when a round changes nothing. The result is the same.
    Self-loops and nulls are ignored, repeated edges count once, no edges give no rows. Each round is
    cut to the shared checkpoint folder, so a lost executor costs a re-read only.
    """
    e = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if e.count() <= FEW:
        return _at_once(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # the edges are stars around least nodes exactly when two rounds agree
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
