"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents form blocks by hash. The weights give each source an exact quota of blocks.
A binary tree over the output shards splits the quotas: at every node the left half's blocks of each
source are one multivariate-hypergeometric draw, until a leaf holds one shard's exact quota of every
source. A source's blocks are permuted, and the shards take consecutive runs of that permutation, so
no block is drawn twice; within a shard documents are ordered by hash.

A multivariate draw is itself a tree of univariate ones over halves of the list of sources, each with
a seed of its own. So a task draws what lies on the way of its own blocks, and nothing of the size of
shards x sources is made or sent. One narrow pass counts sources; the wide pass is one scan and one
shuffle by shard, whose sizes are equal whatever the sources' sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import fresh, row_hash, without

MAX_SOURCES = 1_000_000  # their names and counts go through the driver to every task: 100 MB or so
_EXACT = 10**9  # numpy draws from fewer than so many
_KEPT = 2_000_000  # draws that a worker remembers


def block_quotas(blocks: np.ndarray, weights: np.ndarray, least: int = 0) -> np.ndarray:
    """The blocks to take from each source: shares as the weights, the total as large as the
    supply allows, whole by largest remainders (ties to the first source). If that total is under
    least, it is least (or all there is): sources that cannot meet their share give all they have,
    and the rest is spread over the others by weight."""
    w = np.where(blocks > 0, np.maximum(weights, 0), 0).astype(float)
    if not w.sum():
        return np.zeros(len(blocks), np.int64)
    w /= w.sum()
    total = int(np.floor((blocks[w > 0] / w[w > 0]).min() + 1e-9))
    total = max(total, min(least, int(blocks[w > 0].sum())))
    full = np.zeros(len(blocks), bool)
    while True:
        spread = np.where(full, 0, w)
        exact = np.where(full, blocks, spread / max(spread.sum(), 1e-300) * (total - int(blocks[full].sum())))
        over = ~full & (exact > blocks + 1e-9)
        if not over.any():
            break
        full |= over
    q = np.floor(exact + 1e-9).astype(np.int64)
    rest = total - int(q.sum())
    order = np.argsort(-(exact - q), kind="stable")
    for k in [k for k in order if w[k] > 0 and q[k] < blocks[k]][:rest]:
        q[k] += 1
    return np.minimum(q, blocks)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """Stirling's series for n over 10^6, to which the error is under 10^-30; the table below it."""
    n = np.asarray(n, float)
    x = np.maximum(n, 256) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 256, _TABLE[np.clip(n, 0, 255).astype(int)], series)


_TABLE = np.array([math.lgamma(k + 1) for k in range(256)])


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n draws without replacement are good. From populations beyond numpy's reach by the
    inverse of the distribution within 12 standard deviations (the rest is under 10^-30)."""
    if good + bad < _EXACT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    mean = n * (good / total)
    sd = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1))) + 1
    k = np.arange(max(0, n - bad, int(mean - 12 * sd)), min(n, good, int(mean + 12 * sd)) + 1)
    lp = -sum(_log_factorial(x) for x in (k, good - k, n - k, bad - n + k))
    cdf = np.cumsum(np.exp(lp - lp.max()))
    return int(k[min(np.searchsorted(cdf, rng.random() * cdf[-1], "right"), len(k) - 1)])


class SplitTree:
    """Which shard takes each block, for exact quotas by source; all is drawn when it is asked for."""

    def __init__(self, quotas: np.ndarray, shards: int, seed: int) -> None:
        self.sum = np.concatenate([[0], np.cumsum(quotas)])
        self.shards, self.seed = shards, seed
        self.drawn: dict[tuple[int, int, int, int], int] = {}

    def before(self, shard: int) -> int:
        """The blocks of all shards before this one; they are of equal size within one."""
        each, more = divmod(int(self.sum[-1]), self.shards)
        return shard * each + min(shard, more)

    def _draw(self, node: tuple[int, int], span: tuple[int, int], good: int, bad: int, n: int) -> int:
        key = (*node, *span)
        if key not in self.drawn:
            if len(self.drawn) >= _KEPT:
                self.drawn.clear()
            self.drawn[key] = hypergeometric(good, bad, n, np.random.default_rng([self.seed, *key]))
        return self.drawn[key]

    def _halves(self, node: tuple[int, int], spans: list[tuple[int, int]], have: list[int]) -> list[int]:
        """The left half's blocks of the nested spans of sources, of which the node has have."""
        mid = (node[0] + node[1]) // 2
        left = [self.before(mid) - self.before(node[0])]
        for (a, b), inner, all_, part in zip(spans, spans[1:], have, have[1:]):
            first = inner[0] == a and inner[1] == (a + b) // 2
            good = part if first else all_ - part
            x = self._draw(node, (a, b), good, all_ - good, left[-1])
            left.append(x if first else left[-1] - x)
        return left

    def shard_of(self, source: int, places: np.ndarray) -> np.ndarray:
        """The shards of a source's blocks, by their places (below its quota) in its permutation."""
        spans = [(0, len(self.sum) - 1)]
        while spans[-1][1] - spans[-1][0] > 1:
            a, b = spans[-1]
            m = (a + b) // 2
            spans.append((a, m) if source < m else (m, b))
        out = np.zeros(len(places), np.int64)
        todo = [((0, self.shards), [int(self.sum[b] - self.sum[a]) for a, b in spans], 0, np.arange(len(places)))]
        while todo:
            (lo, hi), have, base, at = todo.pop()
            if not len(at):
                continue
            if hi - lo == 1:
                out[at] = lo
                continue
            left = self._halves((lo, hi), spans, have)
            mid, first = (lo + hi) // 2, places[at] - base < left[-1]
            todo += [((lo, mid), left, base, at[first]), ((mid, hi), [x - y for x, y in zip(have, left)], base + left[-1], at[~first])]
        return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) blocks: rows sum to equal sizes (within one), columns to the quotas."""
    tree = SplitTree(quotas, shards, seed)
    return np.stack([np.bincount(tree.shard_of(k, np.arange(q)), minlength=shards) for k, q in enumerate(quotas)], 1)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1, applied to x: four Feistel rounds, walked until within n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([key, n]).integers(1, 2**63, 4, dtype=np.uint64)
    y = x.astype(np.uint64)
    out = np.zeros(len(x), np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = y >> np.uint64(half), y & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) & mask
        y = left << np.uint64(half) | right
        done = y < np.uint64(n)
        out[todo[done]] = y[done].astype(np.int64)
        todo, y = todo[~done], y[~done]
    return out


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    source: str = "source",
    block_docs: int = 8,
    docs_per_shard: int = 4096,
    seed: int = 11,
    least_share: float = 0.0,
) -> DataFrame:
    """The drawn rows of docs, all their columns, and mix_shard and mix_pos (from 0, within it).

    A source's share of the drawn blocks is its weight's, exactly up to rounding; blocks hold
    block_docs documents on average, so shares of documents follow closely. The total is the largest
    at which no source gives more than it has, or least_share of the blocks of the sources with a
    weight if that is more; then sources too small for their share give all they have, and the
    others make up for them by weight. A null source is a source of its own, named "" in
    weights along with the empty one. Sources of weight 0 or less give nothing; if all do, or docs is
    empty, no rows result. Repeated rows fall into one block and are kept or dropped together; their
    order is a tie between equal rows. Null or empty texts are documents like others. A column named
    mix_shard or mix_pos gives way; columns of any type are kept and tell rows apart. The result does
    not depend on how docs is partitioned. Over MAX_SOURCES sources are an error: group them first.
    """
    docs = without(docs, "mix_shard", "mix_pos")
    src, h = fresh(docs, "__src"), fresh(docs, "__h")
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    found = docs.groupBy(name.alias("s")).count().orderBy("s").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: group them first")
    names = [x.s for x in found]
    blocks = np.array([-(-x["count"] // block_docs) for x in found], np.int64)
    weight = np.array([(weights or {}).get(s, default_weight) for s in names])
    quotas = block_quotas(blocks, weight, int(np.ceil(least_share * int(blocks[weight > 0].sum()) - 1e-9)))
    shards = max(1, -(-int(quotas.sum()) * block_docs // docs_per_shard))
    plan = docs.sparkSession.sparkContext.broadcast(({s: k for k, s in enumerate(names)}, blocks, quotas, SplitTree(quotas, shards, seed)))

    @F.pandas_udf("int")
    def shard_of(names: pd.Series, hashes: pd.Series) -> pd.Series:
        at, blocks, quotas, tree = plan.value
        codes, seen = pd.factorize(names)
        out = np.full(len(names), -1, np.int32)
        for c, s in enumerate(seen):
            k, rows = at[s], np.flatnonzero(codes == c)
            place = permuted(hashes.to_numpy()[rows] % blocks[k], int(blocks[k]), seed + k)
            drawn = place < quotas[k]
            out[rows[drawn]] = tree.shard_of(k, place[drawn])
        return pd.Series(out)

    rows = docs.withColumn(src, name).withColumn(h, row_hash(docs, seed))
    rows = rows.withColumn("mix_shard", shard_of(src, h)).where("mix_shard >= 0")
    order = Window.partitionBy("mix_shard").orderBy(F.xxhash64(h, F.lit(seed + 1)))
    return rows.withColumn("mix_pos", (F.row_number().over(order) - 1).cast("int")).drop(src, h)
