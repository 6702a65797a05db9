from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F
from textlake.llm import mixing, queries

from .cases import empty, odd, rows

SCHEMA = "doc_id bigint, text string, source string"


def made(spark, sizes):
    data, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            data.append((k, f"text {k}", s))
            k += 1
    return spark.createDataFrame(data, SCHEMA)


def test_quotas_follow_the_weights():
    q = mixing.block_quotas(np.array([100, 100, 10, 0]), np.array([2.0, 1.0, 0.5, 9.0]))
    assert q.tolist() == [40, 20, 10, 0]
    assert mixing.block_quotas(np.array([5, 5]), np.array([0.0, -1.0])).tolist() == [0, 0]
    q = mixing.block_quotas(np.array([10, 10, 10]), np.array([1.0, 1.0, 1.0]))
    assert q.tolist() == [10, 10, 10]


@pytest.mark.parametrize("shards", [1, 2, 3, 7, 16])
def test_tree_splits_exactly(shards):
    quotas = np.array([40, 0, 21, 7])
    for seed in range(20):
        t = mixing.split_tree(quotas, shards, seed)
        assert (t >= 0).all() and t.sum(0).tolist() == quotas.tolist() and np.ptp(t.sum(1)) <= 1


def test_tree_draws_hypergeometrically():
    quotas, shards, n = np.array([30, 10, 20]), 4, 3000
    t = np.stack([mixing.split_tree(quotas, shards, s) for s in range(n)])
    share, size, total = quotas / 60, 15, 60
    variance = size * share * (1 - share) * (total - size) / (total - 1)
    assert np.abs(t.mean(0) - size * share).max() < 5 * np.sqrt(variance.max() / n)
    assert np.abs(t.var(0) - variance).max() < 0.15 * variance.max()


@pytest.mark.parametrize("n", [1, 2, 3, 8, 100, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert n < 100 or mixing.permuted(np.arange(n), n, 5).tolist() != list(range(n))


def test_whole_blocks_land_once(spark):
    docs = made(spark, {"a": 400, "b": 300, "c": 60})
    out = mixing.mix_sources(docs, {"a": 2.0}, block_docs=4, docs_per_shard=50).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and out[0].__fields__ == ["doc_id", "text", "source", "mix_shard", "mix_pos"]
    # 100, 75 and 15 blocks at 2:1:1 make 30, 15 and 15
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", mixing.row_hash(docs, 11).alias("h")).collect()}
    blocks = {"a": 100, "b": 75, "c": 15}
    drawn = defaultdict(set)
    for r in out:
        drawn[r.source].add((hashed[r.doc_id] % blocks[r.source], r.mix_shard))
    for s, quota in (("a", 30), ("b", 15), ("c", 15)):
        here = {b for b, _ in drawn[s]}
        assert len(drawn[s]) == len(here) <= quota  # no block in two shards; a block may hold no document
        every = {r.doc_id for r in docs.where(F.col("source") == s).collect() if hashed[r.doc_id] % blocks[s] in here}
        assert every == {r.doc_id for r in out if r.source == s}
    count = Counter(r.source for r in out)
    assert abs(count["a"] - 120) < 40 and abs(count["b"] - 60) < 25 and count["c"] == 60
    by = defaultdict(list)
    for r in out:
        by[r.mix_shard].append(r)
    assert len(by) == 5
    for shard in by.values():
        assert sorted(r.mix_pos for r in shard) == list(range(len(shard)))
    order = [r.doc_id for r in sorted(by[0], key=lambda r: r.mix_pos)]
    assert order != sorted(order)


def test_layout_plays_no_part(spark):
    docs = made(spark, {"a": 50, "b": 90})
    assert rows(mixing.mix_sources(docs.repartition(5), {"b": 3.0})) == rows(mixing.mix_sources(docs.coalesce(1), {"b": 3.0}))


def test_odd_rows(spark):
    df = odd(spark).selectExpr("*", "'x' AS mix_pos", "7 AS __src")
    out = mixing.mix_sources(df, block_docs=1)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__src", "mix_shard", "mix_pos"]
    given = rows(odd(spark))
    assert all(x[:5] in given for x in map(tuple, out.collect()))
    assert mixing.mix_sources(odd(spark), {"": 1.0}, 0.0, block_docs=1).where("source <> ''").count() == 0
    assert mixing.mix_sources(odd(spark), {}, 0.0).collect() == []
    assert mixing.mix_sources(empty(spark)).collect() == []
    twice = [(r.doc_id, r.mix_shard) for r in mixing.mix_sources(df, block_docs=1, docs_per_shard=1).where("doc_id = 2").collect()]
    assert len(set(twice)) <= 1  # repeated rows stay together


def test_a_scarce_source_does_not_shrink_the_rest(spark):
    blocks, weights = np.array([100, 100, 1, 0, 7]), np.array([2.0, 1.0, 1.0, 1.0, 0.0])
    assert mixing.block_quotas(blocks, weights).tolist() == [2, 1, 1, 0, 0]
    assert mixing.block_quotas(blocks, weights, 100).tolist() == [66, 33, 1, 0, 0]
    assert mixing.block_quotas(blocks, weights, 190).tolist() == [100, 89, 1, 0, 0]
    assert mixing.block_quotas(blocks, weights, 999).tolist() == [100, 100, 1, 0, 0]
    sizes = {"src0": 400, "src1": 400, "tiny": 1, None: 1}
    out = Counter(r.source for r in mixing.mix_sources(made(spark, sizes), queries.SOURCE_WEIGHTS, least_share=queries.MIX_LEAST_SHARE).collect())
    assert out["tiny"] == out[None] == 1
    assert sum(out.values()) >= 350 and 1.5 < out["src0"] / out["src1"] < 2.6


def test_the_query_draws_half_at_least(spark, tmp_path):
    docs = made(spark, {"src0": 400, "src1": 400, "tiny": 1, None: 1})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op2_mix_sources"](spark, str(tmp_path)).count() >= 350


def test_many_shards_and_sources():
    quotas = np.full(5000, 2_000_000)
    tree = mixing.SplitTree(quotas, 12_000, 5)
    places = np.random.default_rng(1).integers(0, 2_000_000, 200)
    found = tree.shard_of(4321, places)
    assert (tree.shard_of(4321, np.sort(places)) == np.sort(found)).all()  # shards take consecutive runs
    assert abs(found / 12_000 - places / 2_000_000).max() < 0.01  # with equal shares
    assert len(tree.drawn) < 200 * 14 * 14  # only what lies on the way


def test_the_large_draws_follow_the_distribution(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(mixing, "_EXACT", 0)
    for good, bad, n in ((30, 50, 20), (4000, 100, 3900), (1, 5, 3), (0, 9, 4), (9, 0, 4), (600, 600, 600)):
        x = np.array([mixing.hypergeometric(good, bad, n, rng) for _ in range(4000)])
        p = good / (good + bad)
        var = n * p * (1 - p) * (good + bad - n) / max(good + bad - 1, 1)
        assert x.min() >= max(0, n - bad) and x.max() <= min(n, good)
        assert abs(x.mean() - n * p) <= 5 * np.sqrt(var / 4000) and abs(x.var() - var) <= 0.15 * var
    big = [mixing.hypergeometric(4 * 10**9, 6 * 10**9, 10**9, rng) for _ in range(200)]
    assert abs(np.mean(big) - 4e8) < 5 * np.sqrt(1e9 * 0.4 * 0.6 * 0.9 / 200)


def test_columns_of_all_types_tell_rows_apart(spark):
    df = spark.range(64).selectExpr("1 AS doc_id", "'t' AS text", "'a' AS source", "cast(id AS decimal(20, 2)) AS d", "map('k', id) AS m", "cast('2024-01-01' AS timestamp_ntz) AS w")
    out = mixing.mix_sources(df, block_docs=1, docs_per_shard=8)
    assert len({r.mix_shard for r in out.collect()}) > 3 and out.columns == [*df.columns, "mix_shard", "mix_pos"]
    assert len({r[0] for r in df.drop("d").select(mixing.row_hash(df.drop("d"))).collect()}) == 64


def test_empty_columns_of_quotas(spark):
    assert mixing.split_tree(np.array([0, 0]), 3, 1).sum() == 0
    assert mixing.split_tree(np.array([5]), 1, 1).tolist() == [[5]]
