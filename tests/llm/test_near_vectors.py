import numpy as np
import pytest

from textlake.llm import near_vectors as nv

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def made(seed, n, d, copies):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[:copies] = x[n - copies :] + r.normal(size=(copies, d)) * r.uniform(0.05, 0.6, (copies, 1))
    return (x * r.uniform(0.1, 30, (n, 1))).astype(np.float32)


def brute(x, threshold):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = y @ y.T
    return {(i, j): c[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= threshold}


def links(n, pairs):
    """(id, least id of its group, links) of the numbers below n."""
    low = list(range(n))
    for _ in range(n):
        before = list(low)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            break
    return [(k, low[k], sum(k in p for p in pairs)) for k in range(n)]


@pytest.mark.parametrize(("threshold", "d", "block"), [(0.9, 64, 50), (0.5, 8, 1000), (0.95, 1100, 40), (0.2, 3, 60)])
def test_all_links(spark, threshold, d, block):
    x = made(3, 150, d, 60)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    found = nv.near_links(df, threshold, block=block)
    assert found.columns == ["vec_id", "class_id", "n_links"]
    real = brute(x, threshold)
    assert sorted(tuple(r) for r in found.collect()) == links(150, list(real)) and len(real) > 5


def test_many_keys_shuffle_the_same(spark, monkeypatch):
    from textlake.llm import common

    x = made(5, 80, 16, 30)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in nv.near_links(df, 0.8, block=30).collect()) == links(80, list(brute(x, 0.8)))


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_rule_out(seed):
    x = made(seed, 200, 32, 50).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = nv.quantise(x)
    maybe = {(i, j): s for a, b, sure in nv.possible_pairs(side, side, 0.8, True) for i, j, s in zip(a.tolist(), b.tolist(), sure.tolist())}
    real = brute(x, 0.8).keys()
    assert real <= maybe.keys() and len(maybe) < len(real) + 60
    certain = {k for k, s in maybe.items() if s}
    assert certain <= real and len(certain) > len(real) - 60


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [nan, 1.0], 0),
        (7, [inf, 1.0], 0), (8, [1.0, None], 0), (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [0.0, 1.0], 0), (10, [1.0, 0.001], None), (11, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' AS q", "1 AS b", "2 AS err")
    found = sorted(tuple(r) for r in nv.near_links(df, 0.9).collect())
    assert found == [(1, 1, 2), (2, 1, 2), *((k, k, 0) for k in range(3, 10)), (10, 1, 0), (10, 1, 2), (11, 11, 0)]
    kept = sorted((r.vec_id is None, r.vec_id or 0) for r in nv.drop_near_copies(df, 0.9).collect())
    assert [k for n, k in kept if not n] == [1, 3, 4, 5, 6, 7, 8, 9, 11] and kept[-1] == (True, 0)


def test_empty_and_wrong(spark):
    assert nv.near_links(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        nv.near_links(spark.createDataFrame([], SCHEMA), 0)
