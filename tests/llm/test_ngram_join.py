import random
import re

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from textlake.llm import components
from textlake.llm import ngram_join as nj
from textlake.llm.components import connected_components

from .cases import empty, odd, odd_rows, prose, rows


def grams(text, n=nj.N):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(data, threshold=nj.THRESHOLD, n=nj.N):
    sets = [(d, grams(t, n)) for d, t in data if d is not None]
    out = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and x and y and (j := len(x & y) / len(x | y)) >= threshold:
                k = min(a, b), max(a, b)
                out[k] = max(out.get(k, 0), j)
    return out


def found(df, **k):
    """The pairs, those within classes included: best jaccard of each two ids."""
    seen, pairs = nj.described_classes(df, **k)
    ids = {}
    for r in seen.where("class is not null").collect():
        ids.setdefault(r["class"], set()).add(r.doc_id)
    out = {}
    for a, b, j in [*((c, c, 1.0) for c in ids), *map(tuple, pairs.collect())]:
        for x in ids[a]:
            for y in ids[b]:
                if x != y:
                    out[min(x, y), max(x, y)] = max(j, out.get((min(x, y), max(x, y)), 0))
    return out


def links(data):
    """What the join returns, by brute force: documents are distinct (doc_id, words)."""
    docs = sorted({(d, tuple(re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower()))) for d, t in data if d is not None})
    sets = [grams(" ".join(w)) for _, w in docs]
    near = [[i != j and bool(x) and bool(y) and len(x & y) / len(x | y) >= nj.THRESHOLD for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    out = []
    for i, (d, w) in enumerate(docs):
        group, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j, n in enumerate(near[k]) if n} - group
            group |= new
            todo += new
        out.append((d, min(docs[j][0] for j in group), sum(near[i][j] and docs[j][1] == w for j in range(len(docs))), sum(near[i])))
    return sorted(out)


def joined(df):
    return sorted(tuple(r) for r in nj.ngram_jaccard_join(df).collect())


def near(seed, groups=25, alone=60):
    r = random.Random(seed)
    data = [(k, prose(1000 + seed * 7919 + k, r.randint(3, 200))) for k in range(alone)]
    for g in range(groups):
        base = prose(seed * 104729 + g, r.randint(4, 150)).split(" ")
        for _ in range(r.randint(2, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"new{r.random()}"
            data.append((len(data), " ".join(w)))
    shared = prose(77, 60)
    data += [(len(data) + k, shared + " " + prose(9000 + k, 150)) for k in range(30)]
    r.shuffle(data)
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_exactness(spark, seed):
    data = near(seed)
    real = brute(data)
    ours = found(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert ours.keys() <= real.keys() and len(ours) >= 0.97 * len(real) > 50
    assert all(abs(ours[k] - real[k]) < 1e-8 for k in ours)


def test_links_and_classes(spark):
    data = near(5, 12, 20)
    assert joined(spark.createDataFrame(data, "doc_id bigint, text string")) == links(data)


def test_groups_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE_CHARS", 4000)
    base = prose(5, 100)
    data = [(k, base + f" tail{k}") for k in range(40)] + [(100 + k, base + " tail1") for k in range(5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert found(df).keys() == brute(data).keys()
    assert joined(df) == links(data)


def test_a_long_chain_and_hot_buckets_in_parts(spark, monkeypatch):
    words = prose(6, 700).split(" ")
    chain = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(200)]  # each like the few before and behind it
    hot = [(500 + k, prose(8, 80) + f" tail{k}") for k in range(50)]
    df = spark.createDataFrame(chain + hot, "doc_id bigint, text string")
    real = brute(chain + hot)
    monkeypatch.setattr(nj, "BUCKET", 8)
    monkeypatch.setattr(nj, "TILE_CHARS", 6000)
    ours = found(df)
    assert ours.keys() <= real.keys() and len(ours) >= 0.97 * len(real)


def test_verifies_no_more_than_the_bands_bring_together(spark, monkeypatch):
    parts = [prose(300 + k, 30) for k in range(60)]
    r = random.Random(4)
    data = [(k, " ".join(r.sample(parts, 10))) for k in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    bands, rows_ = nj.bands_for(nj.THRESHOLD, nj.RECALL)
    held = {}
    for d, t in data:
        g, off, _ = nj.grams(nj.pa.array([t]), nj.N)
        for h in nj.signatures(g, off, bands, rows_)[0][0].tolist():
            held.setdefault(h, set()).add(d)
    candidates = {(a, b) for x in held.values() for a in x for b in x if a < b}
    assert len(candidates) > 300
    one = nj.cut(nj._described(df.withColumn("tid", F.col("doc_id")), nj.N, bands, rows_))
    edges = nj._candidates(one, nj._buckets(one), nj.sketch_cut(nj.THRESHOLD, bands * rows_))
    sizes = [r["count"] for r in connected_components(edges).groupBy("component").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < len(candidates) // 4  # all pairs of the components
    assert joined(df) == links(data)


def test_sketches_rule_out_few():
    for threshold in (0.3, 0.6, 0.95):
        least = nj.sketch_cut(threshold, 104)
        r = random.Random(3)
        short = sum(sum(r.random() < threshold for _ in range(104)) < least for _ in range(20_000))
        assert short <= 12 and least > 104 * threshold - 30
    assert nj.sketch_cut(1.0, 104) == 104


def test_odd_rows(spark):
    df = odd(spark).selectExpr("*", "'x' AS words", "1 AS tile", "2 AS component", "3 AS bands", "4 AS class", "5 AS tid")
    assert joined(df) == links([(r[0], r[1]) for r in odd_rows()])
    assert nj.ngram_jaccard_join(df).columns == ["doc_id", "class_id", "n_copies", "n_links"]
    assert joined(empty(spark)) == []
    assert joined(odd(spark).where("doc_id = 9")) == [(9, 9, 0, 0)]


def test_ids_on_several_texts(spark):
    a, b = prose(1, 50), prose(2, 50)
    data = [(1, a), (1, b), (2, a), (2, a), (3, b + " more"), (4, a), (5, None), (5, ""), (None, a)]
    assert joined(spark.createDataFrame(data, "doc_id bigint, text string")) == links(data)


def test_a_hot_id(spark):
    data = [(1, prose(40 + k // 2, 40)) for k in range(600)]
    assert joined(spark.createDataFrame(data, "doc_id bigint, text string")) == links(data)


def test_one_of_each_stays(spark):
    data = near(3, 15, 20)
    parent = {k: k for k, _ in data}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in found(spark.createDataFrame(data, "doc_id bigint, text string")):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("__gone", F.lit(1))
    kept = nj.keep_one_of_each(df)
    assert kept.columns == ["doc_id", "text", "__gone"]
    assert [r[0] for r in rows(kept, "doc_id")] == sorted((k for k in parent if root(k) == k), key=lambda k: repr((k,)))


def test_one_of_each_of_odd_rows(spark):
    kept = nj.keep_one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 4, 5, 6, None, None, 7, 8, 8, 9], key=repr)
    assert nj.keep_one_of_each(empty(spark)).collect() == []


def test_many_keys_shuffle_the_same(spark, monkeypatch):
    data = near(4, 10, 10)
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    before = joined(df), rows(nj.keep_one_of_each(df))
    from textlake.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert (joined(df), rows(nj.keep_one_of_each(df))) == before


def test_bands_reach_the_recall():
    for threshold in (0.3, 0.6, 0.9, 1.0):
        b, r = nj.bands_for(threshold, 0.97)
        assert 1 - (1 - threshold**r) ** b >= 0.97


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.component for r in connected_components(df).collect()} == {k: root(k) for k in parent}
    assert connected_components(df.limit(0)).collect() == []


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 0)
    test_components(spark)


def test_texts_under_one_id_are_no_copies(spark):
    a, b, c, d = (prose(k, 60) for k in (1, 2, 3, 4))
    data = [(1, a), (1, b), (1, None), (1, ""), (2, c), (2, a), (2, c), (2, c), (3, b + " more"), (3, d), (4, d + " !"), (5, a), (None, a)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    stays = sorted([(1, a), (1, b), (1, None), (1, ""), (2, c), (3, d), (None, a)], key=repr)
    assert rows(corpus_pipeline.drop_near_copies(spark, df, "")) == stays
    kept = corpus_pipeline.drop_near_copies(spark, odd(spark), "")
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, None, None, 7, 8, 8, 9], key=repr)
    assert corpus_pipeline.drop_near_copies(spark, empty(spark), "").collect() == []
