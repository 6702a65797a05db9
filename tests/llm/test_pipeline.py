"""The pipeline against plain versions of its stages, none of which uses an operator."""

import math

import numpy as np
import sentencepiece

import corpus_pipeline
from pyspark.sql import functions as F
from textlake.llm import langid, mixing, queries, sentencepiece_sa
from textlake.llm.common import hash_u63, row_hash

from .cases import empty, odd
from .test_langid import plain
from .test_ngram_join import brute

NAMES = ["language ID", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def words(text):
    return " ".join("".join(c if c.isalpha() or c in "̧̀́̈̃" else " " for c in (text or "").lower()).split())


def languages(rows, hashes):
    """The language of each text, or none: models of the sample on dicts."""
    texts, held = {}, {}
    for lang in sorted({r["lang"] for r in rows if r["lang"]}):
        own = sorted({r["text"] for r in rows if r["lang"] == lang and (r["text"] or "").strip(" ")}, key=hashes.get)[:600]
        if own:
            texts[lang] = langid.trusted([t for k, t in enumerate(own) if (k + 1) % 3 or k + 1 > 600])
            held[lang] = [t for k, t in enumerate(own) if not (k + 1) % 3 and k + 1 <= 600]
    bits, limits, out = {}, {}, {}
    for lang in texts:
        bits[lang] = plain([words(t) for t in texts[lang]])
        ce, n, within = [], [], []
        for t in held[lang] or texts[lang]:
            if words(t):
                ce.append(bits[lang](words(t)))
                n.append(len(words(t)) + 1)
                within.append(bits[lang](words(t), square=True))
        ce, n = np.array(ce), np.array(n)
        mean = np.median(ce)
        var_char = 3 * max(1e-6, np.average(within, weights=n) - np.average(ce, weights=n) ** 2)
        var_text = (1.4826 * np.median(abs(ce - mean))) ** 2
        z = (ce - mean) / np.sqrt(var_char / n + var_text + 1e-9)
        limits[lang] = mean, var_char, var_text, max(8, 1.5 * np.quantile(z, langid.CLEAN)), max(3 * mean, 1.5 * np.quantile(ce, langid.CLEAN))
    calibrated = {lang: [words(t) for t in held[lang] or texts[lang] if words(t)] for lang in texts}
    for lang in texts:
        noise = [t for t in langid.shuffled(held[lang] or texts[lang]) if t]
        least = min(np.median([bits[lang](t) for t in (noise if other == lang else calibrated[other])]) for other in texts)
        limits[lang] = (limits[lang][0] + least) / 2, *limits[lang]
    for t in {r["text"] for r in rows}:
        out[t] = None
        if words(t):
            ce, lang = min((bits[lang](words(t)), lang) for lang in bits)
            near, mean, var_char, var_text, limit, ceiling = limits[lang]
            if (ce <= near or (ce - mean) / math.sqrt(var_char / (len(words(t)) + 1) + var_text + 1e-9) <= limit) and ce <= ceiling:
                out[t] = lang
    return out


def mixed(rows, hashes, weights, least, block=8, per_shard=4096, seed=11):
    """The rows drawn: blocks by hash, quotas by hand, places by the permutation."""
    count = {}
    for r in rows:
        count[r["source"] or ""] = count.get(r["source"] or "", 0) + 1
    names = sorted(count)
    blocks = {s: -(-count[s] // block) for s in names}
    weight = {s: weights.get(s, 1.0) for s in names}
    total = min(int(blocks[s] * sum(weight.values()) / weight[s] + 1e-9) for s in names)
    total = max(total, min(math.ceil(least * sum(blocks.values()) - 1e-9), sum(blocks.values())))
    full = set()
    while True:  # sources that cannot meet their share give all they have
        rest, w = total - sum(blocks[s] for s in full), sum(weight[s] for s in names if s not in full)
        exact = {s: blocks[s] if s in full else weight[s] / w * rest for s in names}
        over = {s for s in names if s not in full and exact[s] > blocks[s] + 1e-9}
        if not over:
            break
        full |= over
    quota = {s: math.floor(exact[s] + 1e-9) for s in names}
    left = total - sum(quota.values())
    for s in sorted(names, key=lambda s: -(exact[s] - quota[s])):
        if left and quota[s] < blocks[s]:
            quota[s] += 1
            left -= 1
    place = {s: mixing.permuted(np.arange(blocks[s]), blocks[s], seed + k) for k, s in enumerate(names)}
    return [r for r in rows if place[r["source"] or ""][hashes[r["doc_id"]] % blocks[r["source"] or ""]] < quota[r["source"] or ""]]


def test_against_a_brute_force_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(9001, "12345 ###", "en", "src0", 9), (9002, None, None, None, None), (9003, "привет как дела сегодня вечером", "en", None, 1)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES

    # 1: rows whose text the models recognise
    rows = [r.asDict() for r in docs.collect()]
    hashes = {r.text: r.h for r in docs.select("text", hash_u63("text", seed=7).alias("h")).collect()}
    said = languages(rows, hashes)
    one = [r | {"lang": said[r["text"]]} for r in rows if said[r["text"]]]
    got = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert got.columns == columns
    assert sorted(map(repr, (r.asDict() for r in got.collect()))) == sorted(map(repr, one))
    assert not {9001, 9002, 9003} & {r["doc_id"] for r in one} and len(one) > 0.95 * len(rows)

    # 2: the least id of each group of pairs
    parent = {r["doc_id"]: r["doc_id"] for r in one}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in brute([(r["doc_id"], r["text"]) for r in one]):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    two = [r for r in one if root(r["doc_id"]) == r["doc_id"]]
    frame = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(one, docs.schema), str(tmp_path))
    assert frame.columns == columns
    assert sorted(r.doc_id for r in frame.collect()) == sorted(r["doc_id"] for r in two)

    # 3: the draws for the weights
    df = spark.createDataFrame(two, docs.schema)
    drawn = corpus_pipeline.STAGES[2][1](spark, df, str(tmp_path))
    assert drawn.columns == columns
    three = {r.doc_id: r.text for r in drawn.collect()}
    keys = {r.doc_id: r.h for r in df.select("doc_id", row_hash(df, 11).alias("h")).collect()}
    assert set(three) == {r["doc_id"] for r in mixed(two, keys, queries.SOURCE_WEIGHTS, queries.MIX_LEAST_SHARE)} and three

    # 4 and the whole: the library's ids of what is left
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in out} == {k: sp.encode(t) for k, t in three.items()}
    assert len(out) == len(three) and all(r.decoded == three[r.doc_id] and r.n_pieces == len(r.ids) for r in out)


def test_odd_tables_pass_all_stages(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = known.unionByName(known.limit(3)).unionByName(odd(spark)).unionByName(spark.createDataFrame([(None, known.first().text, "en", None, 1)], known.schema))
    names = {"mix_shard": F.lit("x"), "mix_pos": F.lit(1), "words": F.lit(2), "h": F.lit(3), "ids": F.lit(4), "class": F.lit(5), "__tid": F.lit(6), "tile": F.lit(7)}
    docs = docs.withColumns(names)
    for start in (docs, empty(spark).withColumns(names)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == start.columns
            found = now.collect()
            assert {(r.mix_shard, r.mix_pos, r.tile) for r in found} <= {("x", 1, 7)}
            now = spark.createDataFrame(found, now.schema)
        out = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
        assert len(out) == now.count() and bool(out) == bool(start.count())
        given = [(r.doc_id, r.decoded) for r in out if r.doc_id is not None]
        assert len(given) == len(set(given))  # repeated rows are copies
