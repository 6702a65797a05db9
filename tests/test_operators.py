import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from textlake.operators import dedup, ir, passages, profile, retrieval, rules

HINDI = "गेहूँ की बुवाई के लिए सबसे अच्छा समय कौन सा है?"
LONG = "गेहूँ की बुवाई नवंबर के पहले सप्ताह में करनी चाहिए और खेत को अच्छी तरह तैयार करके बीज को सही गहराई पर बोना चाहिए।"


def test_each_reason(spark):
    cases = [
        ("", LONG, "empty_question"), (None, LONG, "empty_question"), (HINDI, None, "empty_positive"), ("क्या है?", LONG, "short_question"), ("क " * 41 + "?", LONG, "long_question"), (HINDI, "बहुत छोटा", "short_positive"),
        ("what is this thing?", LONG, "no_hindi"), (HINDI[:-1], LONG, "missing_question_mark"), ("क्या? यह? सही? है?", LONG, "multiple_question_marks"), (HINDI.replace("गेहूँ", "गे■"), LONG, "ocr_garbage"),
        (LONG.replace("।", "?"), LONG.replace("।", ""), "question_equals_positive"), ("क क क क क?", LONG, None), ("क्या ? क्या ? है यह ?", LONG, "multiple_question_marks"), (HINDI, LONG, None), (" " + HINDI.replace(" ", "  "), LONG + " फिर", "duplicate_question"),
    ]
    df = spark.createDataFrame([(k, q, p) for k, (q, p, _) in enumerate(cases)], "ord int, question string, positive string")
    found = {r.ord: r.remove_reason for r in rules.filter_pairs(df.repartition(3), ["ord"]).collect()}
    assert [found[k] for k in range(len(cases))] == [r for *_, r in cases]
    repeated = spark.createDataFrame([(0, "क? क? क? क?", LONG)], "ord int, question string, positive string")
    assert rules.filter_pairs(repeated, ["ord"], most_marks=9).first().remove_reason == "repeated_word"
    counts = rules.reason_counts(rules.filter_pairs(df, ["ord"])).collect()
    assert counts[0].n == 2 and sum(r.n for r in counts) == sum(r is not None for *_, r in cases)


def test_final_rules(spark):
    cases = [("यह योजना क्या है बताइए?", "x", "blacklisted"), ("छोटा?", "x", "too_short"), ("यह बड़ा बाँध कहाँ स्थित है?", "x", "bad_ending"), (HINDI, "१२३ab", "mostly_digits"), (HINDI, "", "mostly_digits"), (HINDI, None, "mostly_digits"), (HINDI, "दो लाख पौधे", "currency"), (HINDI, "ठीक", None), (None, "ठीक", "too_short")]
    df = spark.createDataFrame([(k, q, p) for k, (q, p, _) in enumerate(cases)], "k int, question string, positive string")
    assert [r.x for r in df.select("k", rules.first_reason(rules.final_rules()).alias("x")).orderBy("k").collect()] == [r for *_, r in cases]
    assert rules.first_reason([]) is not None
    optional = rules.subject_rules("question", "positive", "पौधे", "गेहूँ", "खेत")
    assert df.where("k = 6").select(rules.first_reason(optional).alias("x")).first().x == "unwanted"


def test_flags(spark):
    names = ["agriculture", "reusable", "question_answer_match", *rules.BAD_FLAGS]
    rows = [(0, True, True, True, *[False] * 5), (1, False, True, True, *[False] * 5), (2, True, True, False, *[False] * 5), (3, True, True, True, True, *[False] * 4), (4, None, True, True, *[False] * 5), (5, True, True, True, None, *[False] * 4), (6, *[None] * 8)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} boolean" for n in names))
    assert [r.x for r in df.select("k", rules.route_flags().alias("x")).orderBy("k").collect()] == ["KEEP", "REVIEW", "REMOVE", "REMOVE", "REVIEW", "KEEP", "REMOVE"]
    assert [r.k for r in df.where(rules.flag_mask()).orderBy("k").collect()] == [0, 1, 4]
    assert spark.sql("SELECT 'api_error: x' AS a, null AS b").select(rules.is_api_error("a", "b").alias("x")).first().x is True


def test_sample_positions(spark):
    sizes = [1, 2, 3, 4, 5, 20, 45, 99, 100, 148, 297]
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "g int, i int")
    found = Counter()
    kept = {}
    for r in dedup.systematic_sample(df.repartition(4), "g", ["i"]).collect():
        found[r.g] += 1
        kept.setdefault(r.g, set()).add(r.i)
    for n in sizes:
        k = max(2, math.ceil(0.45 * n))
        assert kept[n] == (set(range(n)) if n <= 2 else set(np.linspace(0, n - 1, k).astype(int).tolist()))


def test_keep_first_and_friends(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1), (4, None, 1), (5, None, 1)], "o int, k string, v int")
    assert sorted(r.o for r in dedup.keep_first(df, ["k"], ["o"]).collect()) == [1, 2, 4]
    assert sorted(r.o for r in dedup.repeats(df, ["k"]).collect()) == [1, 3, 4, 5]
    retry = spark.createDataFrame([(9, "a"), (7, "c")], "o int, k string")
    assert sorted((r.o, r.k) for r in dedup.union_primary(df.where("k IS NOT NULL"), retry, ["k"], ["o"]).collect()) == [(1, "a"), (2, "b"), (7, "c")]
    assert sorted(r.o for r in dedup.unprocessed(df, retry, "k").collect()) == [2, 4, 5]
    assert {r.k: r.first_seen for r in dedup.first_seen(df, "k", "o").collect()} == {"a": 1, "b": 2, None: 4}
    assert dedup.keep_first(df.limit(0), ["k"], ["o"]).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split(spark, n):
    df = spark.range(n).selectExpr("cast(id AS string) AS document_id").union(spark.sql("SELECT '0' AS document_id").limit(1 if n else 0))
    found = dedup.split_documents(df)
    c = Counter(r.split for r in found.collect())
    assert (c["train"], c["train"] + c["valid"]) == (int(0.8 * n), int((0.8 + 0.1) * n)) and sum(c.values()) == n
    rows = dedup.with_split(df, found)
    assert rows.count() == df.count() and dedup.leaked_documents(rows).collect() == []
    if n == 1000:
        other = {r.document_id: r.split for r in dedup.split_documents(df, seed=1).collect()}
        assert other != {r.document_id: r.split for r in found.collect()}


def test_legacy_split():
    found = dedup.legacy_split([str(k) for k in range(50)])
    order = np.array([str(k) for k in range(50)], object)
    np.random.RandomState(42).shuffle(order)
    assert [x for x, _ in found] == order.tolist() and Counter(s for _, s in found) == {"train": 40, "valid": 5, "test": 5}


@pytest.mark.parametrize("rows", [10, 1_000_000])
def test_batches(spark, monkeypatch, rows):
    monkeypatch.setattr(dedup, "RANGE_ROWS", rows)
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "o int, v int")
    assert {r.o: r.batch_id for r in dedup.assign_batches(df.repartition(5), 20, ["o"]).collect()} == {k: k // 20 for k in range(101)}


def test_batches_of_long_tables_are_ranked_in_parts(spark):
    found = dedup.assign_batches(spark.range(60_000).selectExpr("id * 7919 % 60000 AS o").repartition(5), 50, ["o"])
    assert found.where("batch_id = floor(o / 50)").count() == 60_000
    assert "aggregate(" in found._jdf.queryExecution().optimizedPlan().toString()  # each row is placed in one of several ranges


def test_profile(spark):
    n = [1, 1, 2, 3, 5, 8, 8, 15, 30, 2000]
    df = spark.createDataFrame([(f"d{g}",) for g, c in enumerate(n) for _ in range(c)], "k string")
    sizes = profile.group_sizes(df, "k")
    r = profile.describe(sizes, "n").first()
    assert (r.n, r.least, r.most) == (10, 1, 2000) and np.allclose([r.mean, r.std, r.p25, r.p50, r.p75], [np.mean(n), np.std(n, ddof=1), *np.percentile(n, [25, 50, 75])])
    assert [(x.bucket, x.n) for x in profile.histogram(sizes, "n").collect()] == [("1", 2), ("2-3", 2), ("4-6", 1), ("7-10", 2), ("11-20", 1), ("21-1000", 1)]
    assert [x.k for x in profile.largest(df, "k", 4).collect()] == ["d9", "d8", "d7", "d5"]


def test_passages(spark):
    text = " ".join(f"This is sentence number {k} of a long enough text." for k in range(60))
    df = spark.createDataFrame([("d1", text), ("d2", text), ("d3", "short"), ("d4", None)], "document_id string, text string")
    made = passages.passages(df).orderBy("chunk_index").collect()
    assert {r.document_id for r in made} == {"d1"} and [r.chunk_id for r in made] == [f"d1_chunk_{r.chunk_index}" for r in made]
    assert all(40 <= r.word_count <= 200 and r.char_count == len(r.chunk_text) for r in made)
    large = spark.createDataFrame([("a", 0, "x " * 10, 10), ("b", 1, "एक दो तीन चार पाँच छह! " * 90, 540)], "chunk_id string, chunk_index int, chunk_text string, word_count int")
    out = passages.rechunk_large(large).collect()
    assert [r.chunk_id for r in out][:2] == ["a", "b_fix0"] and all(r.word_count <= 200 for r in out) and {r.chunk_index for r in out} == {0, 1}
    joined = spark.createDataFrame([("क", "ख"), ("", "ख"), (None, None)], "summary string, content string").select(passages.document_text().alias("x")).collect()
    assert [r.x for r in joined] == ["क ख", "ख", ""]


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 6)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(k, v.tolist(), k % 5) for k, v in enumerate(x)] + [(500, None, 0), (501, [0.0] * 6, 0), (502, [1.0], 0), (None, [1.0] * 6, 0)], "vec_id bigint, embedding array<float>, label int")
    return x.astype(np.float64), df


@pytest.mark.parametrize("block", [7, 1000])
def test_search(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "_TILE", 16)
    x, df = vectors
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y[:20] @ y.T
    found = retrieval.search(df.where("vec_id < 20"), df.where("vec_id IS NULL OR vec_id <> 502").repartition(3), 4).collect()
    assert len(found) == 80
    for q in range(20):
        order = sorted(range(120), key=lambda c: (-round(s[q, c], 12), c))[:4]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.corpus_id for r in mine] == order and np.allclose([r.score for r in mine], s[q, order])
    assert retrieval.search(df.limit(0), df, 3).collect() == [] == retrieval.search(df.where("vec_id < 20"), df.limit(0), 3).collect()


def test_search_among_mixed_dimensions(spark, monkeypatch):
    r = np.random.default_rng(7)
    data = [(k, r.normal(size=d).tolist()) for k, d in enumerate([2, 3, 2, 3, 3, 2, 5, 2, 2, 3] * 3)] + [(90, None), (91, []), (92, [0.0, 0.0]), (93, [float("nan"), 1.0])]
    v = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    real = set()
    for a, x in data:
        near = sorted(((-np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y), b) for b, y in data if a < 90 and b < 90 and len(x) == len(y)))[:3]
        real |= {(a, b, n + 1) for n, (_, b) in enumerate(near)}
    for frame in (v, v.repartition(7), v.coalesce(1)):
        assert {(x.query_id, x.corpus_id, x["rank"]) for x in retrieval.search(frame, v, 3).collect()} == real
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 8)
    assert {(x.query_id, x.corpus_id, x["rank"]) for x in retrieval.search(v, v, 3).collect()} == real


@pytest.mark.parametrize("block", [100, 5000])
def test_search_scores_as_sql_does(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "_TILE", 90)
    x = np.tile(np.random.default_rng(3).normal(size=(150, 64)).astype(np.float32), (5, 1))
    x[50:60] *= np.float32(2.0**-60)  # shorter, but no other direction
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(6)
    found = {}
    for r in retrieval.search(v, v, 7).collect():
        found.setdefault(r.query_id, []).append((-r.score, r.corpus_id))
    y = x.astype(np.float64)
    dot = lambda a, b: np.cumsum(a * b, axis=-1)[..., -1]
    size = np.sqrt(dot(y, y))
    for q in range(0, 750, 7):
        s = dot(y[q], y) / (size[q] * size)
        assert sorted(found[q]) == sorted(zip((-s).tolist(), range(750)))[:7]


def test_search_holds_a_block_of_queries_and_its_best():
    r = np.random.default_rng(4)
    batch = lambda lo, n: pa.record_batch([pa.array(np.arange(lo, lo + n)), pa.array(list(r.normal(size=(n, 16)).astype(np.float32)), pa.list_(pa.float32()))], ["id", "v"])
    queries = retrieval._vectors(batch(0, 3000))
    peaks = []
    for n in (5, 40):
        tracemalloc.start()
        [out] = retrieval._run(queries, (batch(2000 * k, 2000) for k in range(n)), 10, None)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(out) == 30_000
    assert peaks[1] < 1.2 * peaks[0] < 120e6


def test_most_similar(spark):
    found = spark.createDataFrame([("test", 1, 2, 0.5), ("valid", 3, 4, 0.9), ("test", 5, 6, 0.9)], "split string, query_id bigint, corpus_id bigint, similarity double")
    assert [r.query_id for r in retrieval.most_similar(found).collect()] == [5, 3, 1]
    assert [r.query_id for r in retrieval.most_similar(found, 2).collect()] == [5, 3]


def test_relevance_by_label_is_the_pairs(spark):
    r = random.Random(6)
    rows = spark.createDataFrame([(k, r.choice([1, 2, 3, None, 9]) if k else 77) for k in range(30)], "vec_id bigint, label int")
    hits = spark.createDataFrame([(q, c, n + 1, 0.5) for q in range(30) for n, c in enumerate(r.sample(range(30), 10))], "query_id bigint, corpus_id bigint, rank int, score double")
    qrels = rows.alias("a").join(rows.alias("b"), "label").where("a.vec_id <> b.vec_id").selectExpr("a.vec_id query_id", "b.vec_id corpus_id")
    good, wanted = ir.judged_by_label(hits, rows, "vec_id", "label")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(ir.per_query_of(good, wanted)) == key(ir.per_query(hits, qrels))
    assert key(ir.rank_report_of(hits, hits, (good, wanted), (good, wanted))) == key(ir.rank_report(hits, hits, qrels))


def test_batches_without_repeats(spark):
    r = random.Random(2)
    data = [(k, f"a{r.randrange(40)}", f"p{r.randrange(60)}") for k in range(300)]
    found = ir.distinct_batches(spark.createDataFrame(data, "k int, anchor string, positive string"), 8, ["k"]).collect()
    assert sorted(x.k for x in found) == list(range(300))
    by = {}
    for x in found:
        by.setdefault(x.batch_id, []).append(x)
    assert all(len({x.anchor for x in b}) == len({x.positive for x in b}) == len(b) <= 8 for b in by.values())
    assert len(by) < 60


def test_stage_counts_come_with_the_pass(spark):
    df = spark.range(10).selectExpr("id", "CASE WHEN id < 3 THEN true WHEN id < 9 THEN false END AS ok")
    out, seen = profile.observed(df, "stage", F.col("ok"))
    assert out.where("ok").count() == 3
    out.collect()
    assert profile.stage_counts(df, F.col("ok")).first().asDict() == {"n_total": 10, "n_kept": 3, "n_removed": 7} == seen.get


def test_ordered_outputs(spark):
    rows = spark.createDataFrame([("b", 1, "T"), ("a", 2, "S"), ("a", 1, "S"), ("b", 0, "T"), ("c", 0, "A")], "document_id string, chunk_index int, title string")
    assert [(r.document_id, r.chunk_index) for r in passages.in_order(rows).collect()] == [("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]
    assert [r.title for r in passages.titles(rows).collect()] == ["A", "S", "T"]
    assert [r.document_id for r in passages.head(rows, 2, ["title", "chunk_index"]).collect()] == ["c", "a"]


def test_near_duplicates(spark, vectors):
    _, df = vectors
    found = retrieval.near_duplicates(df.where("vec_id = 7"), df.where("vec_id < 7"), "test").collect()
    assert [tuple(r) for r in found] == [("test", 7, 3, 1.0)]


def test_ir_metrics(spark):
    r = random.Random(6)
    hits = [(q, c, 1.0 - k / 20, k + 1) for q in range(30) for k, c in enumerate(r.sample(range(100), r.choice([3, 10])))]
    rel = {q: set(r.sample(range(100), r.randint(1, 30))) for q in range(40)}
    df, qrels = spark.createDataFrame(hits, "query_id int, corpus_id int, score double, rank int"), spark.createDataFrame([(q, c) for q, cs in rel.items() for c in cs], "query_id int, corpus_id int")
    found = {x.metric: x.value for x in ir.metrics(df, qrels).collect()}
    each = Counter()
    for q, wanted in rel.items():
        got = [int(c in wanted) for q2, c, _, _ in hits if q2 == q]
        for k in ir.KS:
            each[f"accuracy@{k}"] += any(got[:k])
            each[f"precision@{k}"] += sum(got[:k]) / k
            each[f"recall@{k}"] += sum(got[:k]) / len(wanted)
        each["mrr@10"] += next((1 / (i + 1) for i, g in enumerate(got) if g), 0)
        each["ndcg@10"] += sum(g / math.log2(i + 2) for i, g in enumerate(got)) / sum(1 / math.log2(i + 2) for i in range(min(10, len(wanted))))
        each["map@10"] += sum(sum(got[: i + 1]) / (i + 1) for i, g in enumerate(got) if g) / min(10, len(wanted))
    assert found.keys() == each.keys() and all(abs(found[m] - each[m] / 40) < 1e-12 for m in each)
    report = {x.query_id: x for x in ir.rank_report(df, df, qrels).collect()}
    assert len(report) == 40 and report[35].base_rank == "Not in Top10" and report[35].base_top is None
    ranks = {x.query_id: x.rank for x in ir.first_relevant_rank(df, qrels).collect()}
    assert ranks[0] == next((k for q, c, _, k in hits if q == 0 and c in rel[0]), None)


def test_evaluation_sets(spark):
    df = spark.createDataFrame([(1, "q1", "p", "c1"), (2, "q2", "p", "c1"), (3, "q3", None, "c2"), (4, "q4", "r", "c3")], "o int, question string, positive string, chunk_id string")
    for dedup_corpus, n in ((True, 2), (False, 3)):
        q, c, rel = ir.evaluation_sets(df, ["o"], dedup_corpus=dedup_corpus)
        assert (q.count(), c.count(), rel.count()) == (3, n, 3)
        assert sorted((r.question, r.text) for r in q.join(rel, "query_id").join(c, "corpus_id").collect()) == [("q1", "p"), ("q2", "p"), ("q4", "r")]


def test_split_check(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "document_id string")
    parts = df.withColumn("split", F.when(F.col("document_id") == "a", "train").otherwise("test"))
    assert dedup.check_split(df, parts).first().ok
    assert not dedup.check_split(df, parts.limit(2)).first().ok
    assert not dedup.check_split(df, parts.limit(0).unionByName(parts.where("document_id = 'b'")).unionByName(spark.sql("SELECT 'a' AS document_id, 'x' AS split UNION ALL SELECT 'a', 'y'"))).first().ok


def test_gain_of_nothing(spark):
    a, b = (spark.createDataFrame(x, "metric string, value double") for x in ([("m", 0.0), ("n", 2.0), ("only", 1.0)], [("m", 1.0), ("n", 3.0)]))
    found = {r.metric: (r.absolute_gain, r.relative_gain) for r in ir.compare(a, b).collect()}
    assert found == {"m": (1.0, None), "n": (1.0, 50.0)}
    assert {r.metric: r.relative_gain for r in ir.shown(ir.compare(a, b)).collect()} == {"M": "N/A", "N": "50.00%"}


def test_in_batch_loss(spark):
    r = np.random.default_rng(4)
    a, p = r.normal(size=(6, 4)), r.normal(size=(6, 4))
    df = spark.createDataFrame([(k // 3, k, a[k].tolist(), p[k].tolist()) for k in range(6)], "batch_id int, pair_id int, anchor array<double>, positive array<double>")
    for row in ir.in_batch_loss(df).collect():
        x, y = (m[row.batch_id * 3 : row.batch_id * 3 + 3] for m in (a, p))
        s = 20 * (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
        assert abs(row.loss - np.mean(np.log(np.exp(s).sum(1)) - np.diag(s))) < 1e-9


def test_context(spark):
    hits = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.31, 2), (1, 7, 0.30, 3), (2, 5, 0.1, 1)], "query_id int, corpus_id int, score double, rank int")
    texts = spark.createDataFrame([(5, "five", "PDF"), (6, "six", "Base"), (7, "seven", "Base")], "id int, text string, origin string")
    found = {r.query_id: (r.context, r.sources) for r in retrieval.context(hits, texts, most=7, none="-").collect()}
    assert found == {1: ("five\nsi", "• PDF (Score: 0.90)\n• Base (Score: 0.31)"), 2: ("-", "")}


def test_plans_stay_in_the_jvm(spark, sf):
    from textlake.plans import catalog

    for name in ("chunk_overlap", "rechunk_large", "stage1_reason", "uniform_sample", "document_split"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    plan = catalog.QUERIES["batch_assign"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    assert "PushedFilters" in spark.read.parquet(f"{sf}/documents.parquet").where(F.col("n_chars") > 5)._jdf.queryExecution().executedPlan().toString()
