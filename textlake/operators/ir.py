"""Information-retrieval metrics over ranked hits, and comparisons of models by them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.operators.dedup import keep_first

KS, DEPTH = (1, 3, 5, 10), 10


def evaluation_sets(pairs: DataFrame, order: list[str], question: str = "question", positive: str = "positive", chunk_id: str = "chunk_id", dedup_corpus: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, qrels) of pairs: query_id and question; corpus_id and text; which belong together.

    Pairs with a null in any of the three columns are left out. query_id is a hash of the order
    columns, which must tell pairs apart. The corpus has each chunk once (its first pair's passage),
    or, if dedup_corpus is false, one row for each pair, so that equal passages compete.
    """
    kept = pairs.dropna(subset=[question, positive, chunk_id]).withColumn("query_id", F.xxhash64(*order))
    kept = kept.withColumn("corpus_id", F.xxhash64(chunk_id) if dedup_corpus else F.col("query_id"))
    corpus = keep_first(kept, ["corpus_id"], list(order)) if dedup_corpus else kept
    return kept.select("query_id", F.col(question).alias("question")), corpus.select("corpus_id", F.col(positive).alias("text")), kept.select("query_id", "corpus_id").distinct()


def per_query(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, depth: int = DEPTH) -> DataFrame:
    """A row for each query with a relevant row: its metrics. hits: query_id, corpus_id, rank; qrels:
    query_id, corpus_id, each pair once."""
    return per_query_of(*judged(hits, qrels), ks, depth)


def judged(hits: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the relevant hits' query_id and rank, each query's n_rel)."""
    return hits.join(qrels, ["query_id", "corpus_id"]).select("query_id", "rank"), qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))


def judged_by_label(hits: DataFrame, rows: DataFrame, id: str, label: str) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """The same where all other rows of a query's label are relevant to it: counted, not paired. Null
    labels and ids are nothing's; ids are distinct."""
    rows = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    of = lambda c, name: rows.select(F.col(id).alias(c), F.col(label).alias(name))
    good = hits.join(of("query_id", "__q"), "query_id").join(of("corpus_id", "__c"), "corpus_id").where("__q = __c and query_id <> corpus_id").select("query_id", "rank")
    count = rows.groupBy(F.col(label).alias("__l")).agg((F.count("*") - 1).alias("n_rel")).where("n_rel > 0")
    return good, of("query_id", "__l").join(count, "__l").select("query_id", "n_rel")


def per_query_of(good: DataFrame, wanted: DataFrame, ks: tuple[int, ...] = KS, depth: int = DEPTH) -> DataFrame:
    """per_query from what judged gives."""
    good = good.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    in_depth = F.col("rank") <= depth
    found = good.groupBy("query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks],
        F.min(F.when(in_depth, F.col("rank"))).alias("first"),
        F.sum(F.when(in_depth, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.sum(F.when(in_depth, F.col("nth") / F.col("rank"))).alias("ap"),
    )
    both = wanted.join(found, "query_id", "left")
    hit = lambda k: F.coalesce(F.col(f"h{k}"), F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return both.select(
        "query_id",
        *[(hit(k) > 0).cast("double").alias(f"accuracy@{k}") for k in ks],
        *[(hit(k) / k).alias(f"precision@{k}") for k in ks],
        *[(hit(k) / F.col("n_rel")).alias(f"recall@{k}") for k in ks],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias(f"mrr@{depth}"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias(f"ndcg@{depth}"),
        (F.coalesce("ap", F.lit(0.0)) / F.least(F.col("n_rel"), F.lit(depth))).alias(f"map@{depth}"),
    )


def metrics(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, depth: int = DEPTH) -> DataFrame:
    """metric, value: averages over the queries."""
    return metrics_of(*judged(hits, qrels), ks, depth)


def metrics_of(good: DataFrame, wanted: DataFrame, ks: tuple[int, ...] = KS, depth: int = DEPTH) -> DataFrame:
    rows = per_query_of(good, wanted, ks, depth)
    names = [c for c in rows.columns if c != "query_id"]
    one = rows.agg(*[F.avg(f"`{c}`").alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in names])))


def canonical(metric: str) -> Column:
    """A metric's name without its model's prefix, in lower case; "" if it has none of a cosine metric."""
    return F.regexp_extract(F.lower(metric), r"cosine_?.*?([a-z]+@\d+)$", 1)


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """metric, base, tuned, absolute_gain, relative_gain (%; null where base is 0) of the metrics both have."""
    a, b = base.select("metric", F.col("value").alias("base")), tuned.select("metric", F.col("value").alias("tuned"))
    gain = F.col("tuned") - F.col("base")
    return a.join(b, "metric").select("metric", "base", "tuned", gain.alias("absolute_gain"), F.when(F.col("base") != 0, gain / F.col("base") * 100).alias("relative_gain"))


def shown(comparison: DataFrame) -> DataFrame:
    """The comparison as text: 4 places, percent with 2, N/A where there is no relative gain."""
    four = [F.format_string("%.4f", F.col(c)).alias(c) for c in ("base", "tuned", "absolute_gain")]
    return comparison.select(F.upper("metric").alias("metric"), *four, F.coalesce(F.concat(F.format_string("%.2f", F.col("relative_gain")), F.when(F.col("relative_gain").isNotNull(), F.lit("%"))), F.lit("N/A")).alias("relative_gain"))


def first_relevant_rank(hits: DataFrame, qrels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """query_id, rank (null if no relevant row is among the first depth)."""
    return _first_rank(*judged(hits, qrels), depth)


def _first_rank(good: DataFrame, wanted: DataFrame, depth: int = DEPTH) -> DataFrame:
    return wanted.select("query_id").join(good.where(F.col("rank") <= depth).groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def rank_report(one: DataFrame, two: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, and of each model rank ("Not in Top10" where null), top-1 row and score."""
    return rank_report_of(one, two, judged(one, qrels), judged(two, qrels))


def rank_report_of(one: DataFrame, two: DataFrame, judged_one: tuple[DataFrame, DataFrame], judged_two: tuple[DataFrame, DataFrame]) -> DataFrame:
    """rank_report from what judged gives for each model's hits."""
    out = judged_one[1].select("query_id")
    for name, hits, judged_ in (("base", one, judged_one), ("tuned", two, judged_two)):
        top = hits.where("rank = 1").select("query_id", F.col("corpus_id").alias(f"{name}_top"), F.col("score").alias(f"{name}_score"))
        rank = _first_rank(*judged_).select("query_id", F.coalesce(F.col("rank").cast("string"), F.lit("Not in Top10")).alias(f"{name}_rank"))
        out = out.join(rank, "query_id", "left").join(top, "query_id", "left")
    return out


def distinct_batches(pairs: DataFrame, size: int, order: list[str], keys: tuple[str, ...] = ("anchor", "positive")) -> DataFrame:
    """pairs with batch_id, such that no batch holds a text twice, as in-batch negatives need.

    Rows are dealt to buckets in order, about 64 batches each; in a bucket, in order, each row goes
    to the first batch that has room and none of its texts. Buckets are independent, so the last
    batches of each may have room left. batch_id is the bucket's number and the batch's in it.
    """
    from pyspark.sql import types as T

    from textlake.operators.dedup import assign_batches

    placed = assign_batches(pairs, 64 * size, order).withColumnRenamed("batch_id", "__bucket")
    schema = T.StructType([*pairs.schema.fields, T.StructField("batch_id", T.StringType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        held: list[set] = []
        count: list[int] = []
        spots, full = [], 0
        for texts in zip(*(frame[k] for k in keys)):
            while full < len(count) and count[full] == size:
                full += 1
            spot = next((b for b in range(full, len(held)) if count[b] < size and not held[b].intersection(texts)), len(held))
            if spot == len(held):
                held.append(set())
                count.append(0)
            held[spot].update(texts)
            count[spot] += 1
            spots.append(f"{frame['__bucket'].iloc[0]}-{spot}")
        frame["batch_id"] = spots
        return frame.drop(columns="__bucket")

    return placed.groupBy("__bucket").applyInPandas(run, schema)


def in_batch_loss(pairs: DataFrame, scale: float = 20.0) -> DataFrame:
    """batch_id, loss of (batch_id, pair_id, anchor, positive): the mean cross-entropy of picking each
    anchor's own positive among its batch's by scaled cosine. batch sizes are those of training."""
    from textlake.operators.retrieval import cosine

    a = pairs.select("batch_id", F.col("pair_id").alias("i"), "anchor")
    b = pairs.select("batch_id", F.col("pair_id").alias("j"), "positive")
    scored = a.join(b, "batch_id").select("batch_id", "i", "j", (cosine("anchor", "positive") * scale).alias("s"))
    best = F.max("s").over(Window.partitionBy("batch_id", "i"))
    each = scored.withColumn("m", best).groupBy("batch_id", "i").agg((F.log(F.sum(F.exp(F.col("s") - F.col("m")))) + F.max("m") - F.max(F.when(F.col("i") == F.col("j"), F.col("s")))).alias("loss"))
    return each.groupBy("batch_id").agg(F.avg("loss").alias("loss"))
