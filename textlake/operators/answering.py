"""Retrieval-augmented answers over batches of questions, and the knowledge base behind them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import clean
from textlake.operators import model_calls, passages, retrieval

TEMPLATE = "Answer from the context only. Say so if it does not hold the answer.\n\nContext:\n%s\n\nQuestion:\n%s\n\nAnswer:\n"
NONE = " ".join(("इस विषय", "पर जानकारी", "उपलब्ध नहीं", "है।"))
BASE, PDF = "Base Knowledge", "PDF"
Load = Callable[[], Callable[[list[str]], np.ndarray]]


def knowledge_base(spark: SparkSession, facts: list[str], load: Load = model_calls.hashing_encoder) -> DataFrame:
    """id, text, origin, embedding of inline facts."""
    rows = spark.createDataFrame(list(enumerate(facts)), "id bigint, text string")
    return rows.select("id", "text", F.lit(BASE).alias("origin"), model_calls.encode("text", load).alias("embedding"))


def ingest_pages(kb: DataFrame, pages: DataFrame, load: Load = model_calls.hashing_encoder) -> DataFrame:
    """kb with the chunks of pages (doc, page_no, text) in place of those of any earlier ones.

    ids of chunks follow the base's, by doc, page and place; pages without text give nothing.
    """
    made = passages.page_chunks(pages.where(F.coalesce(F.col("text"), F.lit("")) != ""), "text")
    base = kb.where(F.col("origin") == BASE)
    after = base.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("__most"))
    hashed = F.shiftrightunsigned(F.xxhash64("doc", "page_no", "chunk_no"), 2)  # room is kept for the base's ids
    rows = made.crossJoin(F.broadcast(after)).select((F.col("__most") + 1 + hashed).alias("id"), F.col("chunk").alias("text"), F.lit(PDF).alias("origin"), model_calls.encode("chunk", load).alias("embedding"))
    return base.unionByName(rows)


def answer(kb: DataFrame, questions: DataFrame, client: model_calls.Client, k: int = 5, tau: float = 0.30, most: int = 3000, load: Load = model_calls.hashing_encoder, none: str = NONE) -> DataFrame:
    """question_id, question, answer, sources. Questions without a hit above tau are not sent to the
    client and get the text none; fewer than k rows in kb give fewer hits."""
    asked = questions.select("question_id", "question", model_calls.encode("question", load).alias("embedding"))
    hits = retrieval.search(asked.withColumnRenamed("question_id", "id"), kb, k, id="id")
    found = retrieval.context(hits, kb.select("id", "text", "origin"), tau, most, none="")
    rows = asked.select("question_id", "question").join(found, F.col("question_id") == F.col("query_id"), "left").drop("query_id")
    rows = rows.withColumn("prompt", F.format_string(TEMPLATE, F.col("context"), F.col("question")))
    has = F.coalesce(F.col("context"), F.lit("")) != ""
    sent = model_calls.map_prompts(rows.where(has), "prompt", client)
    told = F.concat(clean.after_thinking("response"), F.lit("\n\nSources:\n"), F.col("sources"))
    return sent.select("question_id", "question", told.alias("answer"), "sources").unionByName(rows.where(~has).select("question_id", "question", F.lit(none).alias("answer"), F.lit("").alias("sources")))
