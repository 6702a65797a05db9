"""Calls of models and other services, batched, retried, with the client injected.

A client is any picklable callable; nothing here knows a network. Rows come back whether the call
worked or not, with an error where it did not, so that routing stays relational. Tasks may run twice:
clients must bear repeated calls, and results should be written before anything is routed on them.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.functions import clean
from textlake.operators.dedup import assign_batches

Client = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Retry:
    """attempts, and seconds to wait after an error, by a text in its message, else 2 ** attempt."""

    attempts: int = 2
    waits: tuple[tuple[str, float], ...] = (("429", 30.0), ("quota", 60.0), ("json", 5.0))
    sleep: Callable[[float], None] = field(default=time.sleep)

    def wait(self, error: Exception, attempt: int) -> None:
        text = f"{type(error).__name__} {error}".lower()
        self.sleep(next((s for k, s in self.waits if k in text), 2.0**attempt))


def _numbered(rows: int, found: list | None) -> None:
    """An error unless there is a label for each row, or one too many."""
    if found is None or len(found) not in {rows, rows + 1}:
        raise ValueError(f"labels for {len(found or [])} rows of {rows}, in the JSON")


def secret(*names: str) -> str:
    """The first of the environment's variables that is set; an error if none is."""
    for n in names:
        if os.environ.get(n):
            return os.environ[n]
    raise KeyError(f"none of {', '.join(names)} is set")


def call(client: Client, prompts: list[str], retry: Retry, check: Callable[[int, str], None] | None = None) -> tuple[list[str | None], str | None]:
    """(responses, error): one response for each prompt, or nulls and the last error. check is given
    each prompt's place and response; what it raises is a failed try like the client's own errors."""
    error: Exception | None = None
    for attempt in range(1, retry.attempts + 1):
        try:
            out = list(client(prompts))
            if len(out) == len(prompts) + 1:  # one answer too many is cut off
                out.pop()
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
            for k, x in enumerate(out if check else ()):
                check(k, x)
            return out, None
        except Exception as e:  # noqa: BLE001 - whatever a client raises is a failed call
            error = e
            if attempt < retry.attempts:
                retry.wait(e, attempt)
    return [None] * len(prompts), f"api_error: {error}"


def json_list(text: str | None) -> list | None:
    """The JSON list that a response opens with, fences round it or not; None for the word SKIP. An
    empty response, or anything else, is a ValueError."""
    if not (text or "").strip():
        raise ValueError("empty response")
    if text.strip().upper() == "SKIP":
        return None
    found, _ = json.JSONDecoder().raw_decode(text.replace("```json", "").replace("```", "").strip())
    if not isinstance(found, list):
        raise ValueError("the JSON is no list")
    return found


def map_prompts(df: DataFrame, prompt: str, client: Client, batch: int = 50, retry: Retry | None = None, pause: float = 0.0, check: Callable[[str, pd.Series], None] | None = None) -> DataFrame:
    """df with response and error, one call of the client for batch rows of a partition. check is
    given each response with its row, and raises if the client is to be asked again."""
    retry = retry or Retry()
    kept = df.drop("response", "error")
    schema = T.StructType([*kept.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.slice(lo, batch)
                rows = part.to_pandas() if check else None
                out, error = call(client, [p or "" for p in part.column(prompt).to_pylist()], retry, (lambda k, x, rows=rows: check(x, rows.iloc[k])) if check else None)
                added = [pa.array(out, pa.string()), pa.array([error] * len(part), pa.string())]
                yield pa.record_batch([*part.columns, *added], [*part.schema.names, "response", "error"])
                if pause:
                    retry.sleep(pause)

    return kept.mapInArrow(run, schema)


def with_fallback(*clients: Client) -> Client:
    """The first client's answers; if it fails the next one's."""

    def run(prompts: list[str]) -> list[str]:
        for k, c in enumerate(clients):
            try:
                return list(c(prompts))
            except Exception:  # noqa: BLE001 - the next one is asked; the last one's error is raised
                if k == len(clients) - 1:
                    raise
        raise ValueError("no client")

    return run


class StubClient:
    """Deterministic answers, for tests and dry runs: made by a function of the prompt."""

    def __init__(self, answer: Callable[[str], str], fail_on: str | None = None) -> None:
        self.answer, self.fail_on = answer, fail_on

    def __call__(self, prompts: list[str]) -> list[str]:
        if self.fail_on and any(self.fail_on in p for p in prompts):
            raise RuntimeError("429 the stub was told to fail")
        return [self.answer(p) for p in prompts]


# questions

QUESTIONS = "array<struct<chunk_id:string,questions:array<string>>>"


def generated_pairs(responses: DataFrame, chunks: DataFrame, response: str = "response", exactly: int = 3) -> DataFrame:
    """Pairs of the responses' questions and the chunks they name.

    A response is a JSON list of chunk_id and questions, with or without fences and text behind it;
    others give nothing. Questions are stripped, blanks and repeats dropped; lists that do not hold
    exactly so many are left out, as are chunk_ids that are not known.
    """
    parsed = responses.select(F.explode(F.from_json(clean.without_fences(response), QUESTIONS)).alias("x")).select("x.chunk_id", "x.questions")
    asked = F.array_distinct(F.filter(F.transform("questions", lambda q: F.trim(q)), lambda q: F.coalesce(q, F.lit("")) != ""))
    good = parsed.select("chunk_id", asked.alias("q")).where(F.size("q") == exactly)
    return good.join(chunks, "chunk_id").select(F.explode("q").alias("question"), F.col("chunk_text").alias("positive"), *[c for c in chunks.columns if c != "chunk_text"])


def unknown_chunks(responses: DataFrame, chunks: DataFrame, response: str = "response") -> DataFrame:
    parsed = responses.select(F.explode(F.from_json(clean.without_fences(response), QUESTIONS)).alias("x")).select("x.chunk_id")
    return parsed.join(chunks, "chunk_id", "left_anti")


ASK = "For each passage below write three different questions that it answers, in its language. Answer with a JSON list of objects with chunk_id and questions (three texts), or with the word SKIP if no passage allows any.\n\n%s"
_BETWEEN = "\n\n" + "=" * 20 + "\n\n"


def question_prompt(id: str = "chunk_id", title: str = "title", text: str = "chunk_text") -> Column:  # noqa: A002
    """A passage as it stands in the prompt for questions."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    return F.concat(F.lit("\nChunk ID: "), c(id), F.lit("\n\nTitle:\n"), c(title), F.lit("\n\nPassage:\n"), c(text), F.lit("\n"))


def generate_questions(chunks: DataFrame, client: Client, order: list[str], done: DataFrame | None = None, size: int = 20, least_words: int = 40, ask: str = ASK, retry: Retry | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, failed) of chunks (chunk_id, chunk_text, title, url, domain and others).

    Chunks are put into batches of size in order. Of a batch those are asked about that are not done
    (a table of chunk_id), belong to no list of frequent questions, are not blank and have at least
    least_words words. A batch is one prompt; its answer is checked within the tries: no list of JSON
    and an empty answer are asked for again, SKIP gives nothing. pairs has a row for each question of
    a chunk of the batch that got exactly three different ones; failed are the chunks, with the
    error, of batches whose tries all failed.
    """
    from textlake.functions.pytext import word_count
    from textlake.functions.urls import is_faq

    rows = assign_batches(chunks, size, order)
    if done is not None:
        rows = rows.join(done.select(F.col("chunk_id").alias("__done")), F.col("chunk_id") == F.col("__done"), "left_anti")
    rows = rows.where(~is_faq(*[c for c in ("title", "url", "domain", "article_id") if c in chunks.columns]) & (word_count("chunk_text") >= least_words))
    lines = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], question_prompt(title="title" if "title" in chunks.columns else "chunk_id").alias("line"))))
    asked = rows.groupBy("batch_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), _BETWEEN).alias("x"))
    asked = asked.select("batch_id", F.format_string(ask, "x").alias("__prompt"))
    answered = map_prompts(asked, "__prompt", client, 1, retry, check=lambda x, row: json_list(x) and None)
    good = answered.where("error is null").select("batch_id", F.explode(F.from_json(clean.without_fences("response"), QUESTIONS)).alias("q"))
    good = good.select("batch_id", F.col("q.chunk_id").alias("chunk_id"), F.array_distinct(F.filter(F.transform("q.questions", lambda q: F.trim(q)), lambda q: F.coalesce(q, F.lit("")) != "")).alias("q")).where(F.size("q") == 3)
    pairs = good.join(rows, ["batch_id", "chunk_id"]).select(F.explode("q").alias("question"), F.col("chunk_text").alias("positive"), *[c for c in chunks.columns if c != "chunk_text"])
    failed = rows.join(answered.where("error is not null").select("batch_id", "error"), "batch_id").select(*chunks.columns, "error")
    return pairs, failed


# labels

FLAGS = ("agriculture", "reusable", "person_specific", "identity_lookup", "contact_information", "navigation_or_metadata", "encoding_problem", "question_answer_match")
LABELS = "array<struct<" + ",".join(f"{f}:boolean" for f in FLAGS) + ",reason:string>>"


def label_prompt(place: str | Column = "place", question: str | Column = "question", positive: str | Column = "positive") -> Column:
    """A pair as it stands in the prompt for labels."""
    c = lambda x: F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))
    return F.concat(F.lit("\nPair "), c(place), F.lit("\n\nQuestion:\n"), c(question), F.lit("\n\nPassage:\n"), c(positive), F.lit("\n"))


def label_batches(pairs: DataFrame, order: list[str], client: Client, prompt: Column, size: int = 50, retry: Retry | None = None) -> DataFrame:
    """pairs with their flags and llm_reason. Rows are sent in batches of size in order; a batch's
    answer is a JSON list with one label for each row, in order, to which rows are joined by position.
    One label too many is dropped. Any other number, or an answer that is no JSON list, is a failed
    call and asked for again; if all tries fail, the whole batch gets null flags and an llm_reason
    that starts with api_error."""
    from pyspark.sql import Window

    placed = assign_batches(pairs, size, order).withColumn("__at", F.row_number().over(Window.partitionBy("batch_id").orderBy(*order)) - 1)
    placed = placed.withColumn("__prompt", prompt)
    asked = placed.groupBy("batch_id").agg(F.count("*").alias("__rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__prompt"))), lambda x: x["__prompt"]), "\n").alias("__text"))
    answered = map_prompts(asked, "__text", client, 1, retry or Retry(5, sleep=time.sleep), check=lambda x, row: _numbered(int(row["__rows"]), json_list(x)))
    labels = F.from_json(clean.without_fences("response"), LABELS)
    answered = answered.withColumn("__labels", labels).withColumn("__off", F.size("__labels") - F.col("__rows"))
    fits = F.col("__labels").isNotNull() & F.col("__off").isin(0, 1)
    why = F.coalesce("error", F.concat(F.lit("api_error: labels for "), F.coalesce(F.size("__labels"), F.lit(0)).cast("string"), F.lit(" rows of "), F.col("__rows").cast("string")))
    answered = answered.select("batch_id", F.when(fits, F.col("__labels")).alias("__labels"), F.when(~fits, why).alias("__why"))
    both = placed.join(answered, "batch_id").withColumn("__l", F.get("__labels", F.col("__at").cast("int")))
    flags = [F.coalesce(F.col(f"__l.{f}"), F.when(F.col("__l").isNotNull(), F.lit(False))).alias(f) for f in FLAGS]
    return both.select(*pairs.columns, "batch_id", *flags, F.coalesce("__why", F.col("__l.reason"), F.lit("")).alias("llm_reason"))


# vectors


def hash_vector(text: str, dims: int = 64) -> np.ndarray:
    """A unit vector of hashed character trigrams: the encoder of tests."""
    v = np.zeros(dims)
    padded = f"  {text.lower()} "
    for i in range(len(padded) - 2):
        h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def hashing_encoder() -> Callable[[list[str]], np.ndarray]:
    return lambda texts: np.stack([hash_vector(t) for t in texts])


def encode(c: str | Column, load: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, batch: int = 64) -> Column:
    """Unit vectors of a text column. load makes the encoder, once in each task; nulls are empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            out: list[np.ndarray] = []
            for lo in range(0, len(texts), batch):
                x = np.asarray(encoder(texts.iloc[lo : lo + batch].fillna("").tolist()), np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                out += list((x / np.where(n > 0, n, 1)).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return run(c)


def as_messages(system: str | Column, user: str | Column) -> Column:
    """array<struct<role, content>> of a system and a user message."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), (F.col(c) if isinstance(c, str) else c).alias("content"))
    return F.array(one("system", system), one("user", user))


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)
