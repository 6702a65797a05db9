"""Readers with explicit schemas."""

from __future__ import annotations

import random
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.functions import urls
from textlake.functions.pytext import strip

SCRAPED = "title string, summary string, content string, language string, source string, url string, scraped_at string, word_count int"
PASSAGES = "chunk_id string, document_id string, chunk_index int, title string, chunk_text string, word_count int, char_count int, language string, domain string, url string, source string"
PAIRS = "question string, positive string, chunk_id string, document_id string, title string, domain string, language string, source string, url string"


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, if its files give fewer, so that costly
    expressions do not run in one task. Tables whose splits outnumber the cores stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def csv(spark: SparkSession, path: str, schema: str, keep_blanks: bool = False, keep_nulls: bool = False) -> DataFrame:
    """CSV with a header, quoted fields over several lines, with or without a BOM. Blanks are null, or
    empty texts if keep_blanks; with keep_nulls too, those without quotes stay null."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"').option("mode", "PERMISSIVE")
    if not keep_blanks:
        return reader.csv(path)
    df = reader.option("nullValue", uuid.uuid4().hex).option("emptyValue", "").csv(path)
    if keep_nulls:
        return df
    return df.select(*[F.coalesce(f.name, F.lit("")).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in df.schema.fields])


def json_documents(spark: SparkSession, path: str, schema: str = SCRAPED) -> DataFrame:
    """One JSON object in each file: its fields ("" where missing), document_id (the file's stem), ord
    (its place by file name with the ending) and bad (true for a file that is no JSON object)."""
    plain = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], schema).schema
    full = T.StructType([*plain.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    name = F.col("_metadata.file_name")
    texts = [F.coalesce(f.name, F.lit("")).alias(f.name) if f.dataType == T.StringType() else F.col(f.name) for f in plain.fields]
    return raw.select(F.regexp_replace(F.url_decode(name), r"\.json$", "").alias("document_id"), F.url_decode(name).alias("ord"), *texts, F.col("_corrupt").isNotNull().alias("bad"))


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """url, one for each line that is not blank."""
    return spark.read.text(path).select(strip("value").alias("url")).where("url <> ''")


def sitemap(spark: SparkSession, path: str, content_only: bool = False) -> DataFrame:
    """url of each entry of sitemap XML files; content_only keeps those of content pages."""
    found = spark.read.schema("loc string").option("rowTag", "url").xml(path).select(strip("loc").alias("url")).where("url <> ''")
    return found.where(urls.is_content_url("url")) if content_only else found


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """metric, value of a JSON object of numbers."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return raw.select(F.explode("m").alias("metric", "value"))


def binary_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """doc, page_no, text of binary files, by a function that gives a file's pages; empty pages go.
    A file that the function fails on has page_no null and its error as text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    out += [(name, k, t) for k, t in enumerate(extract(content)) if t and t.strip()]
                except Exception as e:  # noqa: BLE001 - a bad file is reported, not fatal
                    out.append((name, None, f"error: {e}"))
            yield pd.DataFrame(out, columns=["doc", "page_no", "text"])

    return files.mapInPandas(run, "doc string, page_no int, text string")


AGENT = "Mozilla/5.0 (compatible; textlake)"


def http_get(timeout: float = 60.0, agent: str = AGENT) -> Callable[[str], str]:
    """A fetcher of pages: text in the server's charset (else UTF-8); a status of 400 or more, or no
    answer in time, is an error."""

    def get(url: str) -> str:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", errors="replace")

    return get


def sitemap_over_http(spark: SparkSession, url: str, fetcher: Callable[[str], str] | None = None, content_only: bool = False) -> DataFrame:
    """url of each distinct entry of one sitemap that is fetched; a failed fetch is an error."""
    text = (fetcher or http_get())(url)
    rows = spark.createDataFrame([(text,)], "x string").select(F.explode(F.xpath("x", F.lit("/*[local-name()='urlset']/*[local-name()='url']/*[local-name()='loc']/text()"))).alias("url"))
    found = rows.select(strip("url").alias("url")).where("url <> ''").distinct()
    return found.where(urls.is_content_url("url")) if content_only else found


def wait_before_retry(attempt: int) -> None:
    """8 to 15 seconds, unlike in each task."""
    time.sleep(random.uniform(8, 15))


def wait_between_pages() -> None:
    """1 to 2 seconds."""
    time.sleep(random.uniform(1, 2))


def fetch(urls_: DataFrame, fetcher: Callable[[str], str], attempts: int = 3, pause: Callable[[int], None] = wait_before_retry, between: Callable[[], None] = wait_between_pages) -> DataFrame:
    """url, html, error of each URL by an injected fetcher (http_get's, say), asked up to attempts
    times with pause in between, and with between after each page that came. html is null where all
    failed; those rows are the dead letters. How many pages are asked for at a time is the number of
    partitions of urls_ that run at once."""
    rows = urls_.select("url")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url in frame["url"]:
                html, error = None, None
                for attempt in range(1, attempts + 1):
                    try:
                        html, error = fetcher(url), None
                        between()
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a fetcher raises is a failed try
                        error = str(e) or type(e).__name__
                        if attempt < attempts:
                            pause(attempt)
                out.append((url, html, error))
            yield pd.DataFrame(out, columns=["url", "html", "error"])

    return rows.mapInPandas(run, "url string, html string, error string")
