"""From documents to passages: assemble, clean, split, chunk, count, drop copies, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import chunks, clean
from textlake.functions.pytext import let, word_count
from textlake.operators.dedup import keep_first

LEAST_CHARS, LEAST_WORDS, MAX_WORDS = 100, 40, 200


def document_text(summary: str | Column = "summary", content: str | Column = "content") -> Column:
    """Summary and content, each only if it is not empty, on lines of their own, cleaned apart and together."""
    s, c = clean.clean_passage(summary), clean.clean_passage(content)
    return clean.clean_passage(F.concat_ws("\n", F.nullif(s, F.lit("")), F.nullif(c, F.lit(""))))


def chunk_documents(docs: DataFrame, text: str = "text", id: str = "document_id", max_words: int = MAX_WORDS, least_chars: int = LEAST_CHARS, overlap: int = 1) -> DataFrame:  # noqa: A002
    """docs' columns but the text, and chunk_id, chunk_index, chunk_text, word_count, char_count.

    Documents under least_chars characters give nothing. chunk_index counts the chunks of more than
    80 characters, so gates that follow leave gaps. A chunk starts overlap sentences before the end of
    the one before it.
    """
    # the gate is part of the expression: as a filter it would make Spark prepare the text twice
    made = let(F.col(text), lambda t: F.when(F.length(t) >= least_chars, chunks.chunk_words(chunks.sentences_a(t), max_words, overlap=overlap)))
    rest = [c for c in docs.columns if c != text]
    out = chunks.listed(docs, made, rest, "chunk_index", "__chunk")
    name = F.concat_ws("_", F.col(id).cast("string"), F.lit("chunk"), F.col("chunk_index").cast("string"))
    return out.select(*rest, "chunk_index", F.col("__chunk.text").alias("chunk_text"), name.alias("chunk_id"), F.col("__chunk.words").alias("word_count"), F.col("__chunk.chars").alias("char_count"))


def recount(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    return df.withColumns({"word_count": word_count(text), "char_count": F.length(text)})


def passages(docs: DataFrame, text: str = "text", id: str = "document_id", least_words: int = LEAST_WORDS) -> DataFrame:  # noqa: A002
    """The distinct passages of at least so many words; of equal ones the first by document and place."""
    made = chunk_documents(docs, text, id)
    return keep_first(made, ["chunk_text"], [id, "chunk_index"]).where(F.col("word_count") >= least_words)


def rechunk_large(chunks_: DataFrame, over: int = 400, max_words: int = MAX_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """chunks_ with those of more than over words split again; parts get the suffix _fix and their
    number, keep the chunk_index, and go if they have under least_words words."""
    large = F.col("word_count") > over
    parts = F.when(large, chunks.chunk_words(chunks.sentences_b("chunk_text"), max_words, longer_than=None, least_words=least_words))
    parts = parts.otherwise(F.array(F.struct(F.col("chunk_text").alias("text"), F.col("word_count").cast("int").alias("words"), F.length("chunk_text").alias("chars"))))
    rest = [c for c in chunks_.columns if c not in {"chunk_text", "chunk_id", "word_count", "char_count"}]
    out = chunks.listed(chunks_, parts, [*rest, "chunk_id", large.alias("__large")], "__k", "__chunk")
    name = F.when(F.col("__large"), F.concat("chunk_id", F.lit("_fix"), F.col("__k").cast("string"))).otherwise(F.col("chunk_id"))
    return out.select(*rest, F.col("__chunk.text").alias("chunk_text"), name.alias("chunk_id"), F.col("__chunk.words").alias("word_count"), F.col("__chunk.chars").alias("char_count"))


def described(chunks_: DataFrame, language: str, domain: str, source: str) -> DataFrame:
    """The chunks with what is the same for all of them."""
    return chunks_.withColumns({"language": F.lit(language), "domain": F.lit(domain), "source": F.lit(source)})


def in_order(chunks_: DataFrame, id: str = "document_id") -> DataFrame:  # noqa: A002
    """The chunks by document and place, as a written table has them: a sort by ranges, not in one task."""
    return chunks_.orderBy(id, "chunk_index")


def titles(chunks_: DataFrame, id: str = "document_id") -> DataFrame:  # noqa: A002
    """The distinct documents and titles, by title (ties by document)."""
    return chunks_.select(id, "title").distinct().orderBy("title", id)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in order, for a look at a table."""
    return df.orderBy(*order).limit(n)


def page_chunks(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages' columns but the text, and chunk_no, chunk: consecutive chunks of about 400 characters."""
    rest = [c for c in pages.columns if c != text]
    return chunks.listed(pages, chunks.chunk_chars(chunks.sentences_c(text)), rest, "chunk_no", "chunk")
