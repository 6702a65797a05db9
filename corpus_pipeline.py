"""From raw documents to token ids: identify languages, drop near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. docs are rows of
documents: doc_id, text, lang, source, n_chars, and whatever other columns the table has. Null, empty
and letterless texts are rejected by the first stage; the others would pass them on. Null doc_ids are
no one's copies and pass all stages; rows that repeat a doc_id and a text are copies, of which one
stays. An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlake.llm import langid, mixing, ngram_join, sentencepiece_sa
from textlake.llm.common import cut, fresh, load
from textlake.llm.queries import MIX_LEAST_SHARE, SOURCE_WEIGHTS


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, in all their columns; lang holds it. The others go.

    Rows are judged by their text alone, repeated ones alike and ties for the first language in
    alphabetical order. Texts of any length are scored whole.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, whatever ids they share, in all its columns.

    The least doc_id stays. Rows with a null doc_id, and texts without words, stay as they are.
    """
    return ngram_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the sources' weights, each shard's together in its shuffled order.

    At least MIX_LEAST_SHARE of them is drawn, however small the scarcest source; a null source is a
    source of its own. All columns are kept, those named like the mix's own as well.
    """
    held = {c: fresh(docs, f"__{c}") for c in docs.columns if c.lower() in {"mix_shard", "mix_pos"}}
    mixed = mixing.mix_sources(docs.withColumnsRenamed(held), SOURCE_WEIGHTS, least_share=MIX_LEAST_SHARE)
    mixed = mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_pos").drop("mix_shard", "mix_pos")
    return mixed.withColumnsRenamed({new: c for c, new in held.items()})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and the text decoded from them, of each row. Null and empty texts have
    no ids; other columns play no part."""
    return sentencepiece_sa.encode_documents(docs)


STAGES = [("language ID", identify_languages), ("n-gram Jaccard join", drop_near_copies), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]

#: Neither the language models nor the mixing draws nor the encoding can be said in SQL.
#: tests/llm/test_pipeline.py holds run() against plain versions of the stages: the language models
#: and the draws on dicts and lists, all pairs of n-gram sets, and the tokenizer's library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
