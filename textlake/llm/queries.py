"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import chat, fingerprints, langid, mixing, near_vectors, ngram_join, packing, sentencepiece_sa, sharding, url_templates
from textlake.llm.common import load

#: Twice the weight for the largest source, one for each other.
SOURCE_WEIGHTS = {"src0": 2.0}

#: At least this part of the documents is drawn, however small the scarcest source.
MIX_LEAST_SHARE = 0.5

#: Three regions of unlike capacity; the weights are those of the shards.
SHARD_TREE: sharding.Tree = {
    "east": {"r1": {"s1": 4.0, "s2": 4.0, "s3": 2.0}, "r2": {"s1": 4.0, "s2": 4.0}},
    "west": {"r1": {"s1": 8.0, "s2": 8.0}, "r2": {"s1": 4.0, "s2": 2.0, "s3": 2.0}, "r3": {"s1": 3.0}},
    "north": {"r1": {"s1": 2.0, "s2": 1.0}},
}


def op1_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents"), SOURCE_WEIGHTS, least_share=MIX_LEAST_SHARE)


def op3_embedding_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_links(load(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sa.encode_documents(load(spark, sf_dir, "documents"))


def op5_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.transform("edits", lambda e: F.format_string("%d-%d:%d-%d", *[e[c] for c in ("old_from", "old_to", "new_from", "new_to")]))
    return fingerprints.compact(load(spark, sf_dir, "documents")).withColumns({"sections": F.array_join("sections", ","), "edits": F.array_join(places, ",")})


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(load(spark, sf_dir, "documents"), SHARD_TREE)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(load(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= {near_vectors.THRESHOLD}),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT d, b FROM reach JOIN links ON r = a),
classes AS (SELECT d, min(r) AS class_id FROM reach GROUP BY d)
SELECT vec_id, class_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links FROM embeddings JOIN classes ON vec_id = d
"""

def _aligned_sql(name: str, start: str) -> str:
    """Tables of a recursive query: name holds (root, a, b, i, k, done) of start(root, a, b, i, k), where a
    and b are lists that begin behind i and k elements; done are the ranges that differ.

    A step takes equal elements off both ends, finds the longest rising row of elements that occur once
    on either side (a chain of each length with the least end is kept), and goes on between these."""
    same = "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda t: a[{0}] = b[{1}]))"
    once = "len(list_filter({0}, lambda z: z = a[x])) = 1"
    return f"""{name} AS (
  SELECT root, a, b, i, k, false AS done FROM {start}
  UNION ALL
  SELECT root, a[part.a + 1 : part.c - 1], b[part.b + 1 : part.d - 1], i + part.a, k + part.b, part.done FROM (
    SELECT root, a, b, i, k, unnest(CASE WHEN len(chain) = 0 THEN [{{'a': 0, 'c': len(a) + 1, 'b': 0, 'd': len(b) + 1, 'done': true}}]
      ELSE list_transform(range(0, len(chain) + 1), lambda q: {{'a': CASE WHEN q = 0 THEN 0 ELSE chain[q].x END, 'c': CASE WHEN q = len(chain) THEN len(a) + 1 ELSE chain[q + 1].x END,
        'b': CASE WHEN q = 0 THEN 0 ELSE chain[q].y END, 'd': CASE WHEN q = len(chain) THEN len(b) + 1 ELSE chain[q + 1].y END, 'done': false}}) END) AS part FROM (
      SELECT *, CASE WHEN len(pairs) = 0 THEN [] ELSE list_reduce(pairs, lambda kept, p: kept[1 : len(list_filter(kept, lambda c: c[-1].y < p[1][1].y))]
          || [CASE WHEN len(list_filter(kept, lambda c: c[-1].y < p[1][1].y)) = 0 THEN [] ELSE kept[len(list_filter(kept, lambda c: c[-1].y < p[1][1].y))] END || p[1]]
          || kept[len(list_filter(kept, lambda c: c[-1].y < p[1][1].y)) + 2 :])[-1] END AS chain FROM (
        SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN list_transform(list_filter(range(1, len(a) + 1), lambda x: {once.format("a")} AND {once.format("b")}), lambda x: [[{{'x': x, 'y': list_position(b, a[x])::BIGINT}}]]) ELSE [] END AS pairs FROM (
          SELECT root, a[1 : len(a) - tail] AS a, b[1 : len(b) - tail] AS b, i, k FROM (
            SELECT *, {same.format("len(a) - t + 1 :", "len(b) - t + 1 :")} AS tail FROM (
              SELECT root, a[head + 1 :] AS a, b[head + 1 :] AS b, i + head AS i, k + head AS k FROM (SELECT *, {same.format("1 : t", "1 : t")} AS head FROM {name} WHERE NOT done)))
          WHERE len(a) + len(b) > 2 * tail))))
)"""


OP8_SQL = f"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT r, doc_id, x, list_transform(x, lambda s: sha256('P' || s)) AS leaf, len(x) AS n FROM p),
e AS (SELECT *, list_filter(range(1, n + 1), lambda i: i = n OR trim(x[i], ' ') = '' OR leaf[i][1:1] = '0') AS ends FROM l),
s AS (SELECT *, list_transform(range(1, len(ends) + 1), lambda k: sha256('S' || array_to_string(leaf[CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END : ends[k]], ''))) AS sections FROM e),
t AS (SELECT *, sha256('R' || array_to_string(sections, '')) AS root FROM s),
texts AS (SELECT root, min(doc_id) AS id, any_value(x) AS x, any_value(leaf) AS leaf, any_value(ends) AS ends, any_value(sections) AS sections FROM t WHERE root IS NOT NULL GROUP BY root),
held AS (SELECT DISTINCT root, id, h.p FROM (SELECT root, id, unnest(list_transform(list_filter(range(1, len(x) + 1), lambda i: trim(x[i], ' ') <> ''), lambda i: {{'p': leaf[i]}})) AS h FROM texts)),
points AS (SELECT root, last_value(CASE WHEN id IS NOT NULL THEN {{'id': id, 'root': root}} END IGNORE NULLS) OVER (PARTITION BY p ORDER BY id NULLS LAST, root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM held),
ranked AS (SELECT root, b.id AS base, b.root AS base_root, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, b.id DESC, b.root DESC) AS k FROM points WHERE b IS NOT NULL GROUP BY root, b),
bases AS (SELECT root, base, base_root FROM ranked WHERE k = 1),
trees AS (SELECT z.root, o.sections AS a, z.sections AS b, 0::BIGINT AS i, 0::BIGINT AS k FROM bases JOIN texts z ON bases.root = z.root JOIN texts o ON base_root = o.root),
{_aligned_sql("branches", "trees")},
below AS (SELECT g.root, o.leaf[f.a + 1 : coalesce(o.ends[i + len(g.a)], 0)] AS a, z.leaf[f.b + 1 : coalesce(z.ends[k + len(g.b)], 0)] AS b, f.a AS i, f.b AS k FROM branches g JOIN bases ON g.root = bases.root
  JOIN texts z ON g.root = z.root JOIN texts o ON base_root = o.root, LATERAL (SELECT {{'a': coalesce(o.ends[nullif(i, 0)], 0), 'b': coalesce(z.ends[nullif(k, 0)], 0)}} AS f) WHERE done),
{_aligned_sql("places", "below")},
edits AS (SELECT root, string_agg(format('{{}}-{{}}:{{}}-{{}}', i + 1, i + len(a), k + 1, k + len(b)), ',' ORDER BY i, k) AS edits FROM places WHERE done GROUP BY root)
SELECT doc_id, t.root, len(sections)::INT AS n_sections, n::INT AS n_paragraphs, array_to_string(sections, ',') AS sections,
  min(doc_id) OVER (PARTITION BY t.root) AS same_as, base, base_root, edits FROM t LEFT JOIN bases ON t.root = bases.root LEFT JOIN edits ON t.root = edits.root
"""

OP9_SQL = sharding.assign_sql(SHARD_TREE, "documents", ["doc_id", "text", "lang", "source", "n_chars"])

OP10_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x00-/:-@\\[-`{{-\\x7f]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM both_have JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE k / (s.n + t.n - k)::DOUBLE >= {ngram_join.THRESHOLD}
), reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reach JOIN links ON r = x),
classes AS (SELECT d, min(r) AS class_id FROM reach GROUP BY d),
copies AS (SELECT w, count(*) - 1 AS n_copies FROM words WHERE len(w) > 0 GROUP BY w), degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_links, 0) AS n_links
FROM words JOIN classes ON doc_id = d LEFT JOIN copies USING (w) LEFT JOIN degree ON doc_id = x
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packed_tokens, op2_mix_sources, op3_embedding_near_pairs, op4_sentencepiece, op5_chat_tokens,
        op6_url_filter, op7_language_id, op8_document_fingerprints, op9_shards, op10_ngram_jaccard_join,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_embedding_near_pairs": OP3_SQL, "op8_document_fingerprints": OP8_SQL, "op9_shards": OP9_SQL, "op10_ngram_jaccard_join": OP10_SQL}
