"""The subpackage's queries: against their SQL, or whole."""

import duckdb
import pytest

import __spark_entry__
from textlake.llm import queries


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert {k.split("_")[0] for k in known if k.startswith("op")} == {f"op{n}" for n in range(1, 11)} and "pipeline" in known
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(known)


def key(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(key(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(key, r)) for r in result.fetchall())


def test_rows_of_the_others(spark, sf):
    n = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    run = lambda q: queries.QUERIES[q](spark, sf)
    assert run("op4_sentencepiece").count() == run("op7_language_id").count() == n("documents")
    assert run("op6_url_filter").count() == n("pages")
    assert run("op5_chat_tokens").count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    packed = {d for r in run("op1_packed_tokens").select("doc_ids").collect() for d in r.doc_ids}
    assert packed == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    mixed = run("op2_mix_sources").groupBy("source").count().collect()
    assert max(r["count"] for r in mixed if r.source != "src0") <= max(r["count"] for r in mixed if r.source == "src0") + 8
