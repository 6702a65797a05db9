import copy
import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from textlake.llm import sharding
from textlake.llm.queries import SHARD_TREE

from .cases import empty, odd, rows


def brute(key, tree):
    path, out = "", []
    while isinstance(tree, dict):
        best = None
        for name in tree:
            w = sharding.weight(tree[name])
            if w > 0:
                name = name.replace("%", "%25").replace("/", "%2F")
                p = f"{path}/{name}" if out else name
                u = (int(hashlib.md5(f"{p}|{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                best = min(best or (math.inf, ""), (-math.log(u) / w, p))
        if best is None:
            break
        path = best[1]
        tree = tree[path.rpartition("/")[2].replace("%2F", "/").replace("%25", "%")]
        out.append(path)
    return tuple(out)


def many(spark, n=4000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_against_brute_force(spark):
    for r in sharding.assign(many(spark, 500), SHARD_TREE).collect():
        assert (r.region, r.rack, r.shard) == brute(r.doc_id, SHARD_TREE)


def test_shares_follow_the_weights(spark):
    n = 4000
    count = Counter(r.shard for r in sharding.assign(many(spark, n), SHARD_TREE).collect())
    total = sharding.weight(SHARD_TREE)
    for region, racks in SHARD_TREE.items():
        for rack, shards in racks.items():
            for s, w in shards.items():
                p = w / total
                assert abs(count[f"{region}/{rack}/{s}"] - n * p) < 5 * math.sqrt(n * p * (1 - p))


def test_only_the_changed_subtree_moves(spark):
    other = copy.deepcopy(SHARD_TREE)
    other["west"]["r2"]["s1"] = 9.0  # grows: all that moves goes there or to its parents
    a = {r.doc_id: r for r in sharding.assign(many(spark), SHARD_TREE).collect()}
    b = {r.doc_id: r for r in sharding.assign(many(spark), other).collect()}
    moved = [k for k in a if a[k].shard != b[k].shard]
    assert moved
    for k in moved:
        x, y = a[k], b[k]
        if x.region != y.region:
            assert y.region == "west"
        elif x.rack != y.rack:
            assert y.rack == "west/r2"
        else:
            assert y.shard == "west/r2/s1"
    assert all(a[k].shard == b[k].shard for k in a if a[k].region == b[k].region != "west")


def test_removal_moves_what_was_there_only(spark):
    other = copy.deepcopy(SHARD_TREE)
    del other["east"]["r1"]["s1"]
    other["east"]["r1"]["s4"] = 4.0  # the weights above stay
    a = {r.doc_id: r.shard for r in sharding.assign(many(spark), SHARD_TREE).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(many(spark), other).collect()}
    assert {a[k][:8] for k in a if a[k] != b[k]} == {"east/r1/"}


def test_odd_rows(spark):
    df = odd(spark).selectExpr("*", "'mine' AS region", "1 AS d", "2 AS n")
    out = sharding.assign(df, SHARD_TREE)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "d", "n", "region", "rack", "shard"] and out.count() == 13
    for r in out.collect():
        assert (r.region, r.rack, r.shard) == brute("" if r.doc_id is None else r.doc_id, SHARD_TREE)
    assert sharding.assign(empty(spark), SHARD_TREE).collect() == []


def test_weights_of_nothing(spark):
    tree = {"a": {"r": {"s": 0.0, "t": -3.0}}, "b": {"r": {"s": float("nan"), "u": 1.0}}}
    assert {r.shard for r in sharding.assign(many(spark, 50), tree).collect()} == {"b/r/u"}
    assert {(r.region, r.shard) for r in sharding.assign(many(spark, 5), {}).collect()} == {(None, None)}


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT doc_id FROM '{sf}/documents.parquet' UNION ALL SELECT NULL")
    found = sorted(con.sql(sharding.assign_sql(SHARD_TREE, "documents", ["doc_id"])).fetchall(), key=repr)
    ours = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").union(spark.sql("SELECT cast(null AS bigint)")), SHARD_TREE)
    assert found == rows(ours)


def test_written_by_shard(spark, tmp_path):
    out = sharding.assign(many(spark, 200), SHARD_TREE)
    sharding.write_sharded(out, str(tmp_path / "x"))
    assert rows(spark.read.parquet(str(tmp_path / "x")), "doc_id", "shard") == rows(out, "doc_id", "shard")


@pytest.mark.parametrize("shape", ["one shuffle at most"])
def test_plan(spark, shape):
    plan = sharding.assign(many(spark), SHARD_TREE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


ODD_TREE = {"a/b": {"r%": {"s": 3.0}}, "a": {"b/r%": {"s": 1.0, "t": {"u": 2.0, "v": 1.0, "": 1.0}}}, "flat": 2.0, "o'k": {"x": 1.0}}


@pytest.mark.parametrize("in_line", [0, 3, 256])
def test_odd_names_and_depths(spark, monkeypatch, in_line):
    monkeypatch.setattr(sharding, "IN_LINE", in_line)
    found = sharding.assign(many(spark, 300).withColumn("level4", F.lit("x")).withColumn("__parent", F.lit(1)), ODD_TREE).collect()
    assert found[0].__fields__ == ["doc_id", "__parent", "region", "rack", "shard", "level4"]
    for r in found:
        assert tuple(x for x in (r.region, r.rack, r.shard, r.level4) if x is not None) == brute(r.doc_id, ODD_TREE)
    assert len({(r.region, r.rack, r.shard, r.level4) for r in found}) == 7


def test_sql_of_odd_trees(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT range AS doc_id FROM range(200)")
    found = sorted(con.sql(sharding.assign_sql(ODD_TREE, "documents", ["doc_id"])).fetchall(), key=repr)
    assert found == rows(sharding.assign(many(spark, 200), ODD_TREE))


def test_a_wide_tree(spark):
    tree = {f"g{k}": {f"r{j}": {"s": 1.0 + j} for j in range(3)} for k in range(400)}
    for r in sharding.assign(many(spark, 60), tree).collect():
        assert (r.region, r.rack, r.shard) == brute(r.doc_id, tree)
