"""Shards by a hierarchical weighted hash tree.

A document descends from the root to a region, a rack and a shard. At each node every child draws
-ln(u) / weight from a hash u of the document and the child's path, and the least draw wins, which
each child does in proportion to its weight. A draw depends on nothing but the document, the child
and its weight: if a weight changes, documents move only to or from that child, and the choices in
all other subtrees stand. All is one expression over the scan; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.pytext import literal
from textlake.llm.common import fresh, without

#: region -> rack -> shard -> weight (its capacity); a node's weight is the sum of what lies below it.
Tree = dict[str, "Tree | float"]
LEVELS = ("region", "rack", "shard")
IN_LINE = 256  # nodes of a level that stand in the expression; more go into a broadcast table


def weight(node: Tree | float) -> float:
    """The sum of the weights of the shards below a node; negative ones and NaN count as 0."""
    if isinstance(node, dict):
        return sum(weight(x) for x in node.values())
    return float(node) if node > 0 and math.isfinite(node) else 0.0


def _inner(tree: Tree, path: str = "", depth: int = 0) -> Iterator[tuple[int, str, list[tuple[str, float]]]]:
    """(depth, path, children of weight above 0 in order of their paths) of the inner nodes. Paths are
    parted by "/"; in a name "%" and "/" are spelt %25 and %2F, so that each node has its own path."""
    spelt = {k: f"{path}/" * bool(depth) + k.replace("%", "%25").replace("/", "%2F") for k in tree}
    below = sorted((spelt[k], weight(x)) for k, x in tree.items() if weight(x) > 0)
    if below:
        yield depth, path, below
    for k, x in tree.items():
        if isinstance(x, dict) and weight(x) > 0:
            yield from _inner(x, spelt[k], depth + 1)


def level_names(tree: Tree, levels: tuple[str, ...] = LEVELS) -> tuple[str, ...]:
    """levels, and level4 and so on for what lies deeper in the tree."""
    depth = max([d + 1 for d, _, _ in _inner(tree)], default=0)
    return (*levels, *(f"level{k + 1}" for k in range(len(levels), depth)))


def _draw(key: Column, child: Column, w: Column) -> Column:
    digest = F.md5(F.concat(child, F.lit("|"), key))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0**48)
    return -F.ln(u) / w


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """docs with all their columns, and the levels' columns: the path of the node at each level.

    A tree may be of any depth, and of unlike depth: deeper levels are called level4, level5 and so
    on, and are null below a shard that lies higher. Equal keys, repeated rows among them, go to the
    same shard; a null key is the key "". Children of weight 0 or less get nothing; with no weight at
    all the columns are null. Draws that tie go to the child whose path comes first. Input columns
    named like a level give way. An empty table gives no rows; the text plays no part. Levels of many
    nodes are looked up in a table by the parent's path instead of in the expression.
    """
    levels = level_names(tree, levels)
    by_level: list[dict[str, list[tuple[str, float]]]] = [{} for _ in levels]
    for depth, path, below in _inner(tree):
        by_level[depth][path] = below
    out = without(docs, *levels)
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    parent: Column = F.lit("")
    for level, nodes in zip(levels, by_level):
        held = None
        if not nodes:
            out = out.withColumn(level, F.lit(None).cast("string"))
            continue
        if sum(map(len, nodes.values())) <= IN_LINE:
            table = F.create_map(*[x for p, c in nodes.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in c]))])
            children = F.try_element_at(table, parent)
        else:
            at, held = fresh(out, "__parent"), fresh(out, "__children")
            table = docs.sparkSession.createDataFrame(list(nodes.items()), f"`{at}` string, `{held}` array<struct<n: string, w: double>>")
            out, children = out.join(F.broadcast(table), parent == F.col(at), "left").drop(at), F.col(held)
        drawn = F.transform(children, lambda c: F.struct(_draw(k, c["n"], c["w"]).alias("d"), c["n"].alias("n")))
        out = out.withColumn(level, F.array_min(drawn)["n"])
        out = out.drop(held) if held else out
        parent = F.col(level)
    return out


def write_sharded(assigned: DataFrame, path: str, levels: tuple[str, ...] = LEVELS) -> None:
    """One folder for each shard, under its rack and region; one shuffle, whose hot shards AQE splits.

    Rows of all kinds are written as they are, repeated ones too; what has no shard lies in the folder
    of nulls. An empty table leaves an empty folder. levels are those of level_names for deeper trees.
    """
    assigned.hint("rebalance", *[F.col(c) for c in levels]).write.mode("overwrite").partitionBy(*levels).parquet(path)


def assign_sql(tree: Tree, table: str, columns: list[str], key: str = "doc_id", levels: tuple[str, ...] = LEVELS) -> str:
    """The same in DuckDB's SQL, for a tree that has a weight: all draws of a level as rows, of which
    the least stays."""
    levels = level_names(tree, levels)
    rows = [(p, n, w) for _, p, c in _inner(tree) for n, w in c]
    values = ", ".join(f"({literal(p)}, {literal(n)}, {w!r}::DOUBLE)" for p, n, w in rows)
    u = f"(('0x' || substr(md5(n || '|' || k), 1, 12))::BIGINT + 0.5::DOUBLE) / {2.0**48!r}::DOUBLE"
    sql = f"WITH tree(p, n, w) AS (VALUES {values}), l0 AS (SELECT DISTINCT coalesce({key}::VARCHAR, '') AS k, '' AS spot FROM {table})"
    for d in range(len(levels)):
        before = "".join(f", {x}" for x in levels[:d])
        sql += f", l{d + 1} AS (SELECT k, n AS spot{before}, n AS {levels[d]} FROM (SELECT l{d}.*, n, row_number() OVER (PARTITION BY k ORDER BY -ln({u}) / w, n) AS r FROM l{d} LEFT JOIN tree ON p = spot) WHERE r = 1)"
    return sql + f" SELECT {', '.join('t.' + c for c in columns)}, {', '.join(levels)} FROM {table} t JOIN l{len(levels)} ON k = coalesce(t.{key}::VARCHAR, '')"
