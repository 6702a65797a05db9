"""Keep-first deduplication, unions, complements, samples, splits and batches, all in explicit order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row (in order) of each group of equal keys; nulls are equal to each other. A hash of
    the keys is sorted by first, so that long ones are compared only if they are equal."""
    first = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of groups of more than one."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def union_primary(primary: DataFrame, retry: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both tables' rows, of equal keys the primary's first."""
    both = primary.withColumn("__rank", F.lit(0)).unionByName(retry.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, ["__rank", *order]).drop("__rank")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys and the least order each was seen at."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen"))


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is among the done ones; null keys count as not done."""
    return df.join(done.select(F.col(key).alias("__done")), F.col(key) == F.col("__done"), "left_anti")


def systematic_sample(df: DataFrame, group: str, order: list[str], share: float = 0.45, least: int = 2) -> DataFrame:
    """Of each group's rows in order, evenly spread ones: all if there are no more than least, else
    the larger of least and share of them (rounded up), from the first to the last row.

    Positions are those of evenly spaced doubles cut to whole numbers, as the reference's are.
    """
    rows = df.withColumn("__i", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("double"))
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(group)).cast("double"))
    k = F.greatest(F.lit(float(least)), F.ceil(F.lit(share) * F.col("__n")).cast("double"))
    step = F.greatest((F.col("__n") - 1) / (k - 1), F.lit(1.0))  # under 1 only where all rows are kept
    # position j is cut from j * step, so it is row i for the j near i / step: three of them suffice
    near = F.floor(F.col("__i") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        j = near + d
        hit = hit | ((j >= 0) & (j < k - 1) & (F.floor(j * step) == F.col("__i")))
    chosen = (F.col("__n") <= least) | hit | (F.col("__i") == F.col("__n") - 1)
    return rows.where(chosen).drop("__i", "__n")


def split_documents(docs: DataFrame, id: str = "document_id", train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:  # noqa: A002
    """id and split ("train", "valid", "test") of each distinct id, in exact proportions, by the order
    of a hash of seed and id.

    The rank over all ids is taken in two steps, so that no task holds them all: ids are counted by
    the first four digits of the hash, and ranked within them.
    """
    ids = docs.select(id).where(F.col(id).isNotNull()).distinct().withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))).withColumn("__b", F.substring("__h", 1, 4))
    count = ids.groupBy("__b").agg(F.count("*").alias("__c"))
    over = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of 65,536 rows at most
    before = count.select("__b", (F.sum("__c").over(over) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__n"))
    ranked = ids.join(F.broadcast(before), "__b").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", id)) - 1 + F.col("__before"))
    cut1, cut2 = F.floor(F.lit(train) * F.col("__n")), F.floor(F.lit(train + valid) * F.col("__n"))
    return ranked.select(id, F.when(F.col("__r") < cut1, "train").when(F.col("__r") < cut2, "valid").otherwise("test").alias("split"))


def legacy_split(ids_in_order: list[str], seed: int = 42, train: float = 0.8, valid: float = 0.1) -> list[tuple[str, str]]:
    """The same proportions by the legacy generator's shuffle of a short list on the driver."""
    ids = np.array(ids_in_order, dtype=object)
    np.random.RandomState(seed).shuffle(ids)
    a, b = int(len(ids) * train), int(len(ids) * (train + valid))
    return [(x, "train" if k < a else "valid" if k < b else "test") for k, x in enumerate(ids)]


def with_split(rows: DataFrame, split: DataFrame, id: str = "document_id") -> DataFrame:  # noqa: A002
    return rows.join(split, id)


def split_stats(rows: DataFrame, id: str = "document_id") -> DataFrame:  # noqa: A002
    """split, rows, documents and their shares of all in percent."""
    by = rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct(id).alias("n_docs"))
    whole = Window.partitionBy()
    return by.select("split", "n_rows", "n_docs", (100.0 * F.col("n_rows") / F.sum("n_rows").over(whole)).alias("rows_pct"), (100.0 * F.col("n_docs") / F.sum("n_docs").over(whole)).alias("docs_pct"))


def leaked_documents(rows: DataFrame, id: str = "document_id") -> DataFrame:  # noqa: A002
    """Ids that stand in more than one split; there must be none."""
    return rows.groupBy(id).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def check_split(rows: DataFrame, parts: DataFrame, id: str = "document_id") -> DataFrame:  # noqa: A002
    """One row: rows and documents before and after a split, documents in several parts, and ok: none
    lost, none added, none in two parts."""
    before = rows.agg(F.count("*").alias("rows_before"), F.countDistinct(id).alias("docs_before"))
    after = parts.agg(F.count("*").alias("rows_after"), F.countDistinct(id).alias("docs_after"))
    leaked = leaked_documents(parts, id).agg(F.count("*").alias("leaked"))
    one = before.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(leaked))
    return one.withColumn("ok", (F.col("rows_before") == F.col("rows_after")) & (F.col("docs_before") == F.col("docs_after")) & (F.col("leaked") == 0))


RANGE_ROWS, MOST_RANGES = 25_000, 4096  # rows ranked by one task, while the ranges suffice


def _place(bounds: Column, n: int, key: Column) -> Column:
    """How many of n rising bounds are at most the key, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"), key.alias("k"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        up = F.get(bounds, mid) <= a["k"]
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(up, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(up, a["hi"]).otherwise(mid).alias("hi"), a["k"].alias("k")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step, lambda a: a["lo"])


def assign_batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """df with batch_id: rows in order (which must tell them apart), size in each batch.

    Rows fall into ranges between bounds taken from a sample of the order columns; ranges are
    counted, and rows are numbered within them, so no task sees all rows. Any bounds give the same
    result.
    """
    n = df.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    bounds = []
    if ranges > 1:
        seen = sorted({tuple(r) for r in df.select(*order).na.drop().sample(fraction=min(1.0, 40.0 * ranges / n), seed=1).collect()})
        bounds = seen[:: max(1, len(seen) // ranges)][1:]
    kinds = [df.schema[c].dataType for c in order]
    key = F.struct(*order)
    over_bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(b, kinds, order)]) for b in bounds]) if bounds else None
    part = _place(over_bounds, len(bounds), key) if bounds else F.lit(0)
    rows = df.withColumn("__p", part)
    numbered = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each range
    count = rows.groupBy("__p").agg(F.count("*").alias("__c"))
    before = count.select("__p", (F.sum("__c").over(over) - F.col("__c")).alias("__before"))
    return numbered.join(F.broadcast(before), "__p").withColumn("batch_id", F.floor((F.col("__i") - 1 + F.col("__before")) / size).cast("int")).drop("__p", "__i", "__before")
