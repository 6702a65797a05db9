"""Profiles of a table: sizes of groups, their distribution, and what a cleaner changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

BUCKETS = ((1, 1), (2, 3), (4, 6), (7, 10), (11, 20), (21, 1000))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def describe(df: DataFrame, c: str) -> DataFrame:
    """count, mean, std (of a sample), min, quartiles (interpolated) and max."""
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), q.alias("q"), F.max(c).alias("most"))
    return one.select("n", "mean", "std", "least", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "most")


def histogram(df: DataFrame, c: str, buckets: tuple[tuple[int, int], ...] = BUCKETS) -> DataFrame:
    """bucket, n in the buckets' order, empty ones too; one pass."""
    one = df.agg(*[F.count_if(F.col(c).between(a, b)).alias(f"b{k}") for k, (a, b) in enumerate(buckets)])
    label = lambda a, b: str(a) if a == b else f"{a}-{b}"
    listed = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(label(a, b)).alias("bucket"), F.col(f"b{k}").alias("n")) for k, (a, b) in enumerate(buckets)])
    return one.select(F.inline(listed))


def largest(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k largest groups; ties by key."""
    return group_sizes(df, key).orderBy(F.desc("n"), key).limit(k)


def observed(df: DataFrame, name: str, kept: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds n_total, n_kept and n_removed once df has been computed: the
    counts of a stage come with its pass, not from another."""
    seen = Observation(name)
    ok = F.coalesce(kept, F.lit(False))
    return df.observe(seen, F.count("*").alias("n_total"), F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_removed")), seen


def stage_counts(df: DataFrame, kept: Column) -> DataFrame:
    """n_total, n_kept, n_removed as a table."""
    ok = F.coalesce(kept, F.lit(False))
    return df.agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_removed"))


def changed(df: DataFrame, old: Column, new: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(~old.eqNullSafe(new)).alias("n_changed"))
