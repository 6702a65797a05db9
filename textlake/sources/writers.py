"""Writers. Tables are partitioned where the reference writes many files by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quotes are doubled, and white space at a text's ends is kept.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
BOM = "﻿"


def csv(df: DataFrame, path: str, append: bool = False, bom: bool = False) -> None:
    """CSV with a header in each file; with a BOM before the first column's name if asked."""
    out = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    out.write.mode("append" if append else "overwrite").options(**_CSV).option("quoteAll", bom).csv(path)


def routed(df: DataFrame, path: str, by: str, append: bool = False) -> None:
    """One folder of text lines for each value of by (categories, verdicts, batches); append adds to
    what earlier runs wrote."""
    df.write.mode("append" if append else "overwrite").partitionBy(by).text(path)


def batches(df: DataFrame, path: str) -> None:
    """One folder of CSV files for each batch_id."""
    df.repartition("batch_id").write.mode("overwrite").options(**_CSV).partitionBy("batch_id").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def metrics_json(metrics: DataFrame, path: str, prefix: str = "") -> None:
    """One JSON object of metric: value."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit(prefix), F.col("metric")), F.col("value")))))
    metrics.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def metrics_text(metrics: DataFrame, path: str) -> None:
    """A line "metric: value" for each."""
    metrics.select(F.concat_ws(": ", "metric", F.col("value").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def comparison_csv(comparison: DataFrame, path: str) -> None:
    """A comparison of metrics as one CSV file: numbers with 6 places, nothing where there is none."""
    six = [F.coalesce(F.format_string("%.6f", c), F.lit("")).alias(c) for c in comparison.columns if c != "metric"]
    rows = comparison.orderBy("metric").select("metric", *[F.when(F.col(x).isNotNull(), c).alias(x) for x, c in zip([c for c in comparison.columns if c != "metric"], six)])
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sitemap(urls: DataFrame, path: str, url: str = "url") -> None:
    """The URLs as sitemap files."""
    urls.select(F.col(url).alias("loc")).write.mode("overwrite").option("rootTag", "urlset").option("rowTag", "url").xml(path)


def next_version(df: DataFrame, root: str, version: int) -> str:
    """Write a new version beside those that are read from, and give its path."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def dead_letters(fetched: DataFrame, path: str) -> None:
    fetched.where(F.col("error").isNotNull()).select("url").write.mode("append").text(path)
