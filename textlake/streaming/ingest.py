"""Incremental ingest: what has been read is not read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def available_now(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], format: str = "parquet") -> None:  # noqa: A002
    """Apply a row-wise transform to all files that came to source since the last run, append to out,
    and stop. The checkpoint folder remembers what has been read, so each file's rows are written
    once, whatever fails in between."""
    stream = spark.readStream.schema(schema).format(format).load(source)
    transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def by_batch(spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], format: str = "parquet") -> None:  # noqa: A002
    """Give each new batch to handle(batch, id), which may do what a stream cannot (windows, joins with
    the sink). A batch may come again after a failure, with the same id: handle must bear that."""
    stream = spark.readStream.schema(schema).format(format).load(source)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resume(df: DataFrame, sink: str, key: str) -> DataFrame:
    """df without the rows whose key the sink (Parquet; it may not exist yet) holds already."""
    from textlake.operators.dedup import unprocessed

    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return df
    return unprocessed(df, spark.read.parquet(sink).select(key), key)
