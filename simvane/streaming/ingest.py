"""Streams: ingest of new files, windowed counts with a watermark, and as-of joins on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], width: str, late: str) -> DataFrame:
    """start, keys, n, total of `value`, on a stream or a table; on a stream rows later than `late` are left out."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    by = source.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), *keys, "n", "total")


def ingest_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Writes all that is there now as Parquet, exactly once over restarts, and stops."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value of the latest right row of its key that is not later: one union, one window, no range join."""
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("v_"), F.lit(1).alias("side_"))
    b = right.select(key, time, F.col(value).alias("v_"), F.lit(0).alias("side_"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "side_").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last_", F.last(F.when(F.col("side_") == 0, F.struct("v_")), ignorenulls=True).over(w))
    return seen.filter("side_ = 1").select(*left.columns, F.col("last_.v_").alias(f"asof_{value}"))
