"""Incremental forms: a content-hash cache fed by micro-batches, and windowed counts of events (an extension)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.vector import encode_cached

CACHE_SCHEMA = "model string, text_hash string, dim int, vec array<float>"


def cache_batches(stream: DataFrame, path: str, model: str, encode: Callable[[list[str]], np.ndarray], checkpoint: str):
    """Starts a query that encodes each batch's (id, text) unless the cache at ``path`` has them.

    A batch repeated after a failure finds its texts in the cache and adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        try:
            cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
        except Exception as error:  # the first batch: nothing has been written
            if "PATH_NOT_FOUND" not in str(error):
                raise
            cache = spark.createDataFrame([], CACHE_SCHEMA)
        _, append = encode_cached(batch.select("id", "text"), cache, model, encode)
        append.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling windows over ts; on a stream, rows later than ``late`` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def next_cursor(batch: DataFrame) -> DataFrame:
    """One row with the position after a batch: one microsecond past its last time, null for an empty batch."""
    return batch.agg((F.max("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("cursor"))
