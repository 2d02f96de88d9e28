"""Streams: line files as they arrive, annotated once and summed up with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.bundle import missing_from

EVENT = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType())]
    + [T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def arriving(spark: SparkSession, path: str, schema: T.StructType = EVENT, files_at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, weighted): counts in windows of event time; events later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("weighted")).select(F.col("w.start").alias("start"), "event_type", "events", "weighted")


def annotate_new(stream: DataFrame, key: str, annotate: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Annotates rows whose key the store does not have, batch by batch, and ends when all that is there is done."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = missing_from(fresh, spark.read.parquet(store), key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        annotate(fresh).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
