"""Event streams: windows for batch and streaming frames alike, an idempotent micro-batch sink, and stream ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, total; with `late`, rows that come later than that are dropped by a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, stop, n of runs of a user's events less than `gap` apart."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def sink(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append events to a table, each micro-batch in a folder of its own that a repeated batch overwrites: exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def first_seen(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; state is kept for as long as the watermark allows late rows."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def ingest(engine, stream: DataFrame, checkpoint: str, bucket: str) -> StreamingQuery:
    """Sources as a stream: each micro-batch is an idempotent ingest, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.ingest(batch, bucket)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
