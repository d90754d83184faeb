"""Event-time streams: windowed counts, sessions, recurrence state and incremental upserts.

Every operator takes a streaming DataFrame and works on a batch one alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.session import shared_folder
from quillspark.streaming.sinks import EpochTable, VersionedTable


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with a zoned event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events and values by window and type; late rows are dropped behind the watermark on a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return (
        events.groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user, closed by a gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_first(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark (task log retention, replays)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sliding_counts(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Events by type in windows of `width` that begin every `slide`; a row that arrives behind the watermark counts in
    those of its windows that are still open, and in none of the closed ones."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


def start_epochs(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Append what each batch gives to a table under folder; the same folder goes on where the query stopped."""
    table = EpochTable(stream.sparkSession, f"{folder}/out")
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(table.put).start()


def epoch_rows(spark: SparkSession, folder: str) -> DataFrame:
    return EpochTable(spark, f"{folder}/out").read()


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, in the shared folder, and return the rows of its last state (complete) or of all its batches."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    if mode == "complete":
        table = VersionedTable(spark, f"{folder}/out")
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(table.put).start().awaitTermination()
        return table.read()
    start_epochs(stream, folder, mode).awaitTermination()
    return epoch_rows(spark, folder)


def upsert_each_batch(stream: DataFrame, update: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """VEC-04: an incremental table; every batch makes a new version of the last one on disk by update(old, changed)."""
    folder = shared_folder(stream.sparkSession, "upsert")
    table = VersionedTable(stream.sparkSession, f"{folder}/table")
    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(table.merge(update)).start().awaitTermination()
    return table.read()
