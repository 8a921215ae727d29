"""Files that arrive in a folder, read once each as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources.reader import parse_files


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """The elements of files that arrive below folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return parse_files(files)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Appends the elements of new files to Parquet below out, until what is there is read; each file
    counts once, also over restarts with the same checkpoint folder."""
    return file_stream(spark, folder, per_trigger).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events (ts, event_type, value) by type in tumbling windows; batch or, with a watermark, stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
