"""A landing folder of packages as a stream: each new file is screened and exploded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources import packages

#: Files of a micro-batch, at most; it bounds the bytes that a batch brings in.
FILES_PER_BATCH = 1_000


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """pkg, modified, digest, content of the files of a folder, as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES_PER_BATCH).load(folder)
    return files.select(F.col("path").alias("pkg"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), "content")


def first_copies(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first arrival of each content within the delay; state older than that is dropped."""
    return files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["digest"])


def screen_stream(spark: SparkSession, folder: str, parts_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the parts of every new package, with the reason of its screening, to a Parquet folder.

    The file sink commits a batch once, whatever is retried.
    """
    files = first_copies(arrivals(spark, folder))
    parts = packages.explode(files).select("pkg", "part", "type", "size", "digest", "error")
    return parts.writeStream.format("parquet").option("path", parts_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Events per window and key, late ones within the delay included."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
