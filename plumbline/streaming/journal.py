"""Journals as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.store import shared_dir


def windowed_counts(entries: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Entries by window and message; those later than the watermark are dropped by the engine."""
    return entries.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "message").agg(F.count("*").alias("entries"))


def matched_responses(requests: DataFrame, responses: DataFrame, within: str = "1 hour") -> DataFrame:
    """Requests with the responses that others post for them, by id, while both are recent. Works on streams and tables."""
    a = requests.withWatermark("asked", within) if requests.isStreaming else requests
    b = responses.withWatermark("answered", within) if responses.isStreaming else responses
    near = (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (a.request_id == b.response_id) & near)


def counts_of_stream(spark: SparkSession, path: str) -> DataFrame:
    """(day, message, entries) of the event files at path, read as a stream until all that is there is counted."""
    kind = F.col("event_type")
    message = F.when(kind == "view", "queuing item").when(kind == "click", "translated sut response").when(kind == "purchase", "measured item quality").when(kind == "error", "sut exception").otherwise("using test items")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder, _, name = path.rpartition("/")
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", name).parquet(folder)  # streams read folders
    counted = windowed_counts(stream.select(F.col("ts").cast("timestamp").alias("ts"), message.alias("message")))
    place, done = f"{shared_dir(spark).rstrip('/')}/counts/{uuid.uuid4().hex}", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/{number}")
        done.append(number)

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(counted.schema).parquet(f"{place}/{done[-1]}") if done else spark.createDataFrame([], counted.schema)
    return kept.select(F.col("w.start").cast("date").alias("day"), "message", "entries")
