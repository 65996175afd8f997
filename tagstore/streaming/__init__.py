"""Streaming twins: change feeds, buffered inserts and windowed counts with late data."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def feed(spark: SparkSession, path: str, schema, files_per_trigger=1) -> DataFrame:
    """A growing folder of table files as a stream, at a bounded rate."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, late="10 minutes", width="1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # table files may hold times without a zone
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, path: str, checkpoint: str, capacity: int):
    """Append every micro-batch as one sorted run of files of `capacity` records at most; batch numbers make a repeated batch overwrite itself."""

    def put(batch, number):
        batch.sortWithinPartitions("key").write.mode("overwrite").option("maxRecordsPerFile", capacity).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
