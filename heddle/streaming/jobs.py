"""Structured Streaming: access counts, event windows, sessions, change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import checkpoint_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else f"{folder}/{name}*")


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all that is there now and read what it wrote.

    Results go through ``foreachBatch`` to parquet in the shared folder; in
    complete mode the last batch holds the whole result.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number if mode != 'complete' else 0}")

    job = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*")


def access_counts(events: DataFrame) -> DataFrame:
    """Running count and last time of each entry's accesses."""
    return events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


def _timed(events: DataFrame) -> DataFrame:
    """Event time with a time zone (UTC), as watermarks need it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly counts and sums; in append mode an hour comes out once the watermark has passed it, and later events are dropped."""
    windowed = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap without events; in append mode each comes out once, when the watermark has passed its end."""
    return _timed(events).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def change_feed(spark: SparkSession, feed: DataFrame, key: str, seq: str, target: str, checkpoint: str, every: str | None = None):  # noqa: ANN201
    """A stream of upserts and deletes merged into the parquet table ``target``, batch by batch.

    ``feed`` has a column ``op`` (upsert or delete).  The newest row of a key
    wins.  Each batch writes the changed version ``target``/v<batch>; a batch
    that runs again after a failure starts from the same version before it.
    ``every`` (as in "500 milliseconds") coalesces writes; without it the job
    takes what is there and ends, as scheduled workers do.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(seq)).alias("r")).select("r.*")
        keep = newest.where("op = 'upsert'").drop("op")
        if number:
            keep = spark.read.parquet(f"{target}/v{number - 1}").join(newest, key, "left_anti").unionByName(keep)
        keep.write.mode("overwrite").parquet(f"{target}/v{number}")

    writer = feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The last whole version of a table that ``change_feed`` writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(f.getPath().getName()[1:]) for f in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{target}/v{max(versions)}")
