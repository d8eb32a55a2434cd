"""Streams: dump arrival, cleaning, embedding of new keys, dedup, alerts and metrics.

Every starter returns a running query that works off what is there and stops (``available_now``) or keeps
going with the given trigger. Checkpoints go to the folder the caller names, which all executors must share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.operators.extract import clean_jobs
from postlens.operators.quality import latency_histogram
from postlens.schemas import RAW_SCHEMA
from postlens.sources.jsonl import DUMP_GLOB, DUMP_PATH, parse_raw_lines, raw_jobs, tag_run


def _start(df: DataFrame, path: str, checkpoint: str, trigger: str | None, partition: str | None = None) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition:
        writer = writer.partitionBy(partition)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def dump_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw jobs of every new raw/{source}/{run}/dump.jsonl* file, tagged from its path.

    A gzipped file is read by one task whatever its size, and a batch may have one file only. Its lines are dealt to all
    cores before they are parsed.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(f"{root}/{DUMP_GLOB}").select(
        "value",
        F.regexp_extract("_metadata.file_path", DUMP_PATH, 1).alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    dealt = lines.repartition(spark.sparkContext.defaultParallelism)
    tagged = tag_run(dealt, "path", "modified").filter("run_status = 'ok'")
    return parse_raw_lines(tagged, F.col("run_source"), F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ss"))


def stream_ingest(
    spark: SparkSession, root: str, path: str, checkpoint: str, trigger: str | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """Append the raw jobs of new dumps to the day-partitioned raw table."""
    rows = raw_jobs(dump_stream(spark, root, files_per_batch)).withColumn("date", F.to_date("scrape_timestamp"))
    return _start(rows, path, checkpoint, trigger, "date")


def raw_stream(spark: SparkSession, raw_path: str) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).parquet(raw_path)


def stream_clean(spark: SparkSession, raw_path: str, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append the cleaned form of new raw jobs."""
    rows = clean_jobs(raw_stream(spark, raw_path)).withColumn("date", F.to_date("scrape_timestamp"))
    return _start(rows, path, checkpoint, trigger, "date")


def stream_embed_new(
    jobs: DataFrame,
    embed_batch: Callable[[DataFrame, DataFrame], DataFrame],
    target: str,
    target_schema: str,
    checkpoint: str,
    trigger: str | None = None,
) -> StreamingQuery:
    """Embed the jobs of each batch that the target does not hold yet.

    ``embed_batch`` gets the batch and the embeddings stored so far. Each batch writes its own folder, so a
    repeated batch replaces its first attempt instead of adding to it.
    """

    spark = jobs.sparkSession
    spark.createDataFrame([], target_schema).write.mode("overwrite").parquet(f"{target}/batch=-1")

    def run(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.schema(target_schema).option("recursiveFileLookup", "true").parquet(target)
        known = stored.filter(~F.col("_metadata.file_path").contains(f"/batch={batch_id}/"))
        embed_batch(batch, known).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def dedup_versions(events: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """One row per key; the watermark bounds how long a delivered version is remembered."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def error_burst_stream(events: DataFrame, ts: str, is_error: Column, more_than: int = 2, span: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Closed time slots with more than ``more_than`` errors."""
    counted = events.withWatermark(ts, delay).filter(is_error).groupBy(F.window(ts, span).alias("w")).agg(F.count("*").alias("errors"))
    return counted.filter(F.col("errors") > more_than).select(F.col("w.start").alias("slot_start"), F.col("w.end").alias("slot_end"), "errors")


def silence_stream(events: DataFrame, key: str, ts: str, longer_than: str = "25 hours", delay: str = "10 minutes") -> DataFrame:
    """Sessions that ended because nothing arrived for the given span."""
    sessions = events.withWatermark(ts, delay).groupBy(F.col(key), F.session_window(ts, longer_than).alias("s"))
    counted = sessions.agg(F.max(ts).alias("silent_from"), F.count("*").alias("n"))
    return counted.select(key, "silent_from", F.col("s.end").alias("alert_at"), "n")


def metrics_stream(events: DataFrame, ts: str, value: str, bounds: list[float], labels: list[str], span: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Latency histogram per label set and closed time slot."""
    slotted = events.withWatermark(ts, delay).withColumn("w", F.window(ts, span))
    histogram = latency_histogram(slotted, value, bounds, ["w", *labels])
    return histogram.select(F.col("w.start").alias("slot_start"), *labels, "le", "cumulative", "observations", "total")


def start_table(df: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append any of the above to a parquet table."""
    return _start(df, path, checkpoint, trigger)
