"""Structured Streaming: file streams into keyed targets, with dead letters and rates."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.jobs import isolate_bad_rows
from ..operators.windows import latest_by


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files, limited by the files or the bytes of a trigger (a file that is larger comes alone)."""
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger is not None:
        return reader.option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def stream_migrate(
    stream: DataFrame,
    target: str,
    state: str,
    checks: dict[str, Column] | None = None,
    failed: str | None = None,
    rows_per_second: float | None = None,
    interval: float | None = None,
    seconds: float | None = None,
) -> list[tuple[int, int, float]]:
    """Appends every batch under the stream's id and batch number, so a batch that is repeated after a crash overwrites itself.

    The id is the one that ``state`` keeps; a stream with new state writes beside what others wrote. Rows
    that fail a check go to ``failed`` in the same batch and the stream goes on. Readers take the latest
    version of each key (``stream_target``), which makes the sink an upsert.

    rows_per_second: a batch takes at least as long as its rows allow, so the rate holds over any stretch of whole batches; what
    one batch holds is the source's limit (``file_stream``). interval: seconds between triggers, at which a batch goes out
    however few rows have come; without it the stream takes what is there and ends. seconds: with an interval, how
    long it runs. Returns (batch, rows, seconds) of the batches of this run.
    """
    spark, done = stream.sparkSession, []

    def put(batch: DataFrame, number: int) -> None:
        began, seen = time.monotonic(), Observation()
        query = spark.read.schema("id string").json(f"{state}/metadata").first()["id"]
        folder = f"stream={query}/batch={number}"
        number_of = F.count("*").alias("n")
        if not checks:
            batch.observe(seen, number_of).write.mode("overwrite").parquet(f"{target}/{folder}")
        else:
            kept = batch.persist()
            good, _ = isolate_bad_rows(kept.observe(seen, number_of), checks)
            good.write.mode("overwrite").parquet(f"{target}/{folder}")
            isolate_bad_rows(kept, checks)[1].write.mode("overwrite").parquet(f"{failed}/{folder}")
            kept.unpersist()
        n = seen.get["n"]
        if rows_per_second:
            time.sleep(max(0.0, n / rows_per_second - (time.monotonic() - began)))
        done.append((number, n, time.monotonic() - began))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", state)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=f"{interval} seconds")
    running = writer.start()
    if interval is None or seconds is None:
        running.awaitTermination()
    elif not running.awaitTermination(seconds):
        running.stop()
    return done


def stream_rows(spark: SparkSession, target: str) -> DataFrame:
    """Every row that streams wrote to a target, repeated versions too; folders' names are no columns."""
    return spark.read.option("recursiveFileLookup", "true").parquet(target)


def stream_target(spark: SparkSession, target: str, keys: list[str], version: list[str]) -> DataFrame:
    """The stream's target: the latest version of each key."""
    return latest_by(stream_rows(spark, target), keys, version)


def stream_rates(stream: DataFrame, ts: str, by: str, late: str = "1 minute") -> DataFrame:
    """Rows of each minute; a minute is final once the watermark has passed it."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return s.groupBy(F.window(ts, "1 minute"), by).agg(F.count("*").alias("n"))
