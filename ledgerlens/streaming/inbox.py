"""A landing folder as a stream: files are read as they arrive, and records and job states appended by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.files import SCHEMA, file_type, supported


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """path, length, content and file_type of the documents that arrive below a folder; job_id from `job_id=` in their path."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = files.where(supported(F.col("path"))).withColumns({"file_type": file_type(F.col("content")), "job_id": F.nullif(F.regexp_extract("path", r"job_id=([^/]+)", 1), F.lit(""))})
    return files.where("file_type <> 'unknown'")


def job_states(records: DataFrame, number: int, output: str) -> DataFrame:
    """What a batch adds to each of its jobs: files processed and failed; the batch's number makes a batch that runs again replace itself."""
    good = F.col("estado").isin("OK", "QUARANTINE")
    counted = records.where("job_id is not null").groupBy("job_id").agg(F.count_if(good).alias("processed"), F.count_if(~good).alias("failed"))
    return counted.select("job_id", F.lit(number).cast("bigint").alias("batch"), F.lit("processing").alias("status"), "processed", "failed", F.lit(output).alias("output_path"))


def process(files: DataFrame, to_records: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, seconds: int = 0):
    """Writes the records of each batch under its number, so that a batch that is run again replaces itself.

    A file that can't be read should come back from `to_records` as a rejected record with its
    error, as `dispatch.process` gives it, so that it doesn't fail its batch. The states of the
    batch's jobs go to out/jobs, its records to out/records.
    """

    def batch(rows: DataFrame, number: int) -> None:
        to_records(rows).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        written = rows.sparkSession.read.parquet(f"{out}/records/batch={number}")
        if "job_id" in written.columns:
            job_states(written, number, out).write.mode("overwrite").parquet(f"{out}/jobs/part={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer).start()


def statuses(states: DataFrame, expected: DataFrame) -> DataFrame:
    """Jobs (id, total_files) with processed, failed and status: queued, processing, done, or failed if all files did."""
    summed = states.groupBy("job_id").agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))
    rows = expected.join(summed, F.col("id") == F.col("job_id"), "left").drop("job_id").na.fill(0, ["processed", "failed"])
    done = F.col("processed") + F.col("failed")
    status = F.when((F.col("total_files") > 0) & (F.col("failed") >= F.col("total_files")), "failed").when(done >= F.col("total_files"), "done").when(done > 0, "processing").otherwise("queued")
    return rows.withColumn("status", status)


def running_counters(records: DataFrame) -> DataFrame:
    """processed and failed files of each job, for a stream of records in update mode."""
    good = F.col("estado").isin("OK", "QUARANTINE")
    return records.groupBy("job_id").agg(F.sum(good.cast("bigint")).alias("processed"), F.sum((~good).cast("bigint")).alias("failed"))
