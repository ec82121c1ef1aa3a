"""The life of jobs as keyed state of a stream of events: queued, processing, done or failed, and expired.

An event has job_id, kind, at (event time) and, by its kind,

- created: total_files;
- file: archivo and estado (OK and QUARANTINE count as processed, all else as failed);
- ended: error, null if the job's export was written.

A job is queued when created, processing from its first file on, done once it ended or all its files
are there, and failed if it ended with an error. `keep` after its end (the time of its latest event)
its result expires, by a timer of event time, and its state is dropped. A file that comes again
counts once. Events later than the watermark are dropped, so what is remembered of a job's files is
bounded by its files, and what of all jobs by those not yet expired. Files may come before their job
is created; a job that is created twice keeps its first count. Events without a job or a time are
dropped.

The state's keys are buckets of jobs, so a batch asks the state store for each bucket, not for each
job and file; a bucket that has events is read and written as a whole, with the files of its jobs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators.jobs import latest

EVENTS = "job_id string, kind string, at timestamp, total_files int, archivo string, estado string, error string"
CHANGES = "job_id string, status string, total_files int, processed int, failed int, error string, updated_at timestamp, version bigint"
#: Buckets of jobs, the keys of the state; a checkpoint's are never others. Places of a job's state.
BUCKETS = 2_048
TOTAL, PROCESSED, FAILED, ENDED, ERROR, LAST, VERSION, FILES = range(8)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """The jobs of a bucket: [total_files, processed, failed, ended, error, last, version, files] by job, as JSON, and the bucket's timer, at the earliest end of a job's keeping."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "jobs string, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said, timer = self.jobs.get() if self.jobs.exists() else ("{}", None)
        jobs, changed = json.loads(said), {}
        for frame in rows:
            for event in map(json.loads, frame["event"]):
                name, at, kind = event["job_id"], event["ms"], event.get("kind")
                job = jobs.setdefault(name, [None, 0, 0, False, None, at, 0, []])
                files = changed.get(name)
                if files is None:
                    files = changed[name] = dict.fromkeys(job[FILES])
                job[LAST] = max(job[LAST], at)
                if kind == "created":
                    job[TOTAL] = event.get("total_files") if job[TOTAL] is None else job[TOTAL]
                elif kind == "ended":
                    job[ENDED], job[ERROR] = True, job[ERROR] or event.get("error")
                elif kind == "file" and (file := event.get("archivo")) not in files:
                    files[file] = None
                    job[PROCESSED if event.get("estado") in ("OK", "QUARANTINE") else FAILED] += 1
        for name, files in changed.items():
            jobs[name][FILES] = list(files)
            jobs[name][VERSION] += 1
        self._keep(jobs, timer)
        yield self._changes({name: jobs[name] for name in changed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        said, timer = self.jobs.get() if self.jobs.exists() else ("{}", None)
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            now, jobs = timerValues.getCurrentWatermarkInMs(), json.loads(said)
            expired = {name: job for name, job in jobs.items() if (due := self._due(job)) is not None and (due <= timer or due < now)}
            self._keep({name: job for name, job in jobs.items() if name not in expired}, None)  # the timer that fired is gone
            for job in expired.values():
                job[VERSION] += 1
            yield self._changes(expired, "expired")

    def _due(self, job: list) -> int | None:
        over = job[ENDED] or (job[TOTAL] is not None and job[TOTAL] > 0 and job[PROCESSED] + job[FAILED] >= job[TOTAL])
        return job[LAST] + self.keep_ms if over else None

    def _keep(self, jobs: dict[str, list], timer: int | None) -> None:
        first = min((due for job in jobs.values() if (due := self._due(job)) is not None), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if jobs:
            self.jobs.update((json.dumps(jobs), first))
        else:
            self.jobs.clear()

    def _changes(self, jobs: dict[str, list], status: str | None = None) -> pd.DataFrame:
        of = lambda job: status or ("failed" if job[ERROR] else "done" if self._due(job) is not None else "processing" if job[PROCESSED] + job[FAILED] else "queued")
        rows = [(name, of(job), job[TOTAL], job[PROCESSED], job[FAILED], job[ERROR], job[LAST], job[VERSION]) for name, job in jobs.items()]
        return pd.DataFrame(rows, columns=["job_id", "status", "total_files", "processed", "failed", "error", "ms", "version"]).astype({"total_files": "Int32"})

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "1 hour", keep_seconds: int = 3_600) -> DataFrame:
    """What the events (a stream, or a table as one batch) change of their jobs, under the columns of CHANGES; the largest version is a job's last."""
    marked = events.where("job_id is not null and at is not null").withWatermark("at", late)
    event = F.to_json(F.struct("job_id", "kind", F.unix_millis("at").alias("ms"), "total_files", "archivo", "estado", "error"))
    by_bucket = marked.select(F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int").alias("bucket"), "at", event.alias("event")).groupBy("bucket")
    found = by_bucket.transformWithStateInPandas(Lifecycle(keep_seconds * 1_000), CHANGES.replace("updated_at timestamp", "ms bigint"), "Update", "EventTime")
    return found.withColumn("updated_at", F.timestamp_millis("ms")).select(*[c.split()[0] for c in CHANGES.split(", ")])


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "1 hour", keep_seconds: int = 3_600, once: bool = True, seconds: int = 0, partitions: int | None = None):
    """Starts the stream of parquet event files that arrive in a folder; changes go to out, each batch's under its number, so that a batch that runs again replaces itself.

    The state has as many partitions as the session shuffles to, or those asked for, for as long as
    the checkpoint lives. The stream has a session of its own for its state store's settings.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    session.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    events = session.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = changes(events, late, keep_seconds).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer).start()


def states(spark: SparkSession, out: str) -> DataFrame:
    """Each job's latest state."""
    return latest(spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(out), "job_id").where(F.col("job_id").isNotNull())
