"""A job store on Structured Streaming: files that arrive become jobs, whose states are a log that is only appended to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import friendly_error
from folioscope.sources.files import read_json
from folioscope.streaming.admission import TTL, expired, latest_status

#: seq orders the states of a job that a batch writes at one time.
LOG = "id string, name string, status string, error string, bookmark_count long, ts double, seq int"
#: Seconds between two sweeps of old jobs.
SWEEP = 300


def run_jobs(stream: DataFrame, process: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, **trigger):
    """Start a query that turns each row of a stream of files (id, name, ...) into a job and logs its states.

    process(batch) returns (id, status, bookmark_count) with `done` or the name of an error.  A batch is logged as queued
    and processing before it is worked on and as done or failed after; one that is run again after a crash logs the same
    states again, which changes no latest state.  Nothing but LOG is stored, so no key of a caller can be.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            jobs = batch.select("id", "name")
            for seq, status in enumerate(("queued", "processing")):
                _append(jobs.withColumns({"status": F.lit(status), "seq": F.lit(seq)}), log)
            done = jobs.join(process(batch).select("id", F.col("status").alias("s"), "bookmark_count"), "id", "left")
            ok = F.col("s") == "done"
            told = done.withColumns(
                {
                    "status": F.when(ok, "done").otherwise("failed"),
                    "error": F.when(~F.coalesce(ok, F.lit(False)), friendly_error(F.coalesce("s", F.lit("")))),
                    "bookmark_count": F.when(ok, F.col("bookmark_count").cast("long")),
                    "seq": F.lit(2),
                }
            )
            _append(told.drop("s"), log)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def _append(rows: DataFrame, log: str) -> None:
    have = rows.columns
    kinds = dict(c.split(" ") for c in LOG.split(", "))
    rows = rows.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6)
    rows.select(*((F.col(c) if c in have or c == "ts" else F.lit(None)).cast(k).alias(c) for c, k in kinds.items())).write.mode("append").json(log)


def jobs(spark: SparkSession, log: str) -> DataFrame:
    """The latest state of every job: id, name, status, error, bookmark_count, created_at, updated, download (its file's name once done)."""
    rows = read_json(spark, log, LOG)
    first = rows.groupBy("id").agg(F.min("ts").alias("created_at"), F.max_by(F.struct("name", "error", "bookmark_count"), F.struct("ts", "seq")).alias("x"))
    out = latest_status(rows, "seq").join(first, "id").select("id", "x.*", "status", "created_at", "updated")
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*\z", "")
    return out.withColumn("download", F.when(F.col("status") == "done", F.concat(stem, F.lit(".bookmarked.pdf"))))


def sweep(spark: SparkSession, log: str, now: float, ttl: float = TTL) -> DataFrame:
    """The jobs whose files may go at `now`; a caller runs it every SWEEP seconds, and again for those it could not delete."""
    return jobs(spark, log).where(expired(F.col("status"), F.col("created_at"), F.lit(now), ttl))
