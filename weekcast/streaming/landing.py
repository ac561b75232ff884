"""Continuous versions of landing ingest, job de-duplication and the per-provider call rate.

Each result equals its batch counterpart; sinks are written per micro-batch so that a retried batch
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from weekcast.operators.ledger import counted
from weekcast.sources.landing import split_quarantine, validate_vendor_a


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    (
        rows.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def landing_sink(accepted_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: validated responses to one table, rejected ones whole to another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_vendor_a(batch).persist()
        accepted, rejected = split_quarantine(checked)
        _write_batch(accepted, accepted_path, batch_id)
        _write_batch(rejected, quarantine_path, batch_id)
        checked.unpersist()

    return write


def start_landing(responses: DataFrame, accepted_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    """Ingest what has landed so far, then stop; run again for what lands later."""
    return (
        responses.writeStream.foreachBatch(landing_sink(accepted_path, quarantine_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_jobs(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per dedupe key; repeats up to ``delay`` apart are dropped, state older than that is freed."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def call_rate(events: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", delay: str = "5 minutes") -> DataFrame:
    """Counted calls (by ``status``) per provider and sliding window; events behind the watermark are dropped.

    A window comes out once the watermark has passed its end, so the newest ones wait for later events.
    """
    window = F.window("ts", width, slide)
    return (
        events.withWatermark("ts", delay)
        .filter(counted(F.col("status")))
        .groupBy("provider", window.alias("w"))
        .agg(F.count("*").alias("calls"))
        .select("provider", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a finished stream's rows to Parquet and wait for the end of the available data."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
