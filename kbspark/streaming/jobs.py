"""Structured Streaming forms of the job-log operators and of incremental chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE = "1800 seconds"


def incremental_chunks(sources: DataFrame, chunker: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, after: int = -1, key: str = "source_id"):
    """Chunks (and whatever chunker adds to them, vectors for one) of new or changed sources.

    Each micro-batch writes what it made and which sources it saw under its own
    number, counted on from `after`, so a repeated batch replaces itself. A
    source whose text has turned blank, or null as for a deleted one, is seen
    without chunks.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{folder}/seen/batch={after + 1 + number}")
        chunker(batch).write.mode("overwrite").parquet(f"{folder}/chunks/batch={after + 1 + number}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark, folder: str, key: str = "source_id") -> DataFrame:
    """Chunks of the last micro-batch that saw their source: none for a source that was blank in it."""
    last = spark.read.parquet(f"{folder}/seen").groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/chunks").join(last, [key, "batch"]).drop("batch")


def activity_sessions(log: DataFrame, late: str = "10 minutes", lease: str = LEASE) -> DataFrame:
    """Sessions of a job's activity that end after `lease` without any; an ended session is what makes a running job stale."""
    s = log.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", lease).alias("w"))
    return s.agg(F.count("*").alias("events")).select("job_id", F.col("w.start").alias("began"), F.col("w.end").alias("expires"), "events")


def one_live_job(submissions: DataFrame, late: str = "10 minutes", lease_ms: int = 1_800_000) -> DataFrame:
    """source, event_id, accepted of each submission: refused while a job of the source is active.

    submissions: source, event_id, ts, kind (submit or end). The active flag is
    set by an accepted submission and cleared by an end event or by the lease.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else 0
        # Arrow cuts a source's rows of a micro-batch anywhere: they are put in order as a whole, three numbers each
        for pdf in [pd.concat(list(batches)).sort_values(["ts", "event_id"])]:
            out = []
            for event, ts, kind in zip(pdf["event_id"], pdf["ts"], pdf["kind"]):
                now = int(ts.value // 1_000_000)
                if kind == "end":
                    until = 0
                else:
                    ok = now >= until
                    until = now + lease_ms if ok else until
                    out.append((key[0], event, ok))
            yield pd.DataFrame(out, columns=["source", "event_id", "accepted"])
        state.update((until,))
        if until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)

    kind = submissions.schema["source"].dataType.simpleString()
    return submissions.withWatermark("ts", late).groupBy("source").applyInPandasWithState(step, f"source {kind}, event_id bigint, accepted boolean", "until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def live_progress(log: DataFrame) -> DataFrame:
    """Latest processed and total of each job, for update or complete mode."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("processed", "total"), "ts").alias("p")).select("job_id", "p.processed", "p.total")
