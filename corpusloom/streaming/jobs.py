"""Job records as a streaming query: one state per job, a timer for silent ones."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import STALE_SECONDS

RECORD = "status string, progress int, message_code string, result_json string, error string, us long"
STATE = "status string, progress int, message_code string, result_json string, error string, ts long, event_id long"


def read_events(spark: SparkSession, folder: str, glob: str = "job_events*.parquet") -> DataFrame:
    """The event log as a stream of files; the schema is read from what is there.

    The pattern names what lies in ``folder``: files, or tables that are folders
    of part files, whatever the parts are called and however deep they lie.
    """
    at = f"{folder.rstrip('/')}/{glob}"
    schema = spark.read.option("recursiveFileLookup", "true").parquet(at).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(at)


UNKNOWN = -(1 << 63)  # an event without a time is older than all others
KEEP_SECONDS = 86_400  # how long an ended job's state waits for late events


def states(events: DataFrame, stale: int = STALE_SECONDS, keep: int = KEEP_SECONDS) -> DataFrame:
    """A row whenever a job's record changes.

    The newest event by event time decides; one that comes late only fills a
    missing result or error.  A repeated event (same job, time and status)
    counts once, by its first id, as in the batch; across batches this holds
    for the event that the record shows.  A job that stays open without events
    for ``stale`` seconds of processing time is failed by its timer.  An ended job
    is kept ``keep`` seconds for events that come late, then its state is
    removed without a row, so states don't grow for ever; what comes later
    still begins a new record.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ("queued", None, None, None, None, UNKNOWN, UNKNOWN)
        if state.hasTimedOut and old[0] in ("queued", "running"):
            new = ("failed", 100, "jobFailed", *old[3:])
            state.update(new)
            state.setTimeoutDuration(keep * 1000)
        elif state.hasTimedOut:
            new = old
            state.remove()
        else:
            rows = [json.loads(e) for batch in batches for e in batch["event"]]
            when = lambda e: tuple(UNKNOWN if e.get(c) is None else e[c] for c in ("us", "event_id"))
            new, seen = old, set()
            for e in sorted(rows, key=when):
                at, status, progress, result, error = when(e), e.get("status"), e.get("progress"), e.get("result_json"), e.get("error")
                status = status.strip().lower() if status else None
                shown = (at[0], status) == (new[5], new[0])
                if (at[0], status) in seen or (shown and at[1] > new[6]):
                    continue
                seen.add((at[0], status))
                progress = None if progress is None else max(0, min(100, int(progress)))
                if at > new[5:7] or shown:
                    new = (status, progress, e.get("message_code"), result or new[3], error or new[4], *at)
                else:
                    new = (*new[:3], new[3] or result, new[4] or error, *new[5:])
            state.update(new)
            state.setTimeoutDuration((stale if new[0] in ("queued", "running") else keep) * 1000)
        if new != old:
            record = (*new[:5], None if new[5] == UNKNOWN else new[5])
            yield pd.DataFrame({"job_id": [key[0]], "record": [json.dumps(dict(zip(names, record)))]})

    # A job has few events: taking every column of every job apart for Python would cost more than the fold.
    names = [c.split()[0] for c in RECORD.split(", ")]
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    packed = events.select("job_id", F.to_json(F.struct("event_id", us, "status", "progress", "message_code", "result_json", "error")).alias("event"))
    folded = packed.groupBy("job_id").applyInPandasWithState(fold, "job_id string, record string", STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    out = folded.select("job_id", F.from_json("record", RECORD).alias("r")).select("job_id", "r.*")
    return out.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "updated_at")


def run_once(events: DataFrame, out: str, checkpoint: str) -> None:
    """Read all there is and write each batch's changes as Parquet, numbered by batch: a repeated batch overwrites itself."""

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    spark, key = events.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    # Timers would ask for batches without data for ever, and a run over all there is would not end.
    spark.conf.set(key, "false")
    try:
        q = states(events).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
