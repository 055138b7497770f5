"""Job records as a fold over their events; ``now`` is always given, never read from the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_SECONDS = 300
TERMINAL = ["completed", "failed"]


def cleaned(events: DataFrame) -> DataFrame:
    """Events with lower-case status, each once; progress clamped to 0..100.

    A repeated event (same job, time and status) counts once, by its first id.
    """
    e = events.withColumn("status", F.lower(F.trim("status"))).withColumn("progress", clamp(F.col("progress")))
    first = e.groupBy("job_id", "ts", "status").agg(F.min("event_id").alias("event_id"))
    return e.join(first.select("event_id"), "event_id", "left_semi")


def created(requests: DataFrame, at: str = "created_at") -> DataFrame:
    """The first event of each request's job, in the form of the event log; append it there.

    The job's name is made of the request's id, so creating it twice is one event.
    """
    return requests.select(
        F.concat(F.lit("job-"), F.col("request_id").cast("string")).alias("job_id"), "request_id", F.col(at).alias("ts"), F.lit("queued").alias("status"), F.lit(0).alias("progress"),
        F.lit("Queued").alias("message"), F.lit("jobQueued").alias("message_code"), F.lit(None).cast("string").alias("result_json"), F.lit(None).cast("string").alias("error"),
    ).dropDuplicates(["job_id"])


def clamp(progress: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), progress))


def latest(events: DataFrame) -> DataFrame:
    """One row per job: its last status, progress, message and code; the last result and error that were given.

    Ordered by event time, ties by id, however late an event was received.  A
    null progress or message of the last event stays null, as written.
    """
    at = F.struct("ts", "event_id")
    last = F.max_by(F.struct("status", "progress", "message", "message_code"), at)
    given = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at))
    return (
        cleaned(events)
        .groupBy("job_id")
        .agg(last.alias("l"), given("result_json").alias("result_json"), given("error").alias("error"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        .select("job_id", "l.status", "l.progress", "l.message", "l.message_code", "result_json", "error", "created_at", "updated_at")
    )


def expired(jobs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Jobs with those that are open and silent for longer than ``seconds`` failed."""
    stale = F.col("status").isin("queued", "running") & (F.col("updated_at") < now - F.expr(f"interval {seconds} seconds"))
    return failed(jobs, stale, "jobFailed", now)


def interrupted(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after a restart: whatever was open has failed."""
    return failed(jobs, F.col("status").isin("queued", "running"), "jobInterrupted", now)


def failed(jobs: DataFrame, which: Column, code: str, now: Column) -> DataFrame:
    w = F.coalesce(which, F.lit(False))
    return jobs.withColumns({
        "updated_at": F.when(w, now).otherwise(F.col("updated_at")),
        "progress": F.when(w, 100).otherwise(F.col("progress")),
        "message_code": F.when(w, code).otherwise(F.col("message_code")),
        "status": F.when(w, "failed").otherwise(F.col("status")),
    })


def emissions(events: DataFrame) -> DataFrame:
    """What a listener is sent: (job_id, event_id, ts, event, status, progress, message_code).

    Only events that change the snapshot, up to the first terminal one.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    snap = F.struct("status", "progress", "message", "message_code", "result_json", "error")
    e = cleaned(events).withColumn("_before", F.lag(snap).over(w)).withColumn("_snap", snap)
    ended = F.sum(F.col("status").isin(TERMINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_ended", F.coalesce(ended, F.lit(0))).where("_ended = 0")
    kind = F.when(F.col("status") == "completed", "result").when(F.col("status") == "failed", "error").otherwise("progress")
    return e.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_snap"))).select("job_id", "event_id", "ts", kind.alias("event"), "status", "progress", "message_code")


def silences(events: DataFrame, seconds: float) -> DataFrame:
    """Sessions of a job's events without a silence of ``seconds``: job_id, started, ended, n_events."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > int(seconds * 1_000_000)
    e = cleaned(events).withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("job_id", "_s").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events")).drop("_s")


def debounced(events: DataFrame, millis: int = 450) -> DataFrame:
    """Events that nothing follows within ``millis``: the writes that a debounced saver makes."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    wait = F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")
    return cleaned(events).withColumn("_w", wait).where(F.col("_w").isNull() | (F.col("_w") > millis * 1000)).select("job_id", "event_id", "ts", "status")
