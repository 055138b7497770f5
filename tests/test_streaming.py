import datetime as dt
import time

from corpusloom.streaming import jobs

KIND = "event_id long, job_id string, request_id long, ts timestamp, received_at timestamp, status string, progress int, message string, message_code string, result_json string, error string"


def test_stream_keeps_the_newest_state(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    kind = "event_id long, job_id string, request_id long, ts timestamp, received_at timestamp, status string, progress int, message string, message_code string, result_json string, error string"
    rows = [(1, "a", 1, t, t, "queued", 0, None, None, None, None), (3, "a", 1, t + dt.timedelta(seconds=9), t, "COMPLETED", 120, None, "x", None, None), (2, "a", 1, t + dt.timedelta(seconds=5), t, "running", 40, None, None, "{}", None), (4, "b", 2, t, t, None, None, None, None, None, None)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / "job_events.parquet"))
    jobs.run_once(jobs.read_events(spark, str(tmp_path / "in"), "*.parquet"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.job_id: (r.status, r.progress, r.result_json) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("completed", 100, "{}"), "b": (None, None, None)}


def test_timers_and_late_events(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    at = str(tmp_path / "in")
    row = lambda i, job, sec, status, result=None: (i, job, 1, t + dt.timedelta(seconds=sec), t, status, 10, None, None, result, None)
    add = lambda rows: spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(at)
    add([row(1, "open", 0, "running"), row(2, "done", 9, "completed")])
    seen = []

    def sink(df, _batch):
        seen.extend((r.job_id, r.status, r.message_code, r.result_json) for r in df.collect())

    events = spark.readStream.schema(KIND).parquet(at)
    q = jobs.states(events, stale=3, keep=60).writeStream.outputMode("update").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(sink).start()
    try:
        until = time.time() + 90
        while time.time() < until and ("open", "failed", "jobFailed", None) not in seen:
            time.sleep(0.5)
        # Late: older than the end, so it only fills the result that was missing.
        add([row(3, "done", 5, "running", "{}")])
        while time.time() < until and ("done", "completed", None, "{}") not in seen:
            time.sleep(0.5)
    finally:
        q.stop()
    assert ("open", "failed", "jobFailed", None) in seen and ("done", "completed", None, "{}") in seen and ("done", "running", None, "{}") not in seen


def test_stream_reads_tables_that_are_folders_and_single_files(spark, tmp_path):
    from corpusloom.plans.queries import QUERIES

    t = dt.datetime(2025, 1, 1)
    row = lambda i, job, status: (i, job, 1, t + dt.timedelta(seconds=i), t, status, 10, None, None, None, None)
    df = spark.createDataFrame([row(1, "a", "queued"), row(2, "b", "queued"), row(3, "a", "running"), row(4, "c", "completed"), (5, "d", 1, None, t, "running", 10, None, None, None, None)], KIND)
    at_second = lambda s: t + dt.timedelta(seconds=s)
    want = {"a": ("running", at_second(3)), "b": ("queued", at_second(2)), "c": ("completed", at_second(4)), "d": ("running", None)}
    # A folder of part files, and beside it a table that is not to be read.
    df.repartition(3).write.parquet(str(tmp_path / "folder" / "job_events.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "folder" / "requests.parquet"))
    # The same as one file.
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "file" / "job_events.parquet")
    for at in ("folder", "file"):
        got = QUERIES["job_stream_state"](spark, str(tmp_path / at)).collect()
        assert {r.job_id: (r.status, r.updated_at) for r in got} == want and len(got) == 4


def test_stream_counts_repeated_events_once_by_their_first_id(spark, tmp_path):
    t, at = dt.datetime(2025, 1, 1), str(tmp_path / "in" / "log.parquet")
    row = lambda i, job, sec, status, progress, result=None: (i, job, 1, t + dt.timedelta(seconds=sec), t, status, progress, None, None, result, None)

    def run(rows, batch):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(at)
        jobs.run_once(jobs.read_events(spark, str(tmp_path / "in"), "*.parquet"), str(tmp_path / "out"), str(tmp_path / "cp"))
        return {r.job_id: (r.status, r.progress, r.result_json) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={batch}")).collect()}

    first = [row(5, "a", 9, "completed", 100, "1"), row(8, "a", 9, "COMPLETED", None, "2"), row(6, "b", 9, "running", 40), row(7, "b", 9, "failed", 100), row(9, "b", 9, "running", 60), row(5, "c", 9, "running", 40)]
    assert run(first, 0) == {"a": ("completed", 100, "1"), "b": ("failed", 100, None), "c": ("running", 40, None)}
    # In a later batch: repeats change nothing, but the one with a lower id takes the record over.
    assert run([row(10, "a", 9, "completed", 7, "3"), row(4, "c", 9, "running", 50)], 1) == {"c": ("running", 50, None)}
