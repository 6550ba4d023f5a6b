"""The worker loop: submitted jobs arrive as a stream, each batch is committed once, and due jobs are claimed, handled and recorded.

Jobs live in a commit store as rows per change (``jobs``: the newest row of a job counts), so a poll writes what it changes and no more. A poll
takes back expired leases and claims the next due jobs in one commit, made from the version it read: of two workers that claim at once the
second one's commit fails, and it reads anew, so no job is claimed twice. Handling runs on the executors, a partition of jobs at a time, and one
job's failure is that job's alone. Results are recorded in a second commit, for jobs that the worker still holds; a result whose lease went to
another worker is discarded. If a worker dies in between, its jobs come back when their lease ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff
from ..functions.values import JOB_ERRORS
from ..sources.commits import Store

SCHEMA = "job_id long, payload string, status string, attempts int, owner string, lease_until timestamp, available_at timestamp, created_at timestamp, error_code string, result string, rev long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class JobError(Exception):
    """A handler's failure with a status that ``JOB_ERRORS`` classifies; other exceptions are internal errors, which are retried."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(message)
        self.status = status


def jobs(store: Store, version: int | None = None) -> DataFrame:
    """Every job as it is now: the newest of its rows."""
    rows = store.table("jobs", version)
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in COLUMNS if c != "job_id"]), "rev").alias("j")).select("job_id", "j.*").select(*COLUMNS)


def submit(store: Store, batch: DataFrame, now: datetime, number: tuple[str, int] | None = None) -> int:
    """Rows (job_id, payload) as pending jobs; ids that are known already, or repeated, are submitted once. ``number``: an idempotency token."""

    def change(store: Store, at: int) -> dict:
        fresh = batch.select("job_id", "payload").groupBy("job_id").agg(F.min("payload").alias("payload"))
        if store.has("jobs"):
            fresh = fresh.join(store.table("jobs", at).select("job_id").distinct(), "job_id", "left_anti")
        time = F.lit(now).cast("timestamp")
        made = fresh.select(
            "job_id", "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("timestamp").alias("lease_until"),
            time.alias("available_at"), time.alias("created_at"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("result"), F.lit(at + 1).cast("long").alias("rev"),
        )
        return {"append": {"jobs": made}}

    return store.transact(change, batch=number)


def reclaim(rows: DataFrame, now: Column, most: int) -> DataFrame:
    """The rows whose lease has ended, waiting again or failed after ``most`` attempts."""
    gone = rows.filter((F.col("status") == "running") & (F.col("lease_until") < now))
    return gone.withColumns({
        "status": F.when(F.col("attempts") >= most, "failed").otherwise("retry_wait"), "owner": F.lit(None).cast("string"),
        "lease_until": F.lit(None).cast("timestamp"), "available_at": now, "error_code": F.lit("lease_expired"),
    })


def claim(store: Store, worker: str, now: datetime, n: int, lease: int, most: int = 3) -> DataFrame:
    """Take back expired leases, claim the next ``n`` due jobs (oldest availability, then creation, then id), and return those this worker holds."""
    time = F.lit(now).cast("timestamp")

    def change(store: Store, at: int) -> dict:
        rows = jobs(store, at)
        back = reclaim(rows, time, most)
        free = rows.join(back.select("job_id"), "job_id", "left_anti").unionByName(back)
        due = free.filter(F.col("status").isin("pending", "retry_wait") & (F.col("available_at") <= time) & (F.col("attempts") < most))
        taken = due.orderBy("available_at", "created_at", "job_id").limit(n)
        held = taken.withColumns({
            "status": F.lit("running"), "attempts": F.col("attempts") + 1, "owner": F.lit(worker), "error_code": F.lit(None).cast("string"),
            "lease_until": F.timestamp_seconds(F.unix_timestamp(time) + lease),
        })
        # of a job taken back and claimed in one poll, the claim is the newer row
        both = back.join(taken.select("job_id"), "job_id", "left_anti").unionByName(held).withColumn("rev", F.lit(at + 1).cast("long"))
        return {"append": {"jobs": both.select(*COLUMNS)}}

    at = store.transact(change)
    return jobs(store, at).filter((F.col("status") == "running") & (F.col("owner") == worker) & (F.col("rev") == at))


def handle(claimed: DataFrame, handler: Callable[[int, str], str]) -> DataFrame:
    """(job_id, attempts, result, error_code, retry): ``handler(job_id, payload)`` of each job; an exception becomes the job's error class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job, payload, attempts in zip(frame["job_id"], frame["payload"], frame["attempts"]):
                try:
                    out.append((job, attempts, handler(int(job), payload), None, None))
                except Exception as error:  # one job's failure is its own
                    code, retry = JOB_ERRORS.get(getattr(error, "status", None), ("internal_error", True))
                    out.append((job, attempts, None, code, retry))
            yield pd.DataFrame(out, columns=["job_id", "attempts", "result", "error_code", "retry"])

    return claimed.select("job_id", "payload", "attempts").mapInPandas(run, "job_id long, attempts int, result string, error_code string, retry boolean")


def record(store: Store, worker: str, outcomes: DataFrame, now: datetime, most: int = 3, base: int = 60, longest: int = 600) -> int:
    """Results of the jobs that the worker still holds in the attempt it handled; the others are discarded."""
    time = F.lit(now).cast("timestamp")
    done = outcomes.select("job_id", F.col("attempts").alias("_attempts"), F.col("result").alias("_result"), F.col("error_code").alias("_error"), F.col("retry").alias("_retry"))

    def change(store: Store, at: int) -> dict:
        held = jobs(store, at).filter((F.col("status") == "running") & (F.col("owner") == worker)).join(done, "job_id").filter("attempts = _attempts")
        again = F.col("_error").isNotNull() & F.col("_retry") & (F.col("attempts") < most)
        status = F.when(F.col("_error").isNull(), "succeeded").when(again, "retry_wait").otherwise("failed")
        later = F.timestamp_seconds(F.unix_timestamp(time) + backoff(F.col("attempts"), base, longest))
        rows = held.withColumns({
            "status": status, "owner": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp"), "available_at": F.when(again, later).otherwise(F.col("available_at")),
            "error_code": F.col("_error"), "result": F.col("_result"), "rev": F.lit(at + 1).cast("long"),
        })
        return {"append": {"jobs": rows.select(*COLUMNS)}}

    return store.transact(change)


def poll(store: Store, worker: str, handler: Callable[[int, str], str], now: datetime, n: int, lease: int = 600, most: int = 3) -> int:
    """One turn of the loop; the number of jobs handled."""
    claimed = claim(store, worker, now, n, lease, most)
    # handled once: what is recorded must be what was done
    folder, schema = store.stage(handle(claimed, handler))
    outcomes = store.spark.read.schema(schema).parquet(f"{store.path}/data/{folder}")
    handled = outcomes.count()
    if handled:
        record(store, worker, outcomes, now, most)
    store.drop(folder)
    return handled


def worker_stream(submissions: DataFrame, store: Store, worker: str, handler: Callable[[int, str], str], clock: Callable[[], datetime], checkpoint: str, n: int = 1000, lease: int = 600, most: int = 3):
    """Submissions (job_id, payload) as a stream, to a started query: each batch is submitted once, then due jobs are polled until none is left."""

    def batch(rows: DataFrame, number: int) -> None:
        submit(store, rows, clock(), (worker, number))
        while poll(store, worker, handler, clock(), n, lease, most):
            pass

    return submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
