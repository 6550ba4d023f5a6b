"""Conversations and jobs: last turns, composed queries, feeds of changes, leases, retries."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import JOB_ERRORS


def last_turns(turns: DataFrame, k: int, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last k turns of each conversation; the rank filter is pushed below the shuffle."""
    back = Window.partitionBy(conv).orderBy(F.col(order).desc())
    return turns.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= k).drop("_n")


def composed(turns: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Each user turn as a query: the user's turn before it that isn't blank, then itself."""
    own = Window.partitionBy(conv).orderBy(order)
    asked = turns.filter((F.col("role") == "user") & (F.trim(text) != ""))
    return asked.select(conv, order, F.concat_ws("\n", F.lag(text).over(own), F.col(text)).alias("query"))


def changes(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Events that change the state of their key; the first one does."""
    own = Window.partitionBy(key).orderBy(order)
    return events.withColumn("_was", F.lag(state).over(own)).filter(~F.col("_was").eqNullSafe(F.col(state))).drop("_was")


def error_class(status: Column) -> Column:
    """Struct (code, retry) of a status; unknown ones are internal and retried."""
    made = lambda code, retry: F.struct(F.lit(code).alias("code"), F.lit(retry).alias("retry"))
    out = F.when(F.lit(False), made("", False))
    for s, (code, retry) in JOB_ERRORS.items():
        out = out.when(status == s, made(code, retry))
    return out.otherwise(made("internal_error", True))


def job_fold(events: DataFrame, job: str = "job_id", order: str = "seq", most: int = 3) -> DataFrame:
    """A job's state after all its events, one aggregation. Events: claim, heartbeat, complete, fail, fail_final, cancel.

    Failures that may be retried lead to retry_wait until ``most`` attempts; the last event but heartbeats decides
    otherwise. ``lease_from``: the running job's last claim or heartbeat, from which its lease counts. A job with
    heartbeats alone has no status.
    """
    what = F.col("event")
    last = F.max_by("event", F.when(what != "heartbeat", F.col(order)))
    own = events.groupBy(job).agg(F.count_if(what == "claim").alias("attempts"), last.alias("last"), F.max(F.when(what.isin("claim", "heartbeat"), F.col(order))).alias("_lease"))
    state = F.when(F.col("last") == "claim", "running").when(F.col("last") == "complete", "succeeded").when(F.col("last") == "cancel", "cancelled").when(F.col("last") == "fail_final", "failed").when(F.col("attempts") < most, "retry_wait").otherwise("failed")
    state = F.when(F.col("last").isNotNull(), state)
    return own.select(job, "attempts", F.when(F.col("last") == "claim", F.col("_lease")).alias("lease_from"), state.alias("status"))


def reclaimed(jobs: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Running jobs with an expired lease: waiting again, or failed after ``most`` attempts."""
    expired = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    return jobs.withColumn("status", F.when(expired, F.when(F.col("attempt_count") >= most, "failed").otherwise("retry_wait")).otherwise(F.col("status"))).withColumn("error_code", F.when(expired, "lease_expired").otherwise(F.col("error_code")))


def next_jobs(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The n jobs to claim next: queued or waiting ones that are due, oldest first, then id."""
    due = jobs.filter(F.col("status").isin("queued", "retry_wait") & (F.col("available_at") <= now))
    return due.orderBy("created_at", "job_id").limit(n)


def claimed(jobs: DataFrame, now: Column, workers: list[str], n: int, lease: int) -> DataFrame:
    """The next n jobs as their workers claim them, in turn: running, one attempt more, with a lease of so many seconds."""
    turn = F.row_number().over(Window.orderBy("created_at", "job_id")) - 1
    worker = F.element_at(F.array(*map(F.lit, workers)), F.pmod(turn, F.lit(len(workers))) + 1)
    # at most n rows, cut before the numbering
    return next_jobs(jobs, now, n).withColumns({
        "worker": worker, "status": F.lit("running"), "attempt_count": F.col("attempt_count") + 1, "lease_expires_at": F.timestamp_seconds(F.unix_timestamp(now) + lease),
    })


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions that end after a gap: (key, start, stop, n)."""
    got = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def activity(events: DataFrame, key: str, ts: str, idle: int, span: int = 86_400) -> DataFrame:
    """(key, island, at): each event's time and that of the first event it is linked to by gaps under ``idle`` seconds, all in ms.

    Events are compared within spans of time; only the spans' first and last times are compared over a whole key, so a key with a large share of
    all events is many tasks' work. Events without a key or time are nobody's and left out.
    """
    rows = events.select(F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("at")).filter("key IS NOT NULL AND at IS NOT NULL").withColumn("span", F.floor(F.col("at") / (span * 1000)))
    inside, over = Window.partitionBy("key", "span").orderBy("at"), Window.partitionBy("key").orderBy("span")
    fresh = F.col("at") - F.lag("at").over(inside) >= idle * 1000
    rows = rows.withColumn("begun", F.when(fresh, F.col("at"))).withColumn("begun_here", F.max("begun").over(inside))
    ends = rows.groupBy("key", "span").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("begun").alias("inner"))
    before = F.lag("last").over(over)
    ends = ends.withColumn("opened", F.when(before.isNull() | (F.col("first") - before >= idle * 1000), F.col("first")))
    carried = F.last(F.coalesce("inner", "opened"), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("key", "span", F.coalesce("opened", carried).alias("earlier"))
    return rows.join(ends, ["key", "span"]).select("key", F.coalesce("begun_here", "earlier").alias("island"), "at")


def limited_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", idle: int = 1800, longest: int = 43_200) -> DataFrame:
    """Sessions that end ``idle`` seconds after their last event, or ``longest`` after their first: (key, start, stop, n, ended: idle or age).

    An event at the very end is too late and opens the next session. Where each session of a stretch of activity begins depends on the one
    before, so a stretch is one task's, as a stream of times in constant memory; a step finds the end of a session in a sorted batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, start, last, n, out = None, 0, 0, 0, []
        for batch in batches:
            keys, island, at = batch.column("key"), batch.column("island").to_numpy(), batch.column("at").to_numpy()
            if not len(at):
                continue
            names = keys.dictionary_encode()
            code = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (island[1:] != island[:-1])) + 1).tolist(), len(at)]
            for a, b in itertools.pairwise(cuts):
                own, times = (names.dictionary[int(code[a])].as_py(), int(island[a])), at[a:b]
                if own != same:
                    if same is not None:
                        out.append((same[0], start, last, n))
                    same, start, n = own, int(times[0]), 0
                while True:
                    stop = int(np.searchsorted(times, start + longest * 1000))
                    if stop:
                        last, n = int(times[stop - 1]), n + stop
                    if stop == len(times):
                        break
                    out.append((same[0], start, last, n))
                    times = times[stop:]
                    start, n = int(times[0]), 0
            yield told(out, keys.type)
            out = []
        if same is not None:
            yield told([(same[0], start, last, n)], kind)

    def told(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["key", "start", "last", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = activity(events, key, ts, idle)
    kind = to_arrow_type(rows.schema["key"].dataType)
    spans = rows.repartition("key", "island").sortWithinPartitions("key", "island", "at")
    got = spans.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, start long, last long, n long")
    quiet, old = F.col("last") + idle * 1000, F.col("start") + longest * 1000
    return got.select(F.col("key").alias(key), F.timestamp_millis("start").alias("start"), F.timestamp_millis(F.least(quiet, old)).alias("stop"), "n", F.when(quiet <= old, "idle").otherwise("age").alias("ended"))


def alive(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired; the newest of a key counts."""
    newest = Window.partitionBy("key").orderBy(F.col("put_at").desc())
    return cache.withColumn("_n", F.row_number().over(newest)).filter((F.col("_n") == 1) & (F.col("expires_at") > now)).drop("_n")


def resumed(suspended: DataFrame, supplements: DataFrame, open_jobs: DataFrame) -> DataFrame:
    """Supplements with ``outcome``: resumed (question merged), not_suspended or in_flight."""
    both = supplements.join(suspended.select("run_id", "question", F.col("state").alias("_state")), "run_id", "left").join(open_jobs.select("run_id", F.lit(True).alias("_open")).distinct(), "run_id", "left")
    outcome = F.when(~F.col("_state").eqNullSafe(F.lit("CLARIFYING")), "not_suspended").when(F.col("_open"), "in_flight").otherwise("resumed")
    return both.select("run_id", outcome.alias("outcome"), F.when(outcome == "resumed", F.concat_ws("\n", "question", "supplement")).alias("question"))
