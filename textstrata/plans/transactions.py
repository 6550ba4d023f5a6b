"""Leases, sessions, worker loops and transactions: stateful work over the events and customers, batch and stream."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..operators import conversation, mutation
from ..sources.commits import Store, shared_dir
from ..streaming import jobs as streams
from ..streaming import timed, worker
from ..streaming.leases import Leases, Sessions
from .base import query, table
from .streams import _events

LATE_S = 600


def _job_events(events):
    """Eight events in a row are one job's."""
    t = F.col("event_type")
    what = F.when(t == "view", "claim").when(t == "click", "heartbeat").when(t == "purchase", "complete").when(t == "error", "fail").when(F.col("event_id") % 3 == 0, "cancel").when(F.col("event_id") % 3 == 1, "fail_final").otherwise("claim")
    return events.select(F.floor(F.col("event_id") / 8).alias("job_id"), "ts", F.col("event_id").alias("seq"), F.concat(F.lit("w"), F.col("event_id") % 2).alias("worker"), what.alias("event"))


# one recursion step an event; what expires before it is told in the same step
LEASE_SQL = """WITH RECURSIVE e AS (SELECT event_id // 8 AS job_id, event_id AS seq, (epoch_us(ts) // 1000) AS ms, 'w' || event_id % 2 AS worker,
    CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE ['cancel', 'fail_final', 'claim'][(event_id % 3 + 1)::INT] END AS event FROM events),
u AS (SELECT {until} AS until), o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, seq) AS i FROM e, u WHERE ms < until),
s AS (SELECT DISTINCT job_id, 0::BIGINT AS i, NULL::BIGINT AS ms, NULL::BIGINT AS seq, NULL::VARCHAR AS worker, NULL::VARCHAR AS event, false AS ok, 'pending' AS status, NULL::VARCHAR AS owner, 0 AS attempts, NULL::BIGINT AS lease,
    NULL::BIGINT AS avail, NULL::BIGINT AS x_at, NULL::VARCHAR AS x_owner, NULL::VARCHAR AS x_status, 0 AS x_attempts FROM o
  UNION ALL
  SELECT job_id, i, ms, seq, worker, event, ok,
    CASE WHEN NOT ok THEN st WHEN event = 'claim' THEN 'running' WHEN event = 'heartbeat' THEN st WHEN event = 'complete' THEN 'succeeded' WHEN event = 'cancel' THEN 'cancelled' WHEN event = 'fail' AND attempts < 3 THEN 'retry_wait' ELSE 'failed' END,
    CASE WHEN NOT ok THEN ow WHEN event = 'claim' THEN worker WHEN event = 'heartbeat' THEN ow END,
    CASE WHEN ok AND event = 'claim' THEN attempts + 1 ELSE attempts END,
    CASE WHEN ok AND event IN ('claim', 'heartbeat') THEN ms + 600000 WHEN ok THEN NULL ELSE ls END,
    CASE WHEN ok AND event = 'fail' AND attempts < 3 THEN ms + least(600, 60 * pow(2, attempts - 1)::BIGINT) * 1000 ELSE av END,
    CASE WHEN gone THEN lease END, CASE WHEN gone THEN owner END, CASE WHEN gone THEN st END, attempts
  FROM (SELECT *, CASE WHEN event = 'claim' THEN st IN ('pending', 'retry_wait') AND coalesce(av <= ms, true) AND attempts < 3 WHEN event = 'cancel' THEN st IN ('pending', 'retry_wait') ELSE st = 'running' AND ow = worker END AS ok
    FROM (SELECT *, CASE WHEN gone THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry_wait' END ELSE status END AS st, CASE WHEN gone THEN NULL ELSE owner END AS ow, CASE WHEN gone THEN NULL ELSE lease END AS ls, CASE WHEN gone THEN lease ELSE avail END AS av
      FROM (SELECT o.*, s.status, s.owner, s.attempts, s.lease, s.avail, s.status = 'running' AND s.lease < o.ms AS gone FROM s JOIN o ON o.job_id = s.job_id AND o.i = s.i + 1)))),
z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1),
r AS (SELECT job_id, ms, seq, worker, event, CASE WHEN ok THEN 'applied' ELSE 'refused' END AS outcome, status, attempts FROM s WHERE i > 0
  UNION ALL SELECT job_id, x_at, NULL, x_owner, 'expire', 'lease_expired', x_status, x_attempts FROM s WHERE x_at IS NOT NULL
  UNION ALL SELECT job_id, lease, NULL, owner, 'expire', 'lease_expired', CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry_wait' END, attempts FROM z, u WHERE status = 'running' AND lease < until)
SELECT job_id, make_timestamp_ms(ms) AS "at", seq, worker, event, outcome, status, attempts FROM r"""
MARK = f"(SELECT epoch_us(max(ts)) // 1000 - {LATE_S * 1000} FROM events)"


@query(LEASE_SQL.format(until="2^62"))
def lease_log(spark, d):
    """Every job's life under leases, to its end."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.folded(_job_events(events), Leases(), "job_id")


@query(LEASE_SQL.format(until=MARK))
def lease_log_streaming(spark, d):
    """The same by a stream with timers, as far as the watermark has come."""
    return streams.drained(timed.timed_stream(_job_events(_events(spark, d)), Leases(), "job_id", late=f"{LATE_S} seconds"), "leases")


IDLE_S, LONGEST_S = 10_800, 43_200
SESSION_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events{{where}}),
s AS (SELECT user_id, i, ms, ms AS start, 1 AS n FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.ms, CASE WHEN fresh THEN e.ms ELSE start END, CASE WHEN fresh THEN 1 ELSE n + 1 END
  FROM (SELECT e.*, s.start, s.n, e.ms >= least(s.ms + {IDLE_S * 1000}, s.start + {LONGEST_S * 1000}) AS fresh FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) AS e),
g AS (SELECT user_id, start, max(n)::BIGINT AS n, max(ms) AS last FROM s GROUP BY 1, 2)
SELECT user_id, make_timestamp_ms(start) AS start, make_timestamp_ms(least(last + {IDLE_S * 1000}, start + {LONGEST_S * 1000})) AS stop, n, CASE WHEN last + {IDLE_S * 1000} <= start + {LONGEST_S * 1000} THEN 'idle' ELSE 'age' END AS ended FROM g"""


@query(SESSION_SQL.format(where=""))
def limited_sessions(spark, d):
    """Sessions of users that end after three idle hours, or twelve hours after their start."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return conversation.limited_sessions(events, "user_id", "ts", IDLE_S, LONGEST_S)


@query(SESSION_SQL.format(where=f" WHERE (epoch_us(ts) // 1000) < {MARK}") + f" WHERE least(last + {IDLE_S * 1000}, start + {LONGEST_S * 1000}) <= {MARK}")
def limited_sessions_streaming(spark, d):
    """The same by a stream: those that the watermark has closed."""
    events = _events(spark, d).select("user_id", "ts", "event_id")
    return streams.drained(timed.timed_stream(events, Sessions(IDLE_S, LONGEST_S), "user_id", seq="event_id", late=f"{LATE_S} seconds"), "limited_sessions")


def _store(spark, name):
    return Store(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}").delete_on_exit()


@query("""WITH p AS (SELECT p_partkey AS resource_id, CASE WHEN p_size % 2 = 0 THEN 'grant' ELSE 'revoke' END AS request, p_partkey % 3 = 0 AS had FROM part)
SELECT resource_id, CASE request WHEN 'grant' THEN true ELSE false END AS granted, 'grant.' || request AS audited,
  CASE WHEN request = 'grant' AND NOT had THEN 'grant.added' WHEN request = 'revoke' AND had THEN 'grant.removed' END AS event FROM p""")
def audit_outbox(spark, d):
    """Grants, audit rows and outbox events of one commit, read back from it."""
    store = _store(spark, "grants")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("resource_id"), F.when(F.col("p_size") % 2 == 0, "grant").otherwise("revoke").alias("request"))
    begun = store.commit(replace={"grants": p.filter("resource_id % 3 = 0").select("resource_id")})
    made = mutation.grant_transaction(store.table("grants", begun), p, ["resource_id"], actor=1)
    done = store.commit(replace={"grants": made["grants"]}, append={k: made[k] for k in ("audit", "outbox")}, expected=begun, batch=("grants", 0))
    of = F.get_json_object("payload", "$.resource_id").cast("long").alias("resource_id")
    granted = store.table("grants", done).select("resource_id", F.lit(True).alias("granted"))
    audit, outbox = store.table("audit", done).select(of, F.col("action").alias("audited")), store.table("outbox", done).select(of, F.col("event_type").alias("event"))
    return audit.join(granted, "resource_id", "left").join(outbox, "resource_id", "left").select("resource_id", F.coalesce("granted", F.lit(False)).alias("granted"), "audited", "event")


def _greet(job: int, payload: str) -> str:
    """A handler with failures of every kind; those of one in seven jobs pass."""
    kind = job % 7
    if kind == 0:
        raise worker.JobError(404)
    if kind == 1:
        raise ValueError(payload)
    if kind == 2:
        raise worker.JobError(503)
    return f"{len(payload)} letters"


@query("""SELECT c_custkey AS job_id, CASE WHEN c_custkey % 7 < 3 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN c_custkey % 7 IN (1, 2) THEN 3 ELSE 1 END AS attempts,
  ['document_missing', 'internal_error', 'document_unavailable'][(c_custkey % 7 + 1)::INT] AS error_code, CASE WHEN c_custkey % 7 > 2 THEN length(c_name) || ' letters' END AS result FROM customer""")
def worker_loop(spark, d):
    """Jobs of all customers submitted by a stream, polled by a worker until each has succeeded or failed for good."""
    store = _store(spark, "jobs")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("payload"))
    arrivals = streams.event_stream(spark, f"{d}/customer.parque[t]", table(spark, d, "customer").schema).select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("payload"))
    now = [datetime(2024, 1, 1)]

    def clock():
        # each look at the clock is an hour later, so retries are due
        now[0] += timedelta(hours=1)
        return now[0]

    worker.worker_stream(arrivals, store, "w1", _greet, clock, f"{store.path}/progress", n=1_000_000).awaitTermination()
    return worker.jobs(store).join(c.select("job_id"), "job_id").select("job_id", "status", "attempts", "error_code", "result")
