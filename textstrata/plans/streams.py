"""Streams over the events table, drained; each is held against the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .base import query, table


def _events(spark, d):
    events = table(spark, d, "events")
    # a glob, because a stream's plain path must be a folder and the table may be a single file
    return jobs.event_stream(spark, f"{d}/events.parque[t]", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 18 HOURS, time_bucket(INTERVAL 6 HOURS, ts), INTERVAL 6 HOURS)) AS start FROM events WHERE event_type = 'error'),
w AS (SELECT start, start + INTERVAL 24 HOURS AS stop, user_id, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT start, stop, user_id, n FROM w WHERE n >= 2 AND stop <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'error')""")
def lockout_streaming(spark, d):
    """Failures of a user in sliding windows of a day, closed ones (the watermark has passed them)."""
    return jobs.drained(jobs.lockout_counts(_events(spark, d).filter("event_type = 'error'"), span="24 hours", step="6 hours", least=2), "lockout")


@query("SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events) WHERE was IS DISTINCT FROM event_type")
def state_feed_streaming(spark, d):
    return jobs.drained(jobs.changed_states(_events(spark, d), "user_id", "event_type"), "feed")
