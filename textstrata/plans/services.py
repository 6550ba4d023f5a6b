"""Feeds of runs, reviews by a judge, and concurrent requests, over the standard tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import evaluation, gates, judging, search
from ..streaming import jobs as streams
from ..streaming import timed
from ..streaming.leases import Feed
from .base import query, table
from .streams import _events

LATE_S, WAIT_S = 600, 900
RULES = Feed(("ANSWERED",), ("CLARIFYING",), WAIT_S)
STATE_SQL = "CASE event_type WHEN 'view' THEN 'RETRIEVING' WHEN 'click' THEN 'GENERATING' WHEN 'purchase' THEN 'ANSWERED' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'CLARIFYING' ELSE 'VERIFYING' END ELSE 'VERIFYING' END"
FEED_SQL = f"""WITH u AS (SELECT {{until}} AS until), e AS (SELECT event_id // 6 AS run_id, event_id AS seq, epoch_us(ts) // 1000 AS ms, {STATE_SQL} AS state, 'v' || value::VARCHAR AS detail FROM events, u WHERE epoch_us(ts) // 1000 < until),
b AS (SELECT *, min(ms) OVER (PARTITION BY run_id) + {WAIT_S * 1000} AS stop, lag(state) OVER o AS was, row_number() OVER o AS i FROM e WINDOW o AS (PARTITION BY run_id ORDER BY ms, seq)),
f AS (SELECT run_id, any_value(stop) AS stop, min(i) FILTER (state IN ('ANSWERED', 'CLARIFYING') AND ms <= stop) AS last, max(i) FILTER (ms <= stop) AS within, arg_max(state, i) FILTER (ms <= stop) AS held FROM b GROUP BY 1),
t AS (SELECT b.*, coalesce(last, within) AS last, last IS NOT NULL AS ended FROM b JOIN f USING (run_id) WHERE i <= coalesce(last, within)),
r AS (SELECT run_id, ms, i * 3 AS k, 'state' AS event, state, NULL AS detail FROM t WHERE was IS DISTINCT FROM state
  UNION ALL SELECT run_id, ms, i * 3 + 1, CASE state WHEN 'ANSWERED' THEN 'answer' ELSE 'clarify' END, state, detail FROM t WHERE ended AND i = last
  UNION ALL SELECT run_id, ms, i * 3 + 2, 'done', state, NULL FROM t WHERE ended AND i = last
  UNION ALL SELECT run_id, stop, 1000000000, 'timeout', held, NULL FROM f, u WHERE last IS NULL AND stop < until)
SELECT run_id, make_timestamp_ms(ms) AS "at", (row_number() OVER (PARTITION BY run_id ORDER BY k))::INT AS n, event, state, detail FROM r"""
MARK = f"(SELECT epoch_us(max(ts)) // 1000 - {LATE_S * 1000} FROM events)"


def _run_events(events):
    """Six events in a row are one run's."""
    return events.select(F.floor(F.col("event_id") / 6).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(STATE_SQL).alias("state"), F.concat(F.lit("v"), F.col("value").cast("string")).alias("detail"))


@query(FEED_SQL.format(until="2^62"))
def feed_events(spark, d):
    """All that clients of the runs are told: states, answers or questions, ends and timeouts."""
    return timed.folded(_run_events(table(spark, d, "events")), RULES, "run_id")


@query(FEED_SQL.format(until=MARK))
def feed_events_streaming(spark, d):
    """The same by a stream; timeouts come by timers."""
    return streams.drained(timed.timed_stream(_run_events(_events(spark, d)), RULES, "run_id", late=f"{LATE_S} seconds"), "feed_events")


def _judge(claims: list[str]) -> str:
    """A judge that breaks down over some claims, and with them over any batch that holds one."""
    numbers = [int(c) for c in claims]
    if any(n % 97 == 0 for n in numbers):
        raise TimeoutError
    return json.dumps({"reviews": [{"index": i, "supported": n % 5 != 0, "evidence_quote": f"q{n}", "issues": []} for i, n in enumerate(numbers, 1)]})


@query("""SELECT answer_id, n, CASE WHEN lost THEN 'unavailable' WHEN good THEN 'passed' ELSE 'failed' END AS outcome, quotes
FROM (SELECT o_custkey AS answer_id, count(*) AS n, bool_or(o_orderkey % 97 = 0) AS lost, bool_and(o_orderkey % 5 <> 0) AS good, string_agg(CASE WHEN o_orderkey % 97 <> 0 THEN 'q' || o_orderkey END, ',' ORDER BY o_orderkey) AS quotes FROM orders GROUP BY 1)""")
def claim_reviews(spark, d):
    """Claims judged in batches; a claim over which the judge breaks down is lost alone."""
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), "o_custkey", F.col("o_orderkey").cast("string").alias("claim"))
    told = judging.reviewed(claims, _judge).join(claims.select("claim_id", "o_custkey"), "claim_id")
    in_order = F.array_sort(F.collect_list(F.struct("claim_id", "supported", "evidence_quote")))
    own = told.groupBy(F.col("o_custkey").alias("answer_id")).agg(F.count(F.lit(1)).alias("n"), in_order.alias("v"))
    quotes = F.array_join("v.evidence_quote", ",")
    return own.select("answer_id", "n", gates.review_outcome(F.col("v.supported")).alias("outcome"), F.when(quotes != "", quotes).alias("quotes"))


WORDS, LEVELS = ["the", "that", "de la", "und der"], [1, 2, 4]
FLAT = r"regexp_replace(text, '[\s\x{3000}]+', '', 'g')"


@query(f"""WITH d AS (SELECT {FLAT} AS f FROM documents), w AS (SELECT * FROM (VALUES (0, ['the']), (1, ['that']), (2, ['de', 'la']), (3, ['und', 'der'])) AS t(i, terms)),
h AS (SELECT i, count(*) AS n FROM d, w WHERE len(list_filter(terms, lambda x: NOT contains(f, x))) = 0 GROUP BY 1),
l AS (SELECT level, r * level + k AS j FROM (VALUES (1), (2), (4)) AS t(level), range(2) AS u(r), range(4) AS v(k) WHERE k < level)
SELECT level::BIGINT AS level, count(*) AS n, 0::BIGINT AS errors, coalesce(sum(h.n), 0)::BIGINT AS rows, true AS ordered FROM l LEFT JOIN h ON h.i = j % 4 GROUP BY 1""")
def concurrency_levels(spark, d):
    """Searches of all documents at several levels of concurrency. Times differ from run to run: the result tells that they are in order, not what they are."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    told = evaluation.concurrency(spark, lambda words: search.keyword(docs, words), WORDS, LEVELS, rounds=2)
    rows = [(t["level"], t["n"], t["errors"], t["rows"], 0 < t["p50_ms"] <= t["p95_ms"] and t["per_second"] > 0) for t in told]
    return spark.createDataFrame(rows, "level long, n long, errors long, rows long, ordered boolean")
