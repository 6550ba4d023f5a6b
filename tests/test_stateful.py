"""Leases, sessions, worker loop and commit log: streams against batches, dead and competing writers, edge rows."""

import random
import threading
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest


from textstrata.operators import conversation, mutation
from textstrata.sources.commits import Conflict, Store, shared_dir
from textstrata.streaming import jobs, timed, worker
from textstrata.streaming.leases import Feed, Leases, Sessions

T0 = datetime(2024, 1, 1)
EVENTS = "job_id long, ts timestamp, seq long, worker string, event string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def life(rows, until=None):
    """Outcomes (seq or minute of expiry, event, outcome, status, attempts) of one job's rows (minute, worker, event)."""
    machine, out = Leases(), []
    made = [(int(m * 60_000), i, {"worker": w, "event": e}) for i, (m, w, e) in enumerate(rows)]
    for row in timed.advance(machine, machine.start(), made, float("inf") if until is None else until * 60_000):
        out.append((row["event"], row["outcome"], row["status"], row["attempts"]))
    return out


def test_lease_rules():
    assert life([(0, "a", "claim"), (1, "b", "claim"), (2, "b", "complete"), (3, "a", "complete"), (4, "a", "claim")]) == [
        ("claim", "applied", "running", 1), ("claim", "refused", "running", 1), ("complete", "refused", "running", 1), ("complete", "applied", "succeeded", 1), ("claim", "refused", "succeeded", 1),
    ]
    # a heartbeat prolongs the lease; it then ends by itself, and the next worker may claim at once
    assert life([(0, "a", "claim"), (9, "a", "heartbeat"), (20, "b", "claim"), (21, "a", "complete"), (22, "b", "complete")]) == [
        ("claim", "applied", "running", 1), ("heartbeat", "applied", "running", 1), ("expire", "lease_expired", "retry_wait", 1), ("claim", "applied", "running", 2), ("complete", "refused", "running", 2), ("complete", "applied", "succeeded", 2),
    ]
    # retries wait, longer each time, and end
    assert life([(0, "a", "claim"), (0, "a", "fail"), (0.5, "a", "claim"), (1, "a", "claim"), (1, "a", "fail"), (2, "a", "claim"), (3, "a", "claim"), (3, "a", "fail")])[-1] == ("fail", "applied", "failed", 3)
    assert [x[1] for x in life([(0, "a", "claim"), (0, "a", "fail"), (0.5, "a", "claim"), (1, "a", "claim"), (1, "a", "fail"), (2, "a", "claim"), (3, "a", "claim")], until=4)] == ["applied", "applied", "refused", "applied", "applied", "refused", "applied"]
    assert life([(0, "a", "claim")], until=10) == [("claim", "applied", "running", 1)]
    assert life([(0, "a", "claim")], until=11)[-1] == ("expire", "lease_expired", "retry_wait", 1)
    assert life([(0, "a", "claim"), (0, "a", "cancel"), (1, "a", "fail_final"), (2, "a", "cancel")])[1:] == [("cancel", "refused", "running", 1), ("fail_final", "applied", "failed", 1), ("cancel", "refused", "failed", 1)]
    assert life([(0, "a", "cancel"), (0, "a", "nonsense"), (0, None, None)]) == [("cancel", "applied", "cancelled", 0), ("nonsense", "refused", "cancelled", 0), (None, "refused", "cancelled", 0)]


def random_events(n, keys):
    r = random.Random(4)
    return [(r.choice([*range(keys), None]), at(r.random() * 300), i, r.choice("ab"), r.choice(["claim", "claim", "heartbeat", "complete", "fail", "fail_final", "cancel"])) for i in range(n)]


def test_lease_stream_by_batches_in_any_order_equals_its_batch(spark, tmp_path):
    rows = random_events(300, 20)
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=random.Random(r[2]).random() * 50))  # up to 50 minutes late
    for i in range(4):
        spark.createDataFrame(order[i * 75 : i * 75 + 75], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema, files_per_batch=1)
    got = jobs.drained(timed.timed_stream(stream, Leases(), "job_id"), "leases")
    mark = int((max(r[1] for r in rows) - timedelta(hours=1) - datetime(1970, 1, 1)).total_seconds() * 1000)
    want = timed.folded(spark.createDataFrame(rows, EVENTS), Leases(), "job_id", until=mark)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert want.filter("event = 'expire'").count() > 5
    assert timed.folded(spark.createDataFrame([], EVENTS), Leases(), "job_id").count() == 0


def test_timer_expires_a_lease_without_a_further_event(spark, tmp_path):
    rows = [(1, at(0), 0, "a", "claim"), (2, at(200), 1, "a", "claim")]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/in")
    out = jobs.drained(timed.timed_stream(jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema), Leases(), "job_id"), "leases")
    assert [(r.job_id, r.event, r.status, r.at) for r in out.orderBy("at").collect()] == [(1, "claim", "running", at(0)), (1, "expire", "retry_wait", at(10))]


@pytest.mark.parametrize("machine", [Leases(), Sessions(), Feed(("complete",), ("cancel",))])
def test_keys_of_a_bucket_are_told_apart(spark, tmp_path, machine):
    rows = random_events(200, 40)
    columns = ["job_id", "ts", "seq", "worker", "event"] if isinstance(machine, Leases) else ["job_id", "ts", "seq", "event AS state", "worker AS detail"]
    for i in range(3):
        spark.createDataFrame(rows[i::3], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema, files_per_batch=1).selectExpr(*columns)
    # nothing is late, so that each batch counts
    got = jobs.drained(timed.timed_stream(stream, machine, "job_id", late="6 hours", buckets=2), "told").collect()
    tail = spark.createDataFrame([*rows, (-1, at(900), 900, "a", "claim")], EVENTS)
    tail.filter("job_id = -1").write.mode("append").parquet(f"{tmp_path}/in")
    more = jobs.drained(timed.timed_stream(stream, machine, "job_id", late="6 hours", buckets=2), "told").collect()
    mark = int((at(900) - timedelta(hours=6) - datetime(1970, 1, 1)).total_seconds() * 1000)
    want = timed.folded(tail.selectExpr(*columns), machine, "job_id", until=mark).collect()
    assert got == [] and len(want) > 40
    assert sorted(map(tuple, more), key=str) == sorted(map(tuple, want), key=str)


class Kept:
    """A handle that keeps one bucket's state in memory and counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, schema):  # noqa: N802
        return Kept.Variable(self, [])

    def getMapState(self, name, schema, values):  # noqa: N802
        return Kept.Variable(self, {})

    def getValueState(self, name, schema):  # noqa: N802
        return Kept.Variable(self, None)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)

    class Variable:
        def __init__(self, handle, held):
            self.handle, self.held, self.empty = handle, held, held

        def _do(self, what):
            self.handle.calls += 1
            return what

        def get(self):
            return self._do(self.held)

        def exists(self):
            return self._do(bool(self.held))

        def getValue(self, k):  # noqa: N802
            return self._do(self.held.get(k))

        def updateValue(self, k, v):  # noqa: N802
            self._do(self.held).update({k: v})

        def removeKey(self, k):  # noqa: N802
            self._do(self.held).pop(k, None)

        def appendValue(self, v):  # noqa: N802
            self.held = [*self._do(self.held), v]

        def put(self, v):
            self.held = self._do(v)

        update = put

        def clear(self):
            self.held = self._do(type(self.empty)() if self.empty is not None else None)


def test_a_stream_calls_its_store_seldom():
    """Events of many keys wait by the frame; only a key without anything due has an entry of its own."""
    handle, clock = Kept(), lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    told = timed._Timed(Leases(), "job_id", "bigint")
    told.init(handle)
    frame = pd.DataFrame([(0, k, 1000 + i, i, '{"worker": "a", "event": "%s"}' % e) for k in range(500) for i, e in enumerate(["claim", "heartbeat", "complete"][: 2 + (k < 20)])], columns=["bucket", "key", "at", "seq", "what"])
    assert list(told.handleInputRows((0,), iter([frame]), clock(0))) == [] and handle.timers == {1000}
    assert handle.calls <= 4
    handle.timers.clear()
    out = pd.concat(told.handleExpiredTimer((0,), clock(5000), None))
    assert len(out) == len(frame) and handle.calls <= 20 + 16
    # the leases of the rest end by themselves, at once
    assert handle.timers == {601_001}
    handle.timers.clear()
    out = pd.concat(told.handleExpiredTimer((0,), clock(700_000), None))
    assert sorted(out["job_id"]) == list(range(20, 500)) and set(out["event"]) == {"expire"} and not handle.timers


def plain_sessions(times, idle, longest):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1][1] + idle or t >= out[-1][0] + longest:
            out.append([t, t, 0])
        out[-1][1:] = [t, out[-1][2] + 1]
    return [(s, min(b + idle, s + longest), n) for s, b, n in out]


@pytest.mark.parametrize("span", [3600, 86_400])
def test_limited_sessions_by_plain_loop(spark, monkeypatch, span):
    r = random.Random(span)
    rows = [(u, T0 + timedelta(seconds=t)) for u in ("hot", "x", "y") for t in ([r.randrange(400_000) for _ in range(3000 if u == "hot" else 40)] + [0, 1800, 3600, 5400])]
    df = spark.createDataFrame([*rows, *rows[:5], (None, T0), ("x", None)], "user_id string, ts timestamp")
    plain = conversation.activity
    monkeypatch.setattr(conversation, "activity", lambda e, k, t, i: plain(e, k, t, i, span))
    got = {}
    for x in conversation.limited_sessions(df).collect():
        got.setdefault(x.user_id, []).append((x.start, x.stop, x.n))
    for u in ("hot", "x", "y"):
        want = plain_sessions([t for v, t in [*rows, *rows[:5]] if v == u], timedelta(seconds=1800), timedelta(hours=12))
        assert sorted(got[u]) == want
    assert set(got) == {"hot", "x", "y"}
    assert conversation.limited_sessions(df.limit(0)).count() == 0


def test_session_machine_is_the_plain_loop(spark):
    rows = [(1, at(m), i) for i, m in enumerate([0, 29, 58, 88, *range(100, 1000, 20)])]
    out = timed.folded(spark.createDataFrame(rows, "user_id long, ts timestamp, seq long"), Sessions(), "user_id").collect()
    assert sorted((r.start, r.stop, r.n) for r in out) == plain_sessions([t for _, t, _ in rows], timedelta(minutes=30), timedelta(hours=12))
    assert {r.ended for r in out} == {"idle", "age"}


# commit log
def test_commits_are_whole_or_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    a, b = spark.range(3), spark.range(5)
    assert store.version() == 0 and store.tables() == []
    assert store.commit(replace={"t": a}, append={"log": a}) == 1
    # a writer that dies between its tables, or before the log, leaves no trace in them
    class Dies(Exception):
        pass

    published = store._publish
    store._publish = lambda *x: (_ for _ in ()).throw(Dies())
    with pytest.raises(Dies):
        store.commit(replace={"t": b}, append={"log": b})
    store._publish = published
    fresh = Store(spark, f"{tmp_path}/s")
    assert fresh.version() == 1 and fresh.table("t").count() == 3 and fresh.table("log").count() == 3
    assert len(fresh.orphans()) == 2 and sorted(fresh.vacuum()) and fresh.orphans() == []
    assert fresh.commit(replace={"t": b}, append={"log": b}) == 2
    assert (fresh.table("t").count(), fresh.table("log").count(), fresh.table("t", 1).count()) == (5, 8, 3)
    assert fresh.compact("log") == 3 and fresh.table("log").count() == 8 and len(fresh.snapshot()["tables"]["log"]["folders"]) == 1
    with pytest.raises(ValueError):
        fresh.commit(append={"log": spark.createDataFrame([("x",)], "id string")})
    with pytest.raises(KeyError):
        fresh.table("none")


def test_second_writer_from_one_revision_fails(spark, tmp_path):
    first, second = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    at_ = first.commit(replace={"t": spark.range(1)})
    first.commit(replace={"t": spark.range(2)}, expected=at_)
    with pytest.raises(Conflict):
        second.commit(replace={"t": spark.range(9)}, expected=at_)
    assert second.table("t").count() == 2
    # both get past the check at once: the log takes one of them
    base = first.version()
    gate, got = threading.Barrier(2), []

    def late(store, n):
        publish = store._publish
        store._publish = lambda *x: (gate.wait(30), publish(*x))
        try:
            got.append(store.commit(replace={"t": spark.range(n)}, expected=base))
        except Conflict:
            got.append("conflict")
        finally:
            store._publish = publish

    threads = [threading.Thread(target=late, args=(s, n)) for s, n in ((first, 7), (second, 8))]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(got, key=str) == [base + 1, "conflict"] and Store(spark, f"{tmp_path}/s").table("t").count() in (7, 8)


def test_batches_commit_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.commit(append={"t": spark.range(2)}, batch=("w", 0)) == 1
    assert store.commit(append={"t": spark.range(2)}, batch=("w", 0)) == 1
    assert store.commit(append={"t": spark.range(2)}, batch=("v", 0)) == 2
    assert store.table("t").count() == 4 and store.done(("w", 0)) and not store.done(("w", 1))


def test_grants_audit_and_outbox_are_one_commit(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    v = store.commit(replace={"grants": spark.createDataFrame([(1, 9), (2, 9)], "doc long, user long")})
    asked = spark.createDataFrame([(1, 9, "grant"), (3, 9, "grant"), (3, 9, "grant"), (2, 9, "revoke"), (4, 9, "revoke")], "doc long, user long, request string")
    made = mutation.grant_transaction(store.table("grants"), asked, ["doc", "user"], actor=5)
    v = store.commit(replace={"grants": made["grants"]}, append={"audit": made["audit"], "outbox": made["outbox"]}, expected=v)
    assert sorted(r.doc for r in store.table("grants", v).collect()) == [1, 3]
    assert sorted(r.action for r in store.table("audit").collect()) == ["grant.grant", "grant.grant", "grant.revoke", "grant.revoke"]
    assert sorted(r.event_type for r in store.table("outbox").collect()) == ["grant.added", "grant.removed"]
    assert shared_dir(spark)


# worker loop
def made_failing():
    error = worker.JobError

    # a closure, which workers get by value: they can't import this file
    def failing(job, payload):
        if job == 2:
            raise error(404)
        if job == 3:
            raise RuntimeError
        return payload.upper()

    return failing


failing = made_failing()


def test_workers_claim_apart_and_lose_leases(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    subs = spark.createDataFrame([(i, f"p{i}") for i in range(1, 7)] + [(1, "p0")], "job_id long, payload string")
    worker.submit(store, subs, at(0), ("s", 0))
    worker.submit(store, subs, at(0), ("s", 0))
    worker.submit(store, subs, at(1), ("s", 1))
    assert worker.jobs(store).count() == 6 and worker.jobs(store).filter("job_id = 1").first().payload == "p0"
    one = worker.claim(store, "w1", at(1), 2, 600)
    two = worker.claim(store, "w2", at(1), 10, 600)
    mine, theirs = ({r.job_id for r in x.collect()} for x in (one, two))
    assert mine == {1, 2} and theirs == {3, 4, 5, 6}
    done = spark.createDataFrame([tuple(r) for r in worker.handle(one, failing).collect()], "job_id long, attempts int, result string, error_code string, retry boolean")
    # w1 is slow: its lease ends, w3 claims both, and what w1 brings is discarded
    three = worker.claim(store, "w3", at(12), 10, 600)
    assert {r.job_id for r in three.collect()} >= {1, 2} and {r.attempts for r in three.filter("job_id < 3").collect()} == {2}
    worker.record(store, "w1", done, at(13))
    assert {r.status for r in worker.jobs(store).filter("job_id < 3").collect()} == {"running"}
    worker.record(store, "w3", worker.handle(three, failing), at(13))
    now = {r.job_id: (r.status, r.attempts, r.error_code, r.result) for r in worker.jobs(store).collect()}
    assert now[1] == ("succeeded", 2, None, "P0") and now[2] == ("failed", 2, "document_missing", None) and now[3] == ("retry_wait", 2, "internal_error", None)
    assert worker.poll(store, "w4", failing, at(14), 10) == 0 and worker.poll(store, "w4", failing, at(20), 10) == 1
    assert worker.jobs(store).filter("job_id = 3").first().status == "failed"


def test_worker_stream_submits_each_batch_once(spark, tmp_path):
    schema = "job_id long, payload string"
    for i in range(2):
        spark.createDataFrame([(10 * i + j, f"x{j}") for j in range(1, 4)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store, now = Store(spark, f"{tmp_path}/s"), [T0]

    def clock():
        now[0] += timedelta(hours=1)
        return now[0]

    stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    worker.worker_stream(stream, store, "w", failing, clock, f"{tmp_path}/progress").awaitTermination()
    before = {r.job_id: (r.status, r.attempts) for r in worker.jobs(store).collect()}
    assert before == {1: ("succeeded", 1), 2: ("failed", 1), 3: ("failed", 3), 11: ("succeeded", 1), 12: ("succeeded", 1), 13: ("succeeded", 1)}
    version = store.version()
    worker.worker_stream(stream, store, "w", failing, clock, f"{tmp_path}/progress").awaitTermination()
    assert store.version() == version
